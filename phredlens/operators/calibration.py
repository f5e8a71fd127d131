"""Calibration: declared quality against the observed error rate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.functions.sequence import BASES, empirical_quality, error_probability
from phredlens.operators.alignments import characters, observed_bases
from phredlens.operators.variants import off_sites

#: Least errors of a plotted point.
PLOT_ERRORS = 30


def calibration_counts_by_base(pieces: DataFrame, sites: DataFrame | None = None, min_base_qual: int = 0) -> DataFrame:
    """The rows of ``calibration_counts`` from one row a base, in DataFrame functions only; bases at ``sites`` go in an anti
    join. For tables of bases that are filtered in other ways too."""
    bases = observed_bases(pieces.select("technology", "chrom", "q", "r", "n", "ref_seq", "read_seq", "qual_seq"))
    counted = bases.where((F.col("base_qual") >= min_base_qual) & F.col("ref_base").isin(*BASES) & (F.col("read_base") != "N"))
    return off_sites(counted, sites).groupBy("technology", "base_qual").agg(F.count(F.lit(1)).alias("n_bases"), F.count_if(F.col("read_base") != F.col("ref_base")).alias("n_errors"))


def calibration_counts(pieces: DataFrame, min_base_qual: int = 0) -> DataFrame:
    """(technology, base_qual, n_bases, n_errors) over aligned bases.

    A base counts if its quality is enough, the reference has A, C, G or T, the read has not N, and no variant site
    is there: ``aligned_pieces`` with sites has lower-case letters there. Array counting in Arrow batches: characters are
    counted where they lie in a batch's buffers, a task holds a few counters, and a row per task, technology and quality
    is shuffled."""

    def run(batches):
        acgt = np.zeros(256, bool)
        acgt[list(b"ACGT")] = True
        totals: dict[str | None, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("technology").dictionary_encode()
            ref, read, qual = (characters(b.column(c)) for c in ("ref_seq", "read_seq", "qual_seq"))
            group = np.repeat(np.asarray(names.indices.fill_null(len(names.dictionary))).astype(np.int32) * 256, np.asarray(pc.binary_length(b.column("qual_seq"))))
            counted = acgt[ref] & (read != ord("N")) & (qual >= min_base_qual + 33)
            size = 256 * (len(names.dictionary) + 1)
            both = [np.bincount((group + qual)[x], minlength=size).reshape(-1, 256) for x in (counted, counted & (ref != read))]
            for k, name in enumerate([*names.dictionary.to_pylist(), None]):
                totals[name] = totals.get(name, 0) + np.stack([x[k] for x in both])
        out = [(t, k - 33, int(n), int(e)) for t, (bases, errors) in totals.items() for k, (n, e) in enumerate(zip(bases, errors, strict=True)) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["technology", "base_qual", "n_bases", "n_errors"])

    parts = pieces.select("technology", "ref_seq", "read_seq", "qual_seq").mapInArrow(run, "technology string, base_qual int, n_bases long, n_errors long")
    return parts.groupBy("technology", "base_qual").agg(F.sum("n_bases").alias("n_bases"), F.sum("n_errors").alias("n_errors"))


def calibration_rows(counts: DataFrame) -> DataFrame:
    """Adds error_rate and empirical_q (null without errors); qualities without bases are left out."""
    return counts.where("n_bases > 0").select("technology", "base_qual", "n_bases", "n_errors", (F.col("n_errors") / F.col("n_bases")).alias("error_rate"), empirical_quality(F.col("n_errors"), F.col("n_bases")).alias("empirical_q"))


def calibration_summary(counts: DataFrame) -> DataFrame:
    """Per technology: bases, errors, observed and expected rate and their ratio; 0 where a divisor is 0."""
    sums = counts.groupBy("technology").agg(F.sum("n_bases").alias("n_bases"), F.sum("n_errors").alias("n_errors"), F.sum(F.col("n_bases") * error_probability(F.col("base_qual"))).alias("e"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rates = sums.select("technology", "n_bases", "n_errors", share(F.col("n_errors"), F.col("n_bases")).alias("observed"), share(F.col("e"), F.col("n_bases")).alias("expected"))
    return rates.withColumn("ratio", share(F.col("observed"), F.col("expected")))


def calibration_plot_points(counts: DataFrame, least_errors: int = PLOT_ERRORS) -> DataFrame:
    """Points with enough errors, with the axis limits (lo, hi) of all points together.

    The limits are one below the smallest and one above the largest number on either axis; 0 and 40 without points."""
    points = calibration_rows(counts).where(F.col("n_errors") >= least_errors).select("technology", "base_qual", "empirical_q", "n_errors")
    limits = points.agg((F.least(F.min("base_qual"), F.min("empirical_q")) - 1).alias("lo"), (F.greatest(F.max("base_qual"), F.max("empirical_q")) + 1).alias("hi"))
    return points.withColumns({"lo": F.coalesce(limits.select("lo").scalar(), F.lit(0.0)), "hi": F.coalesce(limits.select("hi").scalar(), F.lit(40.0))})
