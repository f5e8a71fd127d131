"""Counts of a stream of alignments that a replayed batch doesn't change.

Each batch writes its counts to a folder of its own number. A batch that runs again, after a failure or from an older
checkpoint, replaces what it wrote; totals are sums over the folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phredlens.operators import alignments as al
from phredlens.operators.calibration import calibration_counts
from phredlens.operators.statistics import error_histogram
from phredlens.operators.variants import classified
from phredlens.sources.staging import stage, unstage

COUNTS = "kind string, technology string, base_qual int, n_bases long, n_errors long, batch long"


def batch_counts(reads: DataFrame, reference: DataFrame | None, keys: DataFrame | None = None, sites: DataFrame | None = None, min_mapq: int = 1, min_base_qual: int = 0) -> DataFrame:
    """(kind, technology, base_qual, n_bases, n_errors): calibration counts, and the error histogram with n_bases null."""
    pieces = al.aligned_pieces(al.usable_reads(reads, min_mapq), reference, sites=sites)
    found = al.mismatches_of(pieces, min_base_qual)
    errors = found if keys is None else classified(found, keys).where("not is_variant")
    counts = calibration_counts(pieces, min_base_qual).select(F.lit("calibration").alias("kind"), "technology", "base_qual", "n_bases", "n_errors")
    histogram = error_histogram(errors).select(F.lit("errors").alias("kind"), "technology", "base_qual", F.lit(None).cast("long").alias("n_bases"), F.col("count").alias("n_errors"))
    return counts.unionByName(histogram)


def streamed_extraction(alignments: DataFrame, out: str, checkpoint: str, reference: DataFrame | None = None, keys: DataFrame | None = None, sites: DataFrame | None = None, min_mapq: int = 1, min_base_qual: int = 0) -> StreamingQuery:
    """Start counting a stream of alignments into ``out``; it stops when all that has arrived is counted.

    The reference, keys and sites are static. A batch's reads are scanned twice, so they are staged first."""

    def write(batch: DataFrame, number: int) -> None:
        reads = stage(batch)
        counts = batch_counts(reads, reference, keys, sites, min_mapq, min_base_qual)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")
        unstage(reads)

    return alignments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(calibration counts, error histogram) over all batches so far."""
    rows = spark.read.schema(COUNTS).parquet(out)
    sums = rows.groupBy("kind", "technology", "base_qual").agg(F.sum("n_bases").alias("n_bases"), F.sum("n_errors").alias("n_errors"))
    calibration = sums.where("kind = 'calibration'").select("technology", "base_qual", "n_bases", "n_errors")
    return calibration, sums.where("kind = 'errors'").select("technology", "base_qual", F.col("n_errors").alias("count"))
