"""Error counts and base-quality distributions per technology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extraction_counts(classified: DataFrame) -> DataFrame:
    """Per technology: n_mismatches = n_errors + n_variants."""
    return classified.groupBy("technology").agg(F.count(F.lit(1)).alias("n_mismatches"), F.count_if(~F.col("is_variant")).alias("n_errors"), F.count_if("is_variant").alias("n_variants"))


def error_histogram(errors: DataFrame) -> DataFrame:
    """(technology, base_qual, count) of error rows, a null technology or quality as a group of its own; no rows, no
    groups. Counts are combined before they move."""
    return errors.groupBy("technology", "base_qual").agg(F.count(F.lit(1)).alias("count"))


def quality_distribution(histogram: DataFrame, technologies: DataFrame | None = None) -> DataFrame:
    """n, mean, median (the middle of two when even) and population deviation of a histogram, per technology.

    Works on counts, so a technology costs as many rows as it has qualities. Counts below one are left out.
    Technologies that were asked for and have no rows get zeros.
    """
    kept = histogram.where(F.col("count") > 0)
    n, q = F.col("count").cast("double"), F.col("base_qual").cast("double")
    sums = kept.groupBy("technology").agg(F.sum("count").alias("n"), F.expr("percentile(base_qual, 0.5D, count)").alias("median"), (F.sum(q * n) / F.sum(n)).alias("mean"))
    spread = kept.join(F.broadcast(sums.select("technology", "mean")), "technology").groupBy("technology").agg(F.sqrt(F.sum(n * (q - F.col("mean")) ** 2) / F.sum(n)).alias("stdev"))
    out = sums.join(spread, "technology")
    if technologies is not None:
        out = technologies.select("technology").distinct().join(out, "technology", "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return out.select("technology", zero("n", "long"), zero("mean", "double"), zero("median", "double"), zero("stdev", "double"))


def compare_technologies(mismatches: DataFrame, technologies: DataFrame) -> DataFrame:
    """``quality_distribution`` of the technologies asked for, with zeros for one without a mismatch; others are left out."""
    return quality_distribution(error_histogram(mismatches.join(F.broadcast(technologies.select("technology").distinct()), "technology", "left_semi")), technologies)


def mapped_counts(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Mapped reads of every contig (name, length, n_mapped), in the contigs' order."""
    n = reads.where(F.col("flag").bitwiseAND(F.lit(4)) == 0).groupBy(F.col("chrom").alias("name")).agg(F.count(F.lit(1)).alias("n_mapped"))
    return contigs.join(n, "name", "left").select("ord", "name", "length", F.coalesce("n_mapped", F.lit(0)).cast("long").alias("n_mapped"))
