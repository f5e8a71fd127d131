"""Qualities before and after recalibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.schemas import DELTA_COLS

KEY = ["read_name", "chrom", "ref_pos", "is_read1"]


def last_of_each_key(mismatches: DataFrame) -> DataFrame:
    """One row per key: values of the row with the largest ord, first_ord of the smallest. Combined before a shuffle."""
    values = F.struct("ref_base", "read_base", "base_qual", "mapping_qual")
    rows = mismatches.groupBy(*KEY).agg(F.max_by(values, "ord").alias("v"), F.min("ord").alias("first_ord"))
    return rows.select(*KEY, "first_ord", "v.*")


def quality_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of both sides with both qualities, bases from before; first_ord gives the order of the first rows."""
    b = last_of_each_key(before)
    a = last_of_each_key(after).select(*KEY, F.col("base_qual").alias("qual_after"), F.col("mapping_qual").alias("mapq_after"))
    both = b.join(a, KEY).withColumns({"qual_before": F.col("base_qual"), "mapq_before": F.col("mapping_qual"), "delta": F.col("qual_after") - F.col("base_qual")})
    return both.select(*DELTA_COLS, "first_ord")


def dropped_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of before, repeats included, whose key isn't in after."""
    return before.join(after.select(*KEY).distinct(), KEY, "left_anti").select(*before.columns)


def mean_delta(deltas: DataFrame) -> DataFrame:
    """(n, mean_delta); the mean is null without rows."""
    return deltas.agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean_delta"))
