"""Error histograms that grow as files of alignments arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phredlens.operators.alignments import mismatches
from phredlens.operators.statistics import error_histogram
from phredlens.operators.variants import classified
from phredlens.schemas import ALIGNMENTS


def alignment_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Alignments of the Parquet files in a folder, and of those that arrive there later."""
    return spark.readStream.schema(ALIGNMENTS).parquet(folder)


def streaming_error_histogram(alignments: DataFrame, reference: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(technology, base_qual, count) over all arrivals; written in complete mode. Rows have no event time, so there is
    no watermark; the state has a row per technology and quality. The reference and keys are static sides."""
    found = mismatches(alignments, reference)
    errors = found if keys is None else classified(found, keys).where("not is_variant")
    return error_histogram(errors)
