"""Exact dedup: two-pass Bloom filtering; only rows whose hash may repeat are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.llm.tables import KEYS, MAX_FILTER_BITS, attach_groups, bloom, filter_bits, in_bloom, row_keys, stage, unstage, without_rows
from phredlens.sources.staging import fresh_path, staged_at

WHITESPACE = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha): SHA-256 of the text with each run of whitespace made one space; null texts count as empty. The two
    halves of the row's key follow."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WHITESPACE, " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), *row_keys())


def _halves(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)).view(np.uint64) for c in ("high", "low")]


def _flagged(part: DataFrame, rows: int, max_filter_bits: int, bits_per_key: int):
    """(``part``, of ``rows`` digests, with maybe: can the digest occur twice?; the broadcast bitmap that tells)."""
    bitmap = part.sparkSession.sparkContext.broadcast(bloom(part.select("high", "low"), filter_bits(rows, bits_per_key, max_filter_bits), twice=True))

    def flag(batches):
        for b in batches:
            yield b.append_column("maybe", pa.array(in_bloom(bitmap.value, *_halves(b)), pa.bool_()))

    return part.mapInArrow(flag, f"doc_id long, sha binary, {KEYS[0]} long, {KEYS[1]} long, high long, low long, maybe boolean").drop("high", "low"), bitmap


def _flagged_by_slice(keys: DataFrame, total: int, slices: int, max_filter_bits: int, bits_per_key: int) -> DataFrame:
    """All of ``keys`` with maybe, as a staged table, a slice of the digest space after another.

    Digests are written once more with their slice, each file sorted by it, without a shuffle; the predicate of a slice
    reaches the scan, which reads the pages that hold it. The rows of a slice are written before the next begins, and its
    bitmap goes, so that driver and executors hold one at a time, and the table is one scan, however many slices it had."""
    spark, path = keys.sparkSession, fresh_path(keys.sparkSession)
    cut = F.pmod(F.conv(F.hex(F.substring("sha", 17, 4)), 16, 10).cast("long"), F.lit(slices)).cast("int")
    sorted_ = stage(keys.withColumn("slice", cut).sortWithinPartitions("slice"))
    for k in range(slices):
        rows, bitmap = _flagged(sorted_.where(F.col("slice") == k).drop("slice"), -(-total // slices), max_filter_bits, bits_per_key)
        rows.write.mode("append").parquet(path)
        bitmap.destroy()
    unstage(sorted_)
    return staged_at(spark, path)


def _grouped(docs: DataFrame, max_filter_bits: int, bits_per_key: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """(rows that are known to be alone, rows of groups with their group's first row and group_size, staged tables that
    both read).

    Pass one sets, per partition, the bits of each digest in a pair of bitmaps (set, set again) and merges them; a
    digest can occur twice only if all its bits were set twice. Pass two sends the rows whose bits were all set
    twice to an exact group-by on the digest; every other row is known to be alone and stays where it is. The
    filter has ``bits_per_key`` bits a row up to ``max_filter_bits``; a larger corpus is filtered in slices of the
    digest space, one filter each (see ``_flagged_by_slice``), so nobody ever holds more than one bounded bitmap.
    """
    keys = stage(digests(docs).select("*", F.xxhash64("sha").alias("high"), F.xxhash64(F.lit("low"), "sha").alias("low")))
    total = keys.count()
    slices = max(1, -(-total * bits_per_key // max_filter_bits))
    if slices == 1:
        source, flagged = keys, _flagged(keys, total, max_filter_bits, bits_per_key)[0]
    else:
        source = flagged = _flagged_by_slice(keys, total, slices, max_filter_bits, bits_per_key)
        unstage(keys)
    alone, shared = flagged.where("not maybe").drop("maybe"), flagged.where("maybe").drop("maybe")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *KEYS)
    groups = stage(shared.groupBy("sha").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("group_size")))
    return alone, attach_groups(shared, groups, "sha", "group_size", total), (source, groups)


def exact_duplicates(docs: DataFrame, max_filter_bits: int = MAX_FILTER_BITS, bits_per_key: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Two-pass Bloom filtering finds the rows that may repeat, and only these are shuffled (see ``_grouped``). Nulls: a
    null text counts as empty, a null doc_id sorts after all others. Ties: of rows with equal text the smallest doc_id
    stays; rows that repeat one doc_id and text are one document, counted each and kept. An empty table gives no rows.
    Other columns are ignored.
    """
    alone, joined, _ = _grouped(docs, max_filter_bits, bits_per_key)
    single = alone.select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = joined.select("doc_id", "sha", F.col("first.doc_id").alias("keep_id"), "group_size").unionByName(single)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (all its columns) with one row of every distinct text: the one with the smallest doc_id, null ones last.

    Where several rows share that doc_id (or have none) and differ in whitespace alone, the one with the smallest row
    key stays, and of rows that repeat it, one. Texts of rows without an equal aren't shuffled.
    """
    _, joined, staged = _grouped(docs, MAX_FILTER_BITS, 16)
    own = F.first(F.struct(*(F.col(f"first.{k}") for k in KEYS)) == F.struct(*KEYS))
    by_key = joined.where("group_size > 1").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), own.alias("once"))
    decided = stage(by_key.where("not once or n > 1"))
    unstage(*staged)
    return without_rows(docs, decided)
