"""Shared plumbing of the training-data operators: rows and their keys, Bloom filters, hot-key joins, samples."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phredlens.sources.staging import shared_dir, stage, unstage

__all__ = ["shared_dir", "stage", "unstage"]

#: Bits of one Bloom filter slice: 32 MiB, whatever the corpus holds.
MAX_FILTER_BITS = 1 << 28
#: Fewest bits a key of a filter that is worth having; below, almost every row would pass it.
MIN_BITS = 6
#: Groups larger than this share of the rows (or, with many partitions, than a quarter of a partition's share) are joined
#: by broadcast; there are at most as many as that.
HEAVY_GROUPS = 1000
#: What a sample of texts for training may hold on the driver: bytes of one text, and of all.
SAMPLE_TEXT, SAMPLE_BYTES = 1 << 18, 48 << 20
#: The two halves of a row's key.
KEYS = ["__phl_k1", "__phl_k2"]
_SEGMENT_BITS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, *more) -> DataFrame:
    """(doc_id, text, ...) for an operator that takes whole texts in Arrow batches.

    Texts have no common length, so a batch is bounded by bytes, not only by rows: the session's
    ``spark.sql.execution.arrow.maxBytesPerBatch`` is set to 8 MiB (a longer text is a batch of its own).
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def rows_where(docs: DataFrame, wanted, done=None) -> DataFrame:
    """The rows of ``docs`` (all its columns) for whose texts ``wanted`` (an Arrow array to booleans) says so.

    Rows are decided where they stand, in batches bounded as in ``text_rows``: no key, no shuffle, no second pass.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    at = docs.columns.index("text")

    def run(batches):
        begin()
        for b in batches:
            yield b.filter(pa.array(wanted(pc.cast(b.column(at), pa.string())), pa.bool_()))
        if done:
            done()
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def release_memory() -> None:
    """Give freed memory back to the system when a task ends: Python workers outlive the stage they worked for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: What operators keep in a Python worker between tasks, by operator: how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def keep(operator: str, drop: Callable[[], None]) -> None:
    """Tables stay in this Python worker until another operator begins (see ``begin``)."""
    _KEPT[operator] = drop


def begin(operator: str = "") -> None:
    """A task of ``operator`` begins: what others have kept in this Python worker goes."""
    others = [k for k in _KEPT if k != operator]
    for k in others:
        _KEPT.pop(k)()
    if others:
        release_memory()


def slices_of(texts: pa.Array, max_chars: int = 1 << 21):
    """(start, end) row ranges of a batch of about ``max_chars`` bytes each; a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_chars:
            yield start, i
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


# --- Bloom filters -----------------------------------------------------------------------------------------------


def filter_bits(n: int, bits_per_key: int = 16, most: int = MAX_FILTER_BITS) -> int:
    bits = _SEGMENT_BITS
    while bits < n * bits_per_key and bits < most:
        bits *= 2
    return bits


def _positions(high: np.ndarray, low: np.ndarray, bits: int, hashes: int = 4) -> np.ndarray:
    steps = np.arange(hashes, dtype=np.uint64)[:, None]
    return ((high[None, :] + steps * (low | np.uint64(1))[None, :]) & np.uint64(bits - 1)).ravel()


def _bits(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit) of positions in a packed bitmap."""
    return (positions >> np.uint64(3)).astype(np.int64), (np.uint8(128) >> (positions & np.uint64(7)).astype(np.uint8))


def mark(once: np.ndarray, again: np.ndarray, positions: np.ndarray) -> None:
    """Set positions in the packed bitmap ``once``, and in ``again`` those that were set before or come twice here."""
    distinct, times = np.unique(positions, return_counts=True)
    byte, bit = _bits(distinct)
    repeated = (times > 1) | ((once[byte] & bit) != 0)
    np.bitwise_or.at(again, byte[repeated], bit[repeated])
    np.bitwise_or.at(once, byte, bit)


def bloom(rows: DataFrame, bits: int, twice: bool) -> np.ndarray:
    """Bitmap over rows (high long, low long) of uniform hashes.

    ``twice``: keep only bits that two or more rows set; a hash that occurs in two rows has all its bits there.
    A task holds two packed bitmaps of ``bits / 8`` bytes and touches only the bytes its rows set. The bitmaps of the
    partitions are merged by segment, so no task sees more than one bitmap, and the driver receives ``bits / 8`` bytes,
    which ``MAX_FILTER_BITS`` bounds.
    """
    bytes_ = _SEGMENT_BITS // 8

    def partial(batches):
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            if b.num_rows:
                mark(once, again, _positions(*(np.asarray(b.column(i)).astype(np.int64).view(np.uint64) for i in (0, 1)), bits))
        for k in np.flatnonzero(once.reshape(-1, bytes_).any(axis=1)).tolist():
            part = slice(k * bytes_, (k + 1) * bytes_)
            yield pa.RecordBatch.from_pydict({"segment": [k], "once": [zlib.compress(once[part].tobytes(), 1)], "again": [zlib.compress(again[part].tobytes(), 1)]})

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bytes_, np.uint8), np.zeros(bytes_, np.uint8)
        for b in batches:
            for a, c in zip(b.column("once").to_pylist(), b.column("again").to_pylist(), strict=True):
                a, c = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, c))
                again |= c | (once & a)
                once |= a
        yield pa.RecordBatch.from_pydict({"segment": [key[0].as_py()], "bits": [(again if twice else once).tobytes()]})

    parts = rows.mapInArrow(partial, "segment long, once binary, again binary").groupBy("segment").applyInArrow(merged, "segment long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for segment, piece in parts.collect():
        out[segment * bytes_ : (segment + 1) * bytes_] = np.frombuffer(piece, np.uint8)
    return out


def in_bloom(bitmap: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    byte, bit = _bits(_positions(high, low, len(bitmap) * 8))
    if not len(high):
        return np.zeros(0, bool)
    return ((bitmap[byte] & bit) != 0).reshape(-1, len(high)).all(axis=0)


# --- rows by their own keys --------------------------------------------------------------------------------------


def row_keys() -> list[Column]:
    """A key of doc_id and text together, in two halves of 64 bits; nulls differ from empty texts.

    What a stage decides holds for the rows with the key, so neither a repeated nor a null doc_id takes other rows along.
    """
    parts = [F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), F.col("text").cast("string")]
    return [F.xxhash64(*parts).alias(KEYS[0]), F.xxhash64(F.lit("low"), *parts).alias(KEYS[1])]


def maybe_in(keys: DataFrame, n: int):
    """A column function of the two halves of a key: may it be among the ``n`` rows of ``keys``? A Bloom filter of bounded
    size tells; None if so many keys would fill it."""
    if n * MIN_BITS > MAX_FILTER_BITS:
        return None
    bitmap = keys.sparkSession.sparkContext.broadcast(bloom(keys.select(*KEYS), filter_bits(n), twice=False))

    @F.pandas_udf("boolean")
    def maybe(high, low):
        import pandas as pd

        return pd.Series(in_bloom(bitmap.value, *(x.to_numpy(np.int64).view(np.uint64) for x in (high, low))))

    return maybe


def without_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``decided``, a staged table of distinct keys with n, the rows that have
    the key, and once: whether one of them stays.

    Almost all other rows pass a Bloom filter and stay where they are; the rest meets ``decided`` in an exact join,
    keys of very many rows by broadcast. Beyond ``MAX_FILTER_BITS / MIN_BITS`` keys all rows go to the join.
    """
    total = decided.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total[0]:
        return docs
    maybe = maybe_in(decided, total[0])
    keyed = docs.select("*", *row_keys())
    flagged = keyed if maybe is None else keyed.withColumn("__phl_maybe", maybe(*KEYS))
    rest = flagged if maybe is None else flagged.where("__phl_maybe")
    marks = decided.select(*KEYS, F.col("n").alias("__phl_n"), F.col("once").alias("__phl_once"))
    met = _left_by_size(rest, marks, KEYS, "__phl_n", total[1])
    clear = met.where("__phl_once is null").select(*docs.columns)
    single = met.where("__phl_once").dropDuplicates(KEYS).select(*docs.columns)
    out = clear.unionByName(single)
    return out if maybe is None else flagged.where("not __phl_maybe").select(*docs.columns).unionByName(out)


# --- samples for training ----------------------------------------------------------------------------------------


def few_texts(rows: DataFrame, most: int, max_bytes: int = SAMPLE_BYTES, longest: int = SAMPLE_TEXT) -> list[tuple]:
    """At most ``most`` distinct rows (with a column text) by the order of their hashes, sorted, as tuples; texts of over
    ``longest`` bytes are no examples, and all together have at most ``max_bytes``.

    ``rows`` is a selection that is small but for repeats; these are combined where they are.
    """
    size = F.octet_length("text").cast("long")
    some = rows.where(size <= longest).distinct().withColumn("__phl_place", F.xxhash64(*rows.columns)).orderBy("__phl_place", *rows.columns).limit(most)
    so_far = F.sum(size).over(Window.orderBy("__phl_place", *rows.columns).rowsBetween(Window.unboundedPreceding, 0))
    return sorted(map(tuple, some.withColumn("__phl_sum", so_far).where(F.col("__phl_sum") <= max_bytes).select(*rows.columns).collect()))


# --- joins that a hot key cannot stall ---------------------------------------------------------------------------


def _heavy(groups: DataFrame, size: str, total: int) -> tuple[DataFrame, int]:
    """(groups above a limit of rows as a local table, limit). ``total`` rows hold at most total / limit such groups, a
    number that follows the partitions, not the rows."""
    spark = groups.sparkSession
    limit = max(1, total // max(HEAVY_GROUPS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.createDataFrame(groups.where(F.col(size) > limit).collect(), groups.schema), limit


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one staged row per ``key``, with its row count ``size``).

    Rows of large groups stay where they are and get the group by broadcast; all other keys have less than a quarter
    of a partition's share of the rows, so they can't make a partition stand out.
    """
    heavy, limit = _heavy(groups, size, total)
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.where(F.col(size) <= limit), key)
    return hot.unionByName(cold)


def _left_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups``, large ones as in ``attach_groups``."""
    heavy, limit = _heavy(groups, size, total)
    marked = rows.join(F.broadcast(heavy.withColumn("__phl_hot", F.lit(True))), keys, "left")
    hot = marked.where("__phl_hot").drop("__phl_hot")
    cold = marked.where("__phl_hot is null").select(*rows.columns).join(groups.where(F.col(size) <= limit), keys, "left")
    return hot.unionByName(cold)
