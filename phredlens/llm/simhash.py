"""SimHash near-dedup by covering locality-sensitive hashing.

A covering code replaces sampled bit positions: every bit position i has a vector m(i) of radius + 1 bits, and every
nonzero vector v is a table whose mask keeps the positions with <m(i), v> = 1. Two fingerprints that differ in at
most ``radius`` positions have difference vectors of rank at most ``radius``, so some nonzero v is orthogonal to all of
them and that table's mask hides every differing bit: the pair always collides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.llm.components import connected
from phredlens.llm.tables import KEYS, attach_groups, begin, release_memory, row_keys, stage, text_rows, unstage, without_rows

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints that one bucket compares directly; fuller buckets are split by a second covering code.
BUCKET = 1024
#: Full buckets that are told to all tasks; more of them are joined by shuffle.
BROADCAST_BUCKETS = 100_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bits set in over half of the shingle hashes; 0 for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII whitespace only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[words - 1 :] if len(tokens) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        set_in += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text as a signed long. The two halves of the row's key follow."""

    def run(batches):
        begin()
        for b in batches:
            prints = np.fromiter((fingerprint(x.as_py()) for x in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64)), *map(b.column, KEYS)], ["doc_id", "fp", *KEYS])
        release_memory()

    return text_rows(docs, *row_keys()).mapInArrow(run, f"doc_id long, fp long, {KEYS[0]} long, {KEYS[1]} long")


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks over ``positions``; each keeps about half of them."""
    top = (1 << (radius + 1)) - 1
    vectors = {p: 1 + k % top for k, p in enumerate(positions)}
    return [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one bucket, as (value, smaller value)."""
    n = len(values)
    label = np.arange(n)
    if n == 2:
        return [(int(values.max()), int(values.min()))] if (int(values[0]) ^ int(values[1])).bit_count() <= radius else []
    values = np.sort(values)
    free = np.bitwise_or.reduce(values ^ values[0])
    bits = [i for i in range(64) if int(free) >> i & 1]
    flips = None
    if len(bits) <= 16 and n > 2 * BUCKET:
        # Few free bits: a cube of at most 65,536 corners, whose links are the flips of up to ``radius`` bits.
        flips = np.array([sum(1 << b for b in c) for k in range(1, radius + 1) for c in combinations(range(len(bits)), k)], np.int64)
        corner = sum(((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k for k, b in enumerate(bits))
        at = np.full(1 << len(bits), n, np.int64)
        at[corner] = label
    while True:
        best = label.copy()
        if flips is not None:
            held = np.append(label, n)
            for f in flips:
                np.minimum(best, held[at[corner ^ f]], out=best)
        else:
            for i in range(0, n, 512):
                near = np.bitwise_count(values[i : i + 512, None] ^ values[None, :]) <= radius
                best[i : i + 512] = np.minimum(best[i : i + 512], np.where(near, label[None, :], n).min(axis=1))
        best = best[best]
        if (best == label).all():
            break
        label = best
    return [(int(values[i]), int(values[r])) for i, r in enumerate(label) if r != i]


def _links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (a, b) inside the buckets of ``rows`` (keys, fp). Buckets are brought together and stream by, so memory
    holds one bucket, which the caller bounds."""

    def run(batches):
        held: list[np.ndarray] = []
        key, size = None, 0

        def closed():
            return bucket_links(np.concatenate(held).view(np.uint64), radius) if size > 1 else []

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([_signed(r[i]) for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [np.asarray(batch.column(k)) for k in keys]
            fp = np.asarray(batch.column("fp"))
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if len(fp) else []
            out = []
            for a, z in zip([0, *change], [*change, len(fp)], strict=True):
                if z == a:
                    continue
                now = tuple(int(c[a]) for c in columns)
                if now != key:
                    out += closed()
                    key, held, size = now, [], 0
                held.append(fp[a:z])
                size += z - a
            if out:
                yield batch_of(out)
        if out := closed():
            yield batch_of(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect exactly what the links at ``radius`` or fewer bits connect.

    ``prints`` has one row per distinct fp. Every pair within the radius shares a bucket of some table; inside a
    bucket a spanning forest is returned, not all pairs. Buckets are counted first, with counts combined before they
    move. The rows of a bucket with over ``bucket`` fingerprints never meet in it: they go, from where they are, to
    the buckets of a second covering code over the bits its table hides, which leaves at most 16 free bits, so 65,536
    fingerprints, in a bucket, whatever the corpus holds; those are solved exactly over the cube of free bits.
    """
    masks = covering_masks(list(range(64)), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    full = stage(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("t", "key"))
    n_full = full.limit(BROADCAST_BUCKETS + 1).count()
    if not n_full:
        return _links(rows, ["t", "key"], radius).distinct()
    full = F.broadcast(full) if n_full <= BROADCAST_BUCKETS else full
    links = _links(rows.join(full, ["t", "key"], "left_anti"), ["t", "key"], radius)
    inner = [[m | s for s in covering_masks([i for i in range(64) if not m >> i & 1], radius)] for m in masks]
    literal = F.array(*[F.array(*[F.lit(_signed(x)) for x in row]) for row in inner])
    split = rows.join(full, ["t", "key"], "left_semi").select("t", "fp", F.posexplode(F.element_at(literal, F.col("t") + 1)).alias("s", "mask"))
    more = _links(split.select("t", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), ["t", "s", "key"], radius)
    return links.unionByName(more).distinct()


def _labelled(docs: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """(staged rows doc_id, fp, key and label: the component's smallest fingerprint, n_component; number of rows)."""
    prints = stage(fingerprints(docs))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *KEYS)
    classes = stage(prints.groupBy("fp").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n_docs")))
    links = stage(fingerprint_links(classes.select("fp"), radius))
    labels = connected(links)
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("first").alias("first"), F.sum("n_docs").alias("n_component"))
    groups = stage(named.drop("first").join(smallest, "label").select("fp", "first", "n_component", "n_docs"))
    unstage(classes, links)
    total = prints.count()
    return attach_groups(prints, groups, "fp", "n_docs", total), total


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Documents with one fingerprint are one class, so copies never become pairs; links join classes, components are
    found over classes, and each document gets its class's component. Texts of under four words have one shingle;
    texts without words (null ones too) have fingerprint zero and are linked like any other. A null doc_id is never
    a component_id unless all members have none; repeated rows are repeated in the result; an empty table gives no
    rows; other columns are ignored.
    """
    rows, _ = _labelled(docs, radius)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (all its columns) with one row of each component: the one with the smallest doc_id, null ones last.

    Where several rows share that doc_id, or have none, the one with the smallest row key stays, and of rows that
    repeat it, one."""
    rows, _ = _labelled(docs, RADIUS)
    by_key = rows.where("n_component > 1").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*(F.col(f"first.{k}") for k in KEYS)) == F.struct(*KEYS)).alias("once"))
    return without_rows(docs, stage(by_key.where("not once or n > 1")))
