"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over token positions. The hash of a window covers only the positions the mask selects, so a
substituted word at an ignored position changes nothing. Hashes of the test items are joined with those of the
training texts, and around each hit the two token sequences are compared along their diagonal.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.llm.tables import KEYS, begin, bloom, filter_bits, in_bloom, release_memory, row_keys, rows_where, slices_of, stage, text_rows, unstage, without_rows
from phredlens.sources.staging import fresh_path, staged_at

#: Masks of five selected tokens each; together they survive one substitution in about every fifth token.
MASKS = ("11111", "1101011", "1011101", "110010011", "1010110001", "11001000101")
#: Items of under five tokens have one seed each, the whole item.
SHORT = ("1", "11", "111", "1111")
#: An overlap has this many matching tokens at least (an item with fewer tokens must match whole) ...
MIN_MATCHES = 10
#: ... and this share of its tokens matches.
MIN_IDENTITY = 0.8
#: Test items are taken in blocks of so many characters, one broadcast at a time as sorted arrays of some 20 bytes a character.
BLOCK_CHARS = 4_000_000
#: Hits that are looked at in one go, whatever their number.
_AT_ONCE = 1 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_REMEMBERED = 150_000
#: Blanks and punctuation beyond ASCII, which part tokens; signs that are tokens by themselves (ideographs, kana).
_APART = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b9\u00bb\u00bf\u00d7\u00f7\u1680\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u2e00-\u2e7f\u3000-\u3004\u3008-\u3020\u3030\u303d\ufe30-\ufe6b\ufeff\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_ALONE = re.compile("([\u3040-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased; ASCII and other blanks, punctuation and symbols part them. An
    ideograph or kana is a token by itself. Other characters beyond ASCII count as letters."""
    text = text or ""
    if not text.isascii():
        text = _ALONE.sub(r" \1 ", _APART.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def token_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash per window of ``len(mask)`` tokens, over the selected ones."""
    n = len(hashes) - len(mask) + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for k, c in enumerate(mask):
            if c == "1":
                out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
    return out


class Seeds:
    """The seed hashes of one block of test items, by mask: sorted hashes with the place of their window.

    Built once, as arrays: ``words`` are the token hashes of all items one after another, ``first`` says where each
    begins, and a place is a number of a token in ``words``.
    """

    def __init__(self, items: list[tuple[int, str]], masks=MASKS):
        each = [token_hashes(tokens(t)) for _, t in items]
        sizes = np.array([len(x) for x in each], np.int64)
        self.ids = [i for i, _ in items]
        self.words = np.concatenate([*each, np.zeros(0, np.uint64)])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.item = np.repeat(np.arange(len(each)), sizes)
        self.masks = (*masks, *SHORT)
        self.tables = []
        for mask in self.masks:
            key = seed_hashes(self.words, mask)
            at = np.arange(len(key))
            size = sizes[self.item[at]] if len(at) else sizes[:0]
            inside = at + len(mask) <= self.first[1:][self.item[at]] if len(at) else np.zeros(0, bool)
            at = at[inside & (size == len(mask))] if mask in SHORT else at[inside]
            order = np.argsort(key[at], kind="stable")
            self.tables.append((key[at][order], at[order].astype(np.int32)))
        self.bits = max(16, min(24, int(8 * len(self.words) * len(masks)).bit_length()))
        self.filter = None

    def words_of(self, item: int) -> np.ndarray:
        return self.words[self.first[item] : self.first[item + 1]]

    def hits(self, hashes: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Distinct (item, diagonal, text) with a seed hit, sorted by text, item and diagonal (place of the window among
        ``hashes`` less its place in the item). ``first``: where each text begins in ``hashes``."""
        first = np.array([0, len(hashes)]) if first is None else first
        if self.filter is None:
            self.filter = np.zeros(1 << self.bits, bool)
            for key, _ in self.tables:
                self.filter[(key >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        found = [np.zeros((0, 3), np.int64)]
        for mask, (key, where) in zip(self.masks, self.tables, strict=True):
            own = seed_hashes(hashes, mask)
            at = np.flatnonzero(self.filter[(own >> np.uint64(64 - self.bits)).astype(np.int64)])
            low, high = (np.searchsorted(key, own[at], side) for side in ("left", "right"))
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(n)
            start = 0
            while start < len(at):  # repeated words hit at every place, so hits are made distinct in parts
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _AT_ONCE, "right")))
                m = n[start:stop]
                place = where[np.repeat(low[start:stop] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                here = np.repeat(at[start:stop], m)
                item = self.item[place]
                found.append(_distinct(np.stack([item, here - (place - self.first[item]), np.searchsorted(first, here, "right") - 1], axis=1)))
                if len(found) > 16:
                    found = [_distinct(np.concatenate(found))]
                start = stop
        return _distinct(np.concatenate(found))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct rows, sorted by the last column, then the others."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0], rows[:, 2]))]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))] if len(rows) else rows


def best_overlap(text: np.ndarray, item: np.ndarray, diagonal: int, min_matches: int = MIN_MATCHES, min_identity: float = MIN_IDENTITY):
    """(first text token, tokens, matches) of the longest ungapped overlap on a diagonal in which ``min_identity`` of
    the tokens match, mismatches at its ends cut off; None if it has too few matches.

    A match weighs 1 - identity and a mismatch -identity, so a stretch is allowed if its sum isn't negative: for each
    stop, the longest one starts at the first running minimum that isn't above the sum so far.
    """
    a, z = max(0, diagonal), min(len(text), diagonal + len(item))
    same = text[a:z] == item[a - diagonal : z - diagonal]
    sums = np.round(np.concatenate([[0.0], np.cumsum(np.where(same, 1 - min_identity, -min_identity))]), 9)
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    stop = int(np.argmax(np.arange(len(sums)) - starts))
    inside = np.flatnonzero(same[starts[stop] : stop])
    if not len(inside):
        return None
    start, stop, matches = int(starts[stop] + inside[0]), int(starts[stop] + inside[-1]) + 1, len(inside)
    if matches < min(min_matches, len(item)):
        return None
    return a + start, stop - start, matches


def _blocks(benchmark: DataFrame, most: int):
    """Test items by blocks of ``most`` characters; the driver holds one block at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        if held and size + len(r.text) > most:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield held


def found_in(seeds: Seeds, texts: pa.Array, min_matches: int, min_identity: float):
    """(row, item number, first token, tokens, matches): the best overlap of each text and item that have one."""
    for a, z in slices_of(texts):
        each = [token_hashes(tokens(t.as_py())) for t in texts[a:z]]
        first = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        best: dict[tuple[int, int], tuple] = {}
        for item, diagonal, d in seeds.hits(np.concatenate(each), first).tolist():
            key, words = (d, item), seeds.words_of(item)
            if key in best and best[key][2] == len(words):
                continue  # nothing beats the first whole match, so repeated words cost one comparison
            got = best_overlap(each[d], words, diagonal - int(first[d]), min_matches, min_identity)
            if got and (key not in best or (got[2], -got[0]) > (best[key][2], -best[key][0])):
                best[key] = got
        yield from ((a + d, item, *got) for (d, item), got in best.items())


_SCHEMA = "doc_id long, item_id long, first_word long, n_words long, n_matches long, identity double"


def _overlaps(source: DataFrame, items, min_matches: int, min_identity: float, carried: list[str]) -> DataFrame:
    """Overlaps of the texts of ``source`` (doc_id, text and the carried longs) with one block, a broadcast of Seeds."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + carried
    kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * len(carried)

    def run(batches):
        begin()
        seeds = items.value
        for b in batches:
            own = [b.column(c).to_pylist() for c in ("doc_id", *carried)]
            rows = [(own[0][k], seeds.ids[item], *got, got[2] / got[1], *(c[k] for c in own[1:])) for k, item, *got in found_in(seeds, b.column("text"), min_matches, min_identity)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
        _HASHES.clear()
        release_memory()

    return source.mapInArrow(run, _SCHEMA + "".join(f", {c} long" for c in carried))


def _candidates(source: DataFrame, benchmark: DataFrame, block_chars: int) -> DataFrame:
    """The rows of ``source`` that have a seed in common with any test item, and some more by chance: a Bloom filter
    over the seeds of all blocks, of bounded size, tells."""
    spark = source.sparkSession

    def seeds_of(batches):
        for b in batches:
            for a, z in slices_of(b.column("text"), block_chars):
                seeds = Seeds([(0, t.as_py()) for t in b.column("text")[a:z]])
                for k, (key, _) in enumerate(seeds.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in _halves(key, k)], ["high", "low"])

    rows = stage(benchmark.select(F.col("text").cast("string")).where("text is not null").mapInArrow(seeds_of, "high long, low long"))
    bitmap = spark.sparkContext.broadcast(bloom(rows, filter_bits(rows.count()), twice=False))

    def run(batches):
        for b in batches:
            keep = [any(in_bloom(bitmap.value, *_halves(seed_hashes(words, m), k)).any() for k, m in enumerate((*MASKS, *SHORT))) for words in (token_hashes(tokens(t.as_py())) for t in b.column("text"))]
            yield b.filter(pa.array(keep, pa.bool_()))
        _HASHES.clear()
        release_memory()

    out = stage(source.mapInArrow(run, source.schema))
    bitmap.destroy()
    unstage(rows)
    return out


def _halves(key: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = (key ^ np.uint64(mask * 0x9E3779B9 + 1)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32)), key


def _all_overlaps(docs: DataFrame, benchmark: DataFrame, min_matches: int, min_identity: float, block_chars: int, carried: list[str]) -> DataFrame:
    """Overlaps with every block of items. With one block they are a plan over ``docs``; with more, a staged table: the rows of
    a block are written before the next is built, and its broadcast goes, so that one is alive at a time."""
    spark = docs.sparkSession
    schema = _SCHEMA + "".join(f", {c} long" for c in carried)
    blocks = _blocks(benchmark, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    source = text_rows(docs, *(c for c in row_keys() if carried))
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return _overlaps(source, spark.sparkContext.broadcast(Seeds(first)), min_matches, min_identity, carried)
    candidates, path = _candidates(source, benchmark, block_chars), fresh_path(spark)
    for block in chain([first, second], blocks):
        items = spark.sparkContext.broadcast(Seeds(block))
        _overlaps(candidates, items, min_matches, min_identity, carried).write.mode("append").parquet(path)
        items.destroy()
    unstage(candidates)
    return staged_at(spark, path, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, min_matches: int = MIN_MATCHES, min_identity: float = MIN_IDENTITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and test item that overlap: doc_id, item_id, first_word, n_words, n_matches, identity.

    first_word and n_words are the best overlap in tokens of the document (most matches, then the earliest). Test items
    that fit one block of bounded size are broadcast, and the texts are passed over once, without a shuffle. More items
    cost one pass that finds the documents with any seed of any item, and then a pass over those for each block, one block
    in memory at a time; the result is then a staged table. Null
    and empty texts or items overlap nothing; items of under five tokens must stand whole, token by token; repeated
    documents or items repeat in the result; an empty table on either side gives no rows; other columns are ignored.
    """
    return _all_overlaps(docs, benchmark, min_matches, min_identity, block_chars, [])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (all its columns) without the rows whose text overlaps a test item.

    With items of one block every row is decided where it stands, by its own text; with more, by its own key."""
    blocks = _blocks(benchmark, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is not None:
        found = _all_overlaps(docs, benchmark, MIN_MATCHES, MIN_IDENTITY, block_chars, KEYS)
        decided = stage(found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("once")))
        unstage(found)
        return without_rows(docs, decided)
    items = docs.sparkSession.sparkContext.broadcast(Seeds(first))

    def clean(texts: pa.Array) -> np.ndarray:
        keep = np.ones(len(texts), bool)
        keep[[k for k, *_ in found_in(items.value, texts, MIN_MATCHES, MIN_IDENTITY)]] = False
        return keep

    def done():
        _HASHES.clear()

    return rows_where(docs, clean, done)


def mask_offsets(mask: str) -> list[int]:
    return [m.start() for m in re.finditer("1", mask)]
