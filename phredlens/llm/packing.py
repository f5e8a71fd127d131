"""Packing of token sequences: documents become pieces of at most a sequence's length, pieces become full sequences.

The search (``bin_completion``) sees only how many pieces have each length, a table of as many rows as a sequence has
tokens. Its answer is a list of fillings with the number of sequences of each. Pieces then find their own place: the
rank of a piece among those of its length says which filling, which sequence and which offset it has.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phredlens.llm.bin_completion import NODES, Packing, pack
from phredlens.llm.bpe import PIECES, byte_alphabet
from phredlens.llm.tables import begin, keep, release_memory, stage, text_rows

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: A key of (length, rank) in one number; ranks stay below.
_RANKS = 1 << 48


class Encoder:
    """Ids of whole texts as the vocabulary's own library has them.

    The merge ranks of the file go into a faster encoder. Its way to cut pieces gives up on a run of very many blanks;
    such a text goes to the library itself.
    """

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        to_byte = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.fast = tiktoken.Encoding("byte level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_LOADED: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    begin("packing")
    keep("packing", _LOADED.clear)
    key = f"{len(vocabulary)} {zlib.crc32(vocabulary.encode())}"
    if key not in _LOADED:
        _LOADED[key] = Encoder(vocabulary)
    return _LOADED[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and before them what is left over."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every document (doc_id, piece, start, length, ids_crc32), with part, the task that made the piece,
    and nth, its number among the task's pieces of that length."""
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder, seen, part = _encoder(vocabulary.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        names, kinds = zip(*(c.split() for c in _PIECES.split(", ")), strict=True)
        types = {"long": pa.int64(), "int": pa.int32()}
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(encoder(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, t in enumerate(kinds)], list(names))
        release_memory()

    return text_rows(docs).mapInArrow(run, _PIECES)


def slots(packing: Packing) -> np.ndarray:
    """Where the pieces of each length go, by rank: rows (length * 2^48 + first rank, pieces a sequence, first sequence,
    offset of the first of them), sorted."""
    rows, taken, sequence = [], {}, 0
    for bins, contents in packing:
        offset = 0
        for size, times in contents:
            first = taken.get(size, 0)
            rows.append((size * _RANKS + first, times, sequence, offset))
            taken[size] = first + bins * times
            offset += size * times
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, nodes: int = NODES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text (a null text: of an empty one) and ``end``. Documents of over ``capacity``
    tokens are cut into pieces of ``capacity``, the first piece the shorter one. sequence_id counts from 0; the pieces of
    a sequence stand without a gap from offset 0. Every row is a document of its own: rows that repeat, or have no
    doc_id, are packed like others; an empty table gives no rows; other columns are ignored. Pieces of equal length
    change places freely, so which of them gets which sequence depends on how the input is split.

    Texts are read once and only short rows are written. Ranks come from counts by task and length, so a length that a
    third of all pieces have is ranked and placed where its pieces are.
    """
    rows = stage(token_pieces(docs, path, capacity, end))
    counts = stage(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for size, n in counts.groupBy("length").agg(F.sum("n")).collect():  # as many rows as a sequence has tokens at most
        histogram[size] = n
    table = docs.sparkSession.sparkContext.broadcast(slots(pack(histogram, capacity, nodes)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        plan = table.value
        for b in batches:
            if not b.num_rows:
                continue
            key = np.asarray(b.column("length")) * _RANKS + np.asarray(b.column("rank"))
            first, times, sequence, offset = plan[np.searchsorted(plan[:, 0], key, "right") - 1].T
            sequences, inside = np.divmod(key - first, times)
            columns = [*b.columns[:5], pa.array(sequence + sequences), pa.array(offset + inside * np.asarray(b.column("length")))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PLACED.split(", ")])

    return ranked.mapInArrow(place, _PLACED)
