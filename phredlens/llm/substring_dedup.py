"""Substring dedup by hashing lines and the sentences in them: of equal units the earliest ranked one stays, the rest
are removed by offset.

Passages are often pasted into a longer line, so a line of several sentences is hashed whole and by sentence. Lines and
sentences share one digest space; a sentence of a line that is removed whole isn't listed again.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phredlens.llm.tables import KEYS, _left_by_size, attach_groups, begin, maybe_in, release_memory, row_keys, stage, text_rows

#: Shorter sentences are no units of their own.
MIN_WORDS = 8
#: Shorter lines are no units: every line that isn't blank is one.
LINE_WORDS = 1
_SENTENCE_END = re.compile(r"([.!?])[ \t]")


def _unit(text: str, start: int, min_words: int):
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if len(words) >= min_words:
        return start, start + len(text), len(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return None


def line_units(text: str | None, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS):
    """(line, level, start, stop, n_words, digest) of each line of ``line_words`` words or more (1: every line that isn't
    blank), and of each sentence of such a line that has several, with ``min_words`` words or more.

    line counts from 0; start and stop are code points of the original text, without the line break or the blank that
    follows; the digest is of the unit in lower case with whitespace runs made one space and trimmed.
    """
    start = 0
    for number, line in enumerate((text or "").split("\n")):
        if unit := _unit(line, start, line_words):
            yield number, "line", *unit
            cuts = [m.end(1) for m in _SENTENCE_END.finditer(line)]
            for a, z in zip([0, *(c + 1 for c in cuts)], [*cuts, len(line)], strict=True) if cuts else ():
                if unit := _unit(line[a:z], start + a, min_words):
                    yield number, "sentence", *unit
        start += len(line) + 1


def units(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """The units of each row of ``docs`` with its doc_id and key, and row, a number of its own for each row of ``docs``."""
    schema = f"row long, doc_id long, line long, level string, start long, stop long, n_words long, digest binary, {KEYS[0]} long, {KEYS[1]} long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        begin()
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            rows: list[tuple] = []
            for i, text, *key in zip(b.column("doc_id").to_pylist(), b.column("text"), *(b.column(k).to_pylist() for k in KEYS), strict=True):
                rows += [(number, i, *u, *key) for u in line_units(text.as_py(), min_words, line_words)]
                number += 1
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return text_rows(docs, *row_keys()).mapInArrow(run, schema)


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS, keep_keys: bool = False) -> DataFrame:
    """One row per unit to remove: doc_id, line, level, start, stop, n_words, keep_doc_id, keep_start, n_copies.

    The rank of a unit is (doc_id, start), null doc_ids last; the lowest rank of equal units stays and its place is
    keep_doc_id, keep_start. n_copies counts all equal units. Null and empty texts have no units; rows that repeat a
    doc_id and text have units of equal rank, of which none is removed for the other; an empty table gives no rows;
    other columns are ignored. ``keep_keys`` adds the key of the unit's row.
    """
    rows = stage(units(docs, min_words, line_words))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start")
    groups = stage(rows.groupBy("digest").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1"))
    joined = attach_groups(rows, groups, "digest", "n_copies", rows.count())
    moved = ~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("start") == F.col("keep.start")))
    # Whole lines stand above their sentences; a line's rows are few, as each row of docs counts for itself.
    whole = F.max(F.col("level") == "line").over(Window.partitionBy("row", "line"))
    top = joined.where(moved).withColumn("whole", whole).where((F.col("level") == "line") | ~F.col("whole"))
    return top.select("doc_id", "line", "level", "start", "stop", "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "n_copies", *(KEYS if keep_keys else ()))


def without_repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` (all its columns) with repeated units cut out of ``text``; the line break or blank after one goes too.

    A row's spans are found by its own key (doc_id and text), so rows that share a doc_id, or have none, are cut each
    by its own spans; a row's spans are as many as its units. Only rows that may lose a unit are shuffled (a Bloom
    filter over their keys tells), so clean ones keep their place.
    """
    spans = repeated_units(docs, min_words, line_words, keep_keys=True).groupBy(*KEYS)
    cuts = stage(spans.agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__phl_cuts"), F.count(F.lit(1)).alias("__phl_n")))
    n, total = cuts.agg(F.count(F.lit(1)), F.coalesce(F.sum("__phl_n"), F.lit(0))).first()
    if not n:
        return docs
    maybe = maybe_in(cuts, n)
    keyed = docs.select("*", *row_keys()).withColumn("__phl_maybe", F.lit(True) if maybe is None else maybe(*row_keys()))
    hit = _left_by_size(keyed.where("__phl_maybe"), cuts, KEYS, "__phl_n", total)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, spans, strict=True):
            if text is not None and gone is not None:
                kept, at = [], 0
                for span in gone:
                    kept.append(text[at : span["start"]])
                    at = span["stop"] + 1
                text = "".join([*kept, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    hit = hit.withColumn("text", cut("text", "__phl_cuts"))
    return keyed.where("not __phl_maybe").select(*docs.columns).unionByName(hit.select(*docs.columns))
