"""The corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

from phredlens.llm.bpe import round_trip
from phredlens.llm.decontaminate import drop_contaminated
from phredlens.llm.exact_dedup import drop_exact_duplicates
from phredlens.llm.queries import BPE_VOCABULARY
from phredlens.llm.simhash import drop_near_duplicates
from phredlens.llm.tables import stage, table, unstage
from phredlens.llm.toxicity import drop_toxic, learn


def toxicity(spark, docs, sf_dir):
    """Documents that the network rejects go; it learns from ``labels`` and ``documents`` of ``sf_dir``."""
    return drop_toxic(docs, learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def exact_dedup(spark, docs, sf_dir):
    """Of documents with equal text, the one with the smallest doc_id stays."""
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate component stays, the one with the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that overlap an item of ``benchmark`` go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark, docs, sf_dir):
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids themselves, of every document left."""
    return round_trip(docs, BPE_VOCABULARY, keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-pair encoding", bpe),
]

#: Trained scores and fingerprints have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``. Every intermediate result is a Parquet table in the shared folder, deleted as soon
    as the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir))
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
