"""The backtracking encoder against the tokenizers library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from phredlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return bpe.ByteBPE(f.read()), Tokenizer.from_file(PATH)


def texts(n=1500, seed=11):
    rng = random.Random(seed)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aab", " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​᠎", "ÄÖüßéñçœ", "0123456789²½٣", "'sdmtrvel ", "日本語😀👩‍👩‍👧", "!?-_*#%&=|", "\x00\x01�́"]
    out = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "  x  ", "Don't they'll", "a" * 5000, " " * 999, "ab" * 3000]
    for _ in range(n):
        out.append("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 60))))
    return out


def test_ids_and_text_equal_the_library(both):
    ours, library = both
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids = ours.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, repr(text)
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False), repr(text)


def test_documents_equal_the_library(both, spark, sf_dir):
    _, library = both
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_edge_cases_and_round_trip(both, spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "naïve\x00 text", "x"), (4, "long " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_memory_of_pieces_stays_bounded(both, monkeypatch):
    ours, library = both
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    text = " ".join(f"w{i}x" for i in range(200))
    assert list(memoryview(ours.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids
    assert len(ours.known) <= 11


def test_tables_go_when_another_operator_begins():
    from types import SimpleNamespace

    from phredlens.llm import bpe, tables

    vocabulary = SimpleNamespace(value=open(PATH, encoding="utf-8").read())
    one = bpe._loaded(vocabulary)
    assert bpe._loaded(vocabulary) is one and bpe._LOADED
    tables.begin("another")
    assert not bpe._LOADED and bpe._loaded(vocabulary) is not one
