"""Segmentation-marginalised unigrams against enumeration of all cuts."""

import itertools
import json
import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from phredlens.llm import language as lid

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def small():
    pieces = lid.Pieces(json.dumps({"model": {"vocab": {"ab": 0, "bc": 1, "Ġa": 2, "abc": 3, "cab": 4, "Ġ": 5}}}))
    rng = np.random.default_rng(0)
    probs = rng.random((len(pieces.names), 3))
    return pieces, probs / probs.sum(axis=0)


def cuts(word):
    for k in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), k):
            yield [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)]


def test_forward_sums_all_cuts(small):
    pieces, probs = small
    number = {x: k for k, x in enumerate(pieces.names)}
    words = [" abc", " a", " cabab", " abcabc", " zé"]
    words = [w.encode().decode("latin-1") for w in words]
    got = lid.log_probabilities(pieces, words, probs)
    for w, row in zip(words, got, strict=True):
        want = sum(np.prod([probs[number[p]] for p in c], axis=0) for c in cuts(w) if all(p in number for p in c))
        assert np.allclose(row, np.log(want))


def test_expected_counts_match_enumeration(small):
    pieces, probs = small
    number = {x: k for k, x in enumerate(pieces.names)}
    words, weights = [" abc", " cabab", " b"], np.array([[1.0, 0, 2], [3, 1, 0], [0, 0, 1]])
    want = np.zeros_like(probs)
    for w, n in zip(words, weights, strict=True):
        each = [(c, np.prod([probs[number[p]] for p in c], axis=0)) for c in cuts(w) if all(p in number for p in c)]
        whole = sum(p for _, p in each)
        for c, p in each:
            for x in c:
                want[number[x]] += n * p / whole
    assert np.allclose(lid.expected_counts(pieces, words, weights, probs), want)


def test_long_words_neither_vanish_nor_break(small):
    pieces, probs = small
    one, two = lid.log_probabilities(pieces, [" " + "ab" * 20, " " + "ab" * 2000], probs)
    assert np.isfinite(two).all() and (two < 50 * one).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in lid.languages(docs, PATH).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert rows.keys() == truth.keys()
    mine = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in mine) >= 0.95 * len(mine)


def test_edge_cases(spark):
    rows = [(1, "the house", "en", "x"), (2, "das Haus", "de", "x"), (3, None, "de", "x"), (4, "", None, "x"), (4, "12 ²", None, "x"), (None, "the", None, "x"), (6, "haus " * 50_000, None, "x"), (7, "a" * 20_000, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang_pred) for r in lid.languages(docs, PATH).collect()}
    assert {(3, "und"), (4, "und")} <= got and len(lid.languages(docs, PATH).collect()) == 8
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in lid.languages(docs, PATH).collect())
    assert lid.languages(docs.limit(0), PATH).count() == 0
    nothing = lid.languages(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false").unionByName(docs.selectExpr("doc_id", "text", "cast(null as string) lang", "score")), PATH)
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_long_words_teach_and_languages_have_no_cap(spark):
    vocabulary = open(PATH, encoding="utf-8").read()
    pieces = lid.Pieces(vocabulary)
    names, probs = lid.fit(pieces, ["q" * 400 + "zq" * 90, "b" * 400], ["qq", "bb"])
    model = lid.Identifier(vocabulary, names, probs)
    assert model.predict(["zqzqzqqqq" * 30, "bbbbb"])[0] == ["qq", "bb"]
    docs = spark.createDataFrame([(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} " * 30, f"l{k:03}") for k in range(700)], "doc_id long, text string, lang string")
    assert len(lid.learn(docs, vocabulary)[0]) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(700))
