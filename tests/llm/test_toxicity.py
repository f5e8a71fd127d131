"""The recurrent network: gradients, windows, held-out accuracy."""

import zlib

import numpy as np
import pytest

from phredlens.llm import toxicity as tox
from phredlens.llm.tables import table


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = tox.Network.fresh({b"a": 1}, dtype=np.float64)
    x = rng.standard_normal((6, 5, 6 * tox.HIDDEN))
    mask = np.arange(6)[:, None] < np.array([6, 3, 1, 5, 6])
    y, w = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 1, 0.5])
    _, g, d_x = net.gradients(x, mask, y, w)

    def loss():
        z = net.forward(x, mask)
        return (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum()

    for name, grad in [*g.items(), ("x", d_x)]:
        target = x if name == "x" else net.p[name]
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in target.shape)
            old = target[at]
            target[at] = old + 1e-5
            up = loss()
            target[at] = old - 1e-5
            down = loss()
            target[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-7), name


def test_windows_overlap_and_cover():
    for n in range(400):
        starts = list(tox.window_starts(n))
        assert all(b - a < tox.WINDOW for a, b in zip(starts, starts[1:], strict=False))
        assert starts[-1] + tox.WINDOW >= n and (len(starts) == 1 or starts[-1] + tox.WINDOW - tox.STRIDE < n)


def test_scores_equal_window_by_window_brute_force():
    net = tox.Network.fresh({b"alpha": 1, b"beta": 2})
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["Alpha", "beta", "gam-ma", "ΔΕΛ", "x"], n)) for n in (0, 1, 31, 32, 33, 200)] + [None]
    got = tox.Scorer(net).scores(texts)
    for text, score in zip(texts, got, strict=True):
        words = tox.tokens(text)
        worst = -np.inf
        for s in tox.window_starts(len(words)):
            part = words[s : s + tox.WINDOW]
            x = np.zeros((max(1, len(part)), 1, 6 * tox.HIDDEN), np.float32)
            for t, w in enumerate(part):
                x[t, 0] = net.inputs(np.array([net.words.get(w, 0)]), *tox.char_features([w])) @ net.p["wx"] + net.p["b"]
            worst = max(worst, float(net.forward(x, np.ones(x.shape[:2], bool))[0]))
        assert score == pytest.approx(1 / (1 + np.exp(-worst)), abs=1e-5)


def test_remembered_words_stay_bounded(monkeypatch):
    net = tox.Network.fresh({b"alpha": 1})
    texts = [" ".join(f"w{i}" for i in range(k, k + 60)) for k in range(0, 900, 50)]
    whole = tox.Scorer(net).scores(texts)
    monkeypatch.setattr(tox, "_REMEMBERED", 100)
    small = tox.Scorer(net)
    assert np.allclose(np.concatenate([small.scores([t]) for t in texts]), whole, atol=1e-5)
    assert len(small.rows) <= 100


def test_training_without_both_labels():
    assert tox.Scorer(tox.train([], [])).scores(["a", None])[0] < 0.5
    assert tox.Scorer(tox.train(["a b"], [1])).scores(["a"])[0] > 0.5


def test_held_out_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    net = tox.learn(docs, labels)
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = {r.doc_id: r for r in tox.toxicity(known, net).collect()}
    assert len(rows) == labels.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    truth = {r.doc_id: r.toxic for r in labels.collect() if rows[r.doc_id].held_out}
    caught = {k: sum(rows[i].predicted == 1 for i, t in truth.items() if t == k) for k in (0, 1)}
    toxic = sum(truth.values())
    assert caught[1] >= 0.85 * toxic  # recall
    assert caught[1] >= 0.9 * (caught[0] + caught[1])  # precision
    assert caught[0] <= 0.015 * (len(truth) - toxic)


def test_all_bytes_of_a_long_word_are_read():
    word = "ab" * 30
    assert b"".join(tox.words_of(f"x {word}y")) == f"x{word}y".encode() and max(map(len, tox.words_of(word))) == tox.LONGEST
    net = tox.Network.fresh({b"alpha": 1})
    one, two = tox.Scorer(net).scores([word + "c" * 20, word + "d" * 20])
    assert one != two


def test_rows_are_dropped_by_their_own_text(spark):
    net = tox.train(["bad awful words"] * 40 + ["kind good words"] * 40, [1] * 40 + [0] * 40)
    rows = [(1, "bad awful words"), (1, "kind good words"), (None, "bad awful words"), (None, "kind good words"), (3, None)]
    kept = tox.drop_toxic(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_samples_are_bounded(spark):
    from phredlens.llm.tables import few_texts

    docs = spark.createDataFrame([(1, "same")] * 500 + [(k, "x" * k) for k in range(2, 60)], "doc_id long, text string")
    assert len(few_texts(docs, 10)) == 10 and len(few_texts(docs, 1000)) == 59
    assert all(len(t) <= 20 for _, t in few_texts(docs, 1000, longest=20))
    few = few_texts(docs, 1000, max_bytes=300)
    assert sum(len(t) for _, t in few) <= 300 and few == few_texts(docs.repartition(5), 1000, max_bytes=300)


def test_edge_cases(spark):
    net = tox.Network.fresh({b"bad": 1})
    docs = spark.createDataFrame([(1, None, 5.0), (1, None, 5.0), (None, "", 5.0), (3, "bad " * 60_000, 5.0)], "doc_id long, text string, score double")
    rows = tox.toxicity(docs, net).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and {r.n_windows for r in rows} == {1, 2500}
    assert tox.toxicity(docs.limit(0), net).count() == 0
    kept = tox.drop_toxic(docs, tox.train(["x"], [0]))
    assert kept.columns == docs.columns and kept.count() == 4
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert tox.learn(docs, labels).words == {}
