"""The Pitman-Yor model: base scores by brute force, proper probabilities, seating by its exact distribution."""

import itertools
import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from phredlens.llm import pitman_yor as py
from phredlens.sources import staging


def corpus(n=200, seed=3):
    rng = np.random.default_rng(seed)
    words = np.array([f"W{i}" for i in range(300)] + ["the", "of", "é", "a.b"])
    weight = 1 / (1 + np.arange(len(words))[::-1])
    texts = [" \n".join(rng.choice(words, int(rng.integers(0, 40)), p=weight / weight.sum())) for _ in range(n)]
    return [*enumerate(texts), (900, None), (901, ""), (902, "solo " * 30_000)]


def brute_base(rows):
    train, out = Counter(), {}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*(t or "").lower().split(), "\n"] for i, t in rows}
    for i, _ in rows:
        if not held[i]:
            train.update(tokens[i])
    total, kinds = sum(train.values()), len(train)
    for i, _ in rows:
        out[i] = (held[i], len(tokens[i]), sum(w in train for w in tokens[i]), total, sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in tokens[i]))
    return out


@pytest.mark.parametrize("spread", [py.SPREAD, 16])
def test_base_score_and_counts_match_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(py, "CHUNK_TOKENS", 500)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in py.language_model_scores(docs, spread=spread).collect()}
    want = brute_base(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6, rel=1e-9) and r.score < 0
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def brute_scores(rows, sweeps=py.SWEEPS, burn_in=py.BURN_IN):
    """The model over plain dictionaries of pairs, with no buckets and no messages; only the draws are shared."""
    key = {}
    tokens, pairs = Counter(), Counter()
    texts = {i: [py.START, *(t or "").lower().encode().split(), b"\n"] for i, t in rows}
    for i, words in texts.items():
        key.update((w, py.word_key(w)) for w in words)
        if zlib.crc32(str(i).encode()) % 7 != 2:
            tokens.update(words[1:])
            pairs.update(itertools.pairwise(words))
    dishes, kinds, contexts = sorted(pairs), sorted(tokens), sorted({u for u, _ in pairs})
    keys = lambda words: np.array([key[w] for w in words], np.uint64)
    c = np.array([pairs[p] for p in dishes])
    t = np.minimum(c, 1)
    per_context = lambda values: dict(sum((Counter({u: int(v)}) for (u, _), v in zip(dishes, values, strict=True)), Counter()))
    in_context = per_context(c)

    def seats(values):
        own = dict.fromkeys(kinds, 0)
        for (_, w), v in zip(dishes, values, strict=True):
            own[w] += int(v)
        return np.array([own[w] for w in kinds])

    discount = lambda x: min(0.95, max(0.05, (x == 1).sum() / ((x == 1).sum() + 2 * (x == 2).sum())))
    cw = seats(t)
    d, d0 = discount(c), discount(cw)
    tw, v = np.minimum(cw, 1), len(kinds)
    totals = dict.fromkeys(texts, 0.0)
    chance: dict = {}
    one = lambda k, shape: py.Draws(np.zeros(1, np.uint64), k).gamma(np.array([shape]))[0]
    size0 = one(0, 1 / d0 + tw.sum())
    for k in range(1, sweeps + 1):
        parent = lambda: dict(zip(kinds, (np.maximum(0, cw - d0 * tw) + (1 + d0 * tw.sum()) * 0.5 / v) / (1 + cw.sum()), strict=True))  # noqa: B023, E731
        p, tables = parent(), per_context(t)
        size = dict(zip(contexts, d * py.Draws(py.context_key(keys(contexts)), k).gamma(1 / d + np.array([tables[u] for u in contexts])), strict=True))
        dish_keys = py.pair_key(py.context_key(keys([u for u, _ in dishes])), keys([w for _, w in dishes]))
        t = py.drawn_tables(c, np.array([size[u] * p[w] for u, w in dishes]), d, py.Draws(dish_keys, k)).astype(int)
        cw = seats(t)
        tw = py.drawn_tables(cw, np.full(v, d0 * size0 * 0.5 / v), d0, py.Draws(keys(kinds), k)).astype(int)
        size0 = one(k, 1 / d0 + tw.sum())
        if k > burn_in:
            p, tables, seated = parent(), per_context(t), dict(zip(dishes, t, strict=True))
            unknown = (1 + d0 * tw.sum()) * 0.5 / (1 + cw.sum())
            for u, w in {x for words in texts.values() for x in itertools.pairwise(words)}:
                own = max(0, pairs[u, w] - d * seated.get((u, w), 0))
                now = (own + (1 + d * tables.get(u, 0)) * p.get(w, unknown)) / (1 + in_context.get(u, 0))
                chance[u, w] = chance.get((u, w), 0) + now / (sweeps - burn_in)
    for i, words in texts.items():
        totals[i] = sum(math.log10(chance[x]) for x in itertools.pairwise(words))
    return totals


def test_whole_scores_match_brute_force(spark, monkeypatch):
    rows = corpus(120)[:-1] + [(903, "the of " * 900)]
    want = brute_scores(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value, spread in (("CHUNK_TOKENS", 700, py.SPREAD), ("BUCKET_TOKENS", 150, 16), ("CHUNK_DOCS", 9, 2)):
        monkeypatch.setattr(py, name, value)
        got = {r.doc_id: r.score for r in py.language_model_scores(docs, spread=spread).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], abs=1e-6, rel=1e-9) for i in want)


def test_scores_depend_on_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen = [{r.doc_id: (r.score, r.base_score) for r in py.language_model_scores(docs.repartition(n), spread=spread).collect()} for n, spread in ((1, 8192), (7, 8192), (16, 300))]
    assert len(seen[0]) == docs.count() and seen[0] == seen[1] == seen[2]


def test_each_training_word_is_a_context(spark):
    """Words that stand once or twice tell what follows them, however rare they are among all tokens."""
    rng = np.random.default_rng(8)
    rare = [(f"rare{k}x", f"then{k}y") for k in range(300)]
    train = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 200)) + f" {rare[i % 300][0]} {rare[i % 300][1]}") for i in range(1200) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(5000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2][:200]
    right = [(i, " ".join(rare[k])) for k, i in enumerate(held[:100])]
    wrong = [(i, f"{rare[k][0]} {rare[k + 100][1]}") for k, i in enumerate(held[100:])]
    got = {r.doc_id: r.score for r in py.language_model_scores(spark.createDataFrame(train + right + wrong, "doc_id long, text string")).collect()}
    assert np.mean([got[i] for i, _ in right]) > np.mean([got[i] for i, _ in wrong]) + 1


def test_probabilities_after_any_context_sum_to_one():
    rng = np.random.default_rng(0)
    heads = np.array([], np.uint64)
    c, t = rng.integers(1, 9, 40), np.ones(40, int)
    totals = {"tokens": 500, "words": 40, "customers": 90, "tables": 44, "pair_ones": 30, "pair_twos": 10, "word_ones": 12, "word_twos": 6}
    state = py.State(heads, totals, np.zeros(0, int), np.zeros(0, int), None, 0)
    word_customers = rng.multinomial(50, np.ones(40) / 40) + 1
    word_tables = np.ones(40, int)
    word_tables[:4] += word_customers[:4] > 1
    state.root_customers, state.root_tables = word_customers.sum(), word_tables.sum()
    parent = state.parent(word_customers, word_tables)
    assert parent.sum() + state.unknown() == pytest.approx(1, abs=1e-9)
    p = state.predictive(c, t, c.sum(), t.sum(), parent)
    assert p.sum() + state.predictive(0, 0, c.sum(), t.sum(), state.unknown()) == pytest.approx(1, abs=1e-9)


def test_draws_have_their_distributions():
    draws = py.Draws(np.arange(100_000), 3)
    u = draws.uniform(np.arange(100_000), 0)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u, draws.uniform(np.arange(100_000), 1))[0, 1]) < 0.02
    for shape in (1.1, 5.0, 800.0):
        g = draws.gamma(np.full(100_000, shape))
        assert g.mean() == pytest.approx(shape, rel=0.02) and g.var() == pytest.approx(shape, rel=0.05)
    assert (draws.gamma(np.full(100_000, 2.0))[::7] == py.Draws(np.arange(100_000)[::7], 3).gamma(np.full(14_286, 2.0))).all()


def test_seating_follows_its_exact_distribution():
    a, d, n = 0.7, 0.4, 20_000
    tables = py.drawn_tables(np.full(n, 3), np.full(n, a), d, py.Draws(np.arange(n), 1))
    weight = np.array([a * (1 - d) * (2 - d), 3 * a * a * (1 - d), a**3])
    assert np.allclose(np.bincount(tables, minlength=4)[1:] / n, weight / weight.sum(), atol=0.015)


def test_a_restaurant_is_seated_as_customers_come_one_by_one():
    """Tables of a whole restaurant under a fixed parent: sizes and dishes drawn in turn, against the seating process."""
    rng, strength, d = np.random.default_rng(6), py.STRENGTH, 0.5
    parent, c = np.array([0.5, 0.3, 0.2]), np.array([30, 12, 3])
    n = 3000
    tables = np.ones((n, 3), int)
    for sweep in range(1, 25):
        size = d * py.Draws(np.arange(n), sweep).gamma(strength / d + tables.sum(axis=1))
        for j in range(3):
            tables[:, j] = py.drawn_tables(np.full(n, c[j]), size * parent[j], d, py.Draws(np.arange(n) * 3 + j, sweep))
    # Exact: weight of (t1, t2, t3) is the product of parent ** t and the Stirling numbers, times the rising strength.
    log = py.log_stirling(d)
    grid = np.stack(np.meshgrid(*(np.arange(1, x + 1) for x in c), indexing="ij"), -1).reshape(-1, 3)
    weight = sum(log[x, grid[:, j]] + grid[:, j] * np.log(parent[j]) for j, x in enumerate(c))
    rising = np.cumsum(np.log(strength + d * np.arange(c.sum())))
    weight = np.exp(weight + rising[grid.sum(axis=1) - 1] - (weight + rising[grid.sum(axis=1) - 1]).max())
    want = (grid * (weight / weight.sum())[:, None]).sum(axis=0)
    assert rng is not None and np.allclose(tables.mean(axis=0), want, rtol=0.02)


@pytest.mark.parametrize("c", [2, 13, 50, 60, 300, 800, 1000, 3000])
@pytest.mark.parametrize(("d", "a"), [(0.9, 1), (0.9, 20), (0.75, 5), (0.3, 40), (0.5, 1000), (0.8, 0.7)])
def test_many_customers_follow_their_exact_distribution(c, d, a):
    n = 4000
    log = np.arange(1, c + 1) * math.log(a) + py.log_stirling(d, c)[c, 1:]
    p = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
    mean = (p * np.arange(1, c + 1)).sum()
    deviation = math.sqrt((p * (np.arange(1, c + 1) - mean) ** 2).sum())
    tables = py.drawn_tables(np.full(n, c), np.full(n, float(a)), d, py.Draws(np.arange(n), 7))
    assert tables.mean() == pytest.approx(mean, abs=5 * deviation / math.sqrt(n) + 1e-6)
    got = np.bincount(tables, minlength=c + 1)[1:] / n
    assert np.abs(np.cumsum(got) - np.cumsum(p)).max() < 0.04


def test_the_weights_of_stirling_numbers_are_right():
    d, a = 0.4, 0.7
    weight = np.array([a * (1 - d) * (2 - d), 3 * a * a * (1 - d), a**3])
    assert np.allclose(np.exp(py.log_stirling(d)[3, 1:4]) * a ** np.arange(1, 4), weight)


def test_tables_stay_within_bounds():
    customers = np.array([0, 1, 2, 7, 12, 13, 500, 100_000])
    for a in (1e-9, 0.5, 1e6):
        tables = py.drawn_tables(customers, np.full(len(customers), a), 0.5, py.Draws(np.arange(len(customers)), 2))
        assert (tables >= np.minimum(customers, 1)).all() and (tables <= customers).all()


def test_dealt_out_words_have_a_bound_and_are_complete(spark, monkeypatch):
    monkeypatch.setattr(py, "_REMEMBERED", 20)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("held_out", py.held_out())
    heads, every = py.frequent_words(docs.select("doc_id", "text", "held_out"), 16)
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in py.words_of(t))
    assert every == sum(len(py.words_of(t)) for _, t in rows)
    assert len(heads) <= 16 and {py.word_key(w) for w, c in train.items() if c >= 2 * sum(train.values()) / 16} <= set(heads.tolist())


def test_texts_of_very_many_words(monkeypatch):
    """A chunk with more words than a sort code holds gives the same blobs."""
    rng = np.random.default_rng(2)
    key = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    words, doc = rng.integers(1, 500, 3000), np.sort(rng.integers(0, 40, 3000))
    args = key, words, np.append(0, words[:-1]), doc, np.sort(key[:9]), 5
    one = list(py.chunk_blobs(*args))
    monkeypatch.setattr(py, "_CONTEXT", 8)
    assert [(b, py.unpacked(x)) for b, x in py.chunk_blobs(*args)].__repr__() == [(b, py.unpacked(x)) for b, x in one].__repr__() and len(one) == 5


def test_clashing_columns_are_ignored(spark):
    rows = corpus(20)
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    wide = plain.selectExpr("*", "'x' bucket", "1 held_out", "2 score", "'y' context", "3 chunk", "'z' blob")
    assert {tuple(r) for r in py.language_model_scores(wide).collect()} == {tuple(r) for r in py.language_model_scores(plain).collect()}


@pytest.mark.parametrize("at", [1, 2])
def test_a_failed_run_leaves_no_table(spark, monkeypatch, at):
    folder = Path(staging.shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before, calls, added = {*folder.rglob("table-*")}, [], py.added

    def failing(*args):
        calls.append(args)
        if len(calls) > at:
            raise RuntimeError("planned")
        return added(*args)

    monkeypatch.setattr(py, "added", failing)
    with pytest.raises(RuntimeError, match="planned"):
        py.language_model_scores(spark.createDataFrame(corpus(20), "doc_id long, text string"))
    assert len(calls) == at + 1 and not [t.name for t in spark.catalog.listTables() if t.name.startswith("phredlens_")]
    assert {*folder.rglob("table-*")} == before


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (3, None)], "doc_id long, text string")
    rows = py.language_model_scores(docs).collect()
    assert len(rows) == 4 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert len({r.score for r in rows if r.n_tokens == 3}) == 1
    assert py.language_model_scores(docs.limit(0)).count() == 0
    alone = py.language_model_scores(docs.where("doc_id = 1").selectExpr("cast(10 as long) doc_id", "text")).collect()
    assert [r.held_out for r in alone] == [True, True] if zlib.crc32(b"10") % 7 == 2 else [False, False]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    lone = py.language_model_scores(spark.createDataFrame([(held, "x y")], "doc_id long, text string")).collect()[0]
    assert (lone.n_known, lone.train_tokens) == (0, 0) and math.isfinite(lone.score)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("phredlens_")]
