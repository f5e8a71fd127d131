"""Source divergence against plain Python and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from phredlens.llm import queries
from phredlens.llm.divergence import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"


def brute(rows, least=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        whole = share(sum(groups.values(), Counter()))
        shares = {s: share(c) for s, c in groups.items()}
        for s, p in shares.items():
            pairs = [(o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for o, q in shares.items() if o != s]
            terms = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if groups[s][t] and p[t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "of", "größe", "GRÖSSE", "中文", "don't", "x1y", "É", "é", "a_b", "😀", "Ünder"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(rng.choice([None, 1, k]), rng.choice([" ", "\n", "-"]).join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "é", "", None])) for k in range(n)]
    return rows + [rows[0]] * 3 + [(5, None, "en", "silent"), (6, "one two", "xx", "only"), (7, "", "yy", "p"), (8, "rare", "yy", "q"), (9, "word " * 30_000, "en", "a")]


def got_of(spark, rows, **options):
    return sorted(map(tuple, source_divergence(spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA), **options).collect()))


def test_matches_plain_python(spark):
    rows = corpus()
    assert got_of(spark, rows) == brute(rows)
    assert got_of(spark, rows, min_docs=20, top_terms=2) == brute(rows, 20, 2)


def test_edge_tables(spark):
    assert got_of(spark, []) == []
    assert got_of(spark, [(1, None, None, None)]) == []
    assert got_of(spark, [(1, None, None, "a"), (1, "x", None, "b")]) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    from phredlens.llm.divergence import share

    frame = spark.createDataFrame([(10**15, 3 * 10**15, 7), (0, 10**15, 10**9), (5, 5, 0)], "c long, n long, v long")
    assert [r[0] for r in frame.select(share(F.col("c"), F.col("n"), F.col("v"))).collect()] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in ((10**15, 3 * 10**15, 7), (0, 10**15, 10**9), (5, 5, 0))]


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(corpus(3), "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op13_source_divergence", "op6_substring_dedup"):
        query = queries.QUERIES[name](spark, str(tmp_path))
        want = db.sql(f"SELECT {', '.join(query.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, query.collect()))) == sorted(map(str, want)), name


def test_common_counts_divide_as_longs(spark):
    from pyspark.sql import functions as F

    from phredlens.llm.divergence import LONG_COUNTS, share

    rows = [(c, c + 5, 3) for c in (0, 7, LONG_COUNTS - 1, LONG_COUNTS, LONG_COUNTS + 1)]
    frame = spark.createDataFrame(rows, "c long, n long, v long").coalesce(1)
    shares = frame.select(share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r[0] for r in shares.collect()] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]
    assert "CASE WHEN" in shares._jdf.queryExecution().analyzed().toString()
