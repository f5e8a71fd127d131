"""The pipeline, stage by stage, against plain Python on whole small tables."""

import hashlib
import re
import struct

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from phredlens.llm import decontaminate as dec
from phredlens.llm import queries
from phredlens.llm import toxicity as tox
from phredlens.llm.substring_dedup import repeated_units
from phredlens.llm.tables import table
from tests.llm.test_dedup import brute_components, brute_exact, brute_print


def brute_contaminated(rows, items):
    """Documents with an allowed overlap on any diagonal, without seeds."""
    coded = {}
    number = lambda t: np.array([coded.setdefault(w, len(coded)) for w in dec.tokens(t)], np.uint64)
    items, out = [number(t) for t in items], set()
    for i, t in rows:
        text = number(t)
        for item in items:
            a, b = np.nonzero(text[:, None] == item[None, :])
            diagonals, n = np.unique(a - b, return_counts=True)
            if any(dec.best_overlap(text, item, int(d)) for d in diagonals[n >= min(dec.MIN_MATCHES, len(item))]):
                out.add(i)
                break
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir).cache()
        out.append((docs.columns, {r.doc_id: r for r in docs.collect()}))
    return out


def test_every_stage_equals_brute_force(spark, sf_dir, stages):
    source = table(spark, sf_dir, "documents")
    rows = sorted((r.doc_id, r.text) for r in source.collect())
    net = tox.learn(source, table(spark, sf_dir, "labels"))
    score = tox.Scorer(net).scores([t for _, t in rows])
    rows = [r for r, s in zip(rows, score, strict=True) if s < 0.5]
    assert set(stages[0][1]) == {i for i, _ in rows}
    kept = {x[0] for x in brute_exact(rows) if x[3]}
    rows = [r for r in rows if r[0] in kept]
    assert set(stages[1][1]) == kept
    label = brute_components({i: brute_print(t) for i, t in rows})
    rows = [r for r in rows if label[r[0]] == r[0]]
    assert set(stages[2][1]) == {i for i, _ in rows}
    bad = brute_contaminated(rows, [r.text for r in table(spark, sf_dir, "benchmark").collect()])
    rows = [r for r in rows if r[0] not in bad]
    assert set(stages[3][1]) == {i for i, _ in rows}
    library = Tokenizer.from_file(queries.BPE_VOCABULARY)
    assert set(stages[4][1]) == {i for i, _ in rows}
    for i, t in rows:
        ids, last = library.encode(t, add_special_tokens=False).ids, stages[4][1][i]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (bytes(last.ids), last.n_tokens, last.ids_sha256) == (packed, len(ids), hashlib.sha256(packed).hexdigest())


def test_stages_keep_columns_and_texts(spark, sf_dir, stages):
    source = table(spark, sf_dir, "documents")
    texts = {r.doc_id: tuple(r) for r in source.collect()}
    for columns, rows in stages[:-1]:
        assert columns == source.columns
        assert all(tuple(r) == texts[i] for i, r in rows.items())


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == stages[-1][1]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)


def test_sql_of_units_with_control_characters(spark):
    line = "one two three\x01four five. six seven\x02a eight nine ten"
    rows = [(1, f"{line}\nx"), (2, line), (3, f"a {line}")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = repeated_units(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    want = con.sql(queries.ORACLES["op6_substring_dedup"].replace("n_words >= 8", "n_words >= 5"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) and got.count() == 2


def test_registered_queries():
    assert [m[1] for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))] == [str(k) for k in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
