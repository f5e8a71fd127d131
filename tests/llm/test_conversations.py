"""Conversation repair against a shortest path over single edits, whole and in chunks."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from phredlens.llm import conversations as con
from phredlens.llm import queries
from phredlens.llm import turn_grammar as grammar

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
_AFTER = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def space(x):
    return " " if x is None else str(x)


def cheapest(turns, faults):
    """(cost, audit, turns left): the least of all by cost, then audit, with one edit a step."""
    heap, seen = [(0, "", 0, "0", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(turns) and state in "0a":
            return cost, audit, out
        steps = [(2, "I", 0, c, (name, "")) for c, name in (("u", "user"), ("a", "assistant"))]
        if i < len(turns):
            _, role, text = turns[i]
            more = faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                steps += [(more, "K", 1, role[:1], (role, text))] + [(2 + more, "R", 1, c, (name, text)) for c, name in (("u", "user"), ("a", "assistant"))]
        for price, edit, moved, c, left in steps:
            if (state, c) in _AFTER:
                heapq.heappush(heap, (cost + price, audit + edit, i + moved, _AFTER[state, c], (*out, left)))


def brute(rows):
    damaged = {}
    for conv, turn, role, text in rows:
        held = damaged.setdefault(conv, [])
        role, text, kind = space(role), space(text), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, turns in damaged.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            there = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not there else "duplicate" if (role, text) in seen else "" if there[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, left = cheapest(turns, faults)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def corpus(seed=5, n=700):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "Über"]
    texts = ["Hi there.", "ok", "what?", " ", None, "", "Yes!", "a b c.", "x y\u00a0", "z. \t", "long. tail", "\n"]
    rows = [(rng.choice([None, *range(60)]) if rng.random() < 0.6 else 7, rng.choice([None, *range(14)]) if rng.random() < 0.9 else rng.randint(-9, 500), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    rows += [(200, i, rng.choice(["user", "assistant"]), f"text {i % 250}{rng.choice(['.', ''])}") for i in range(600)]
    return rows + [(300, 1, "user", "same."), (300, 1, "user", "same."), (301, None, None, None)]


def got_of(spark, rows, chunk=con.CHUNK):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    found = con.reports(con.repaired(con.damaged(frame), chunk)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("chunk", [con.CHUNK, 40, 3])
def test_matches_the_shortest_path_in_chunks_of_any_size(spark, chunk):
    rows = corpus()
    assert got_of(spark, rows, chunk) == brute(rows)


def test_a_conversation_of_most_rows_is_many_chunks(spark):
    """Two thirds of all rows are of one conversation; no piece has more turns than a chunk, and the pieces join up."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(2000)] + [(k, 0, "user", "Hi.") for k in range(2, 900)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = con.repaired(frame, chunk=100)
    sizes = pieces.where("conv_id = 1").selectExpr("size(turns) as n").collect()
    assert len(sizes) >= 20 and max(r.n for r in sizes) <= 101
    turns = con.repaired_turns(pieces).where("conv_id = 1").orderBy("part", "chunk", "nth").collect()
    assert [(r.role, r.text) for r in turns] == [r[2:] for r in rows[:2000]]
    report = con.reports(pieces).where("conv_id = 1").first()
    assert (report.cost, report.audit, report.gaps) == (0, "K" * 2000, 0)


def test_edge_tables(spark):
    assert got_of(spark, []) == {}
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got_of(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: nothing}
    for rows in ([(None, None, None, None)], [(1, 5, "user", "x" * 300_000 + "."), (1, 6, "assistant", "Fine.")]):
        assert got_of(spark, rows) == brute(rows)


def test_costs_across_turns_compose():
    rng = random.Random(2)
    for _ in range(50):
        codes = bytes(rng.choice(range(12)) for _ in range(rng.randint(0, 12)))
        cut = rng.randint(0, len(codes))
        a, b = (grammar.across(x) for x in (codes[:cut], codes[cut:]))
        joined = [min(a[4 * p + k] + b[4 * k + q] for k in range(4)) for p in range(4) for q in range(4)]
        assert [min(x, grammar.FAR) for x in joined] == grammar.across(codes)
        assert grammar.costs_before(codes)[0] == min(grammar.across(codes)[q] + grammar.END[q] for q in range(4))


@pytest.mark.parametrize(
    "roles,audit",
    [("", ""), ("ua", "KK"), ("sua", "KKK"), ("s", "D"), ("a", "IK"), ("u", "KI"), ("uu", "KR"), ("uaa", None), ("saas", None), ("tua", "DKK")],
)
def test_known_repairs(roles, audit):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    turns = [(k, names[r], f"Turn {k}.") for k, r in enumerate(roles)]
    codes, _ = con._faults(turns, [False] * len(turns))
    edits, state = grammar.walk(codes)
    told = "".join(edits) + grammar.LAST_EDITS[state]
    cost, want, left = cheapest(turns, [""] * len(turns))
    assert told == want and grammar.costs_before(codes)[0] == cost
    assert audit is None or told == audit
    assert tuple(grammar.rebuilt([t[1:] for t in turns], [*edits, grammar.LAST_EDITS[state]], grammar.START)) == left


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    rows = corpus(9, 300)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    query = queries.op12_conversation_repair(spark, str(tmp_path))
    want = db.sql(f"SELECT {', '.join(query.columns)} FROM ({queries.ORACLES['op12_conversation_repair']})").fetchall()
    assert sorted(map(str, map(tuple, query.collect()))) == sorted(map(str, want))
