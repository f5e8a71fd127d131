"""Exact dedup and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from phredlens.llm import exact_dedup, simhash
from phredlens.llm.components import connected

SCHEMA = "doc_id long, text string, source string, keep_id string, fp string, sha string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", "clash", "clash") for i, t in rows], SCHEMA)


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    words = ["ab", "Cd", "ef", "ghé", "ij", "KL", "mn", "op"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    texts += [t.replace(" ", "\n\t ") for t in texts[:30]] + ["", None, "   ", "x" * 300_000, "one"]
    return list(enumerate(texts, 3))


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    return sorted((i, min(x for x in by[norm(t)]), len(by[norm(t)]), i == min(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("most", [1 << 28, 512])
def test_exact_matches_brute_force(spark, most):
    rows = corpus()
    got = exact_dedup.exact_duplicates(frame(spark, rows), max_filter_bits=most).collect()
    assert sorted(map(tuple, got)) == brute_exact(rows)


def test_slices_read_their_own_digests_one_bitmap_at_a_time(spark, monkeypatch):
    """Sixteen slices: each digest feeds one filter, the slice reaches the scan, and a bitmap is gone before the next."""
    rows, seen, live = corpus(), [], []
    bloom, flagged = exact_dedup.bloom, exact_dedup._flagged

    def counted(part, bits, twice):
        plan = part._jdf.queryExecution().executedPlan().toString()
        seen.append((part.count(), "EqualTo(slice," in plan))
        return bloom(part, bits, twice)

    def watched(*args):
        assert all(b._jbroadcast is not None and not b._jbroadcast.isValid() for b in live)
        out = flagged(*args)
        live.append(out[1])
        return out

    monkeypatch.setattr(exact_dedup, "bloom", counted)
    monkeypatch.setattr(exact_dedup, "_flagged", watched)
    docs = frame(spark, rows).repartition(7)
    got = exact_dedup.exact_duplicates(docs, max_filter_bits=len(rows))  # 16 bits a row
    assert sorted(map(tuple, got.collect())) == brute_exact(rows)
    assert len(seen) == 16 and sum(n for n, _ in seen) == len(rows) and max(n for n, _ in seen) < len(rows) / 4
    assert all(pushed for _, pushed in seen)


def test_exact_edge_cases(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b")])).collect()}
    assert got == {(1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)}


def test_exact_drop_keeps_columns_and_first_copies(spark):
    rows = corpus()
    docs = frame(spark, rows)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in brute_exact(rows) if x[3])


def spelled(rows):
    return sorted(rows, key=str)


#: One doc_id over different texts, texts without a doc_id, and rows that repeat.
AWKWARD = [(1, "same text"), (5, "same text"), (5, "a text found nowhere else"), (None, "same text"), (None, "alone without an id"), (None, "two  of these"), (None, "two of these"), (7, "twice the same row"), (7, "twice the same row"), (None, None), (None, ""), (9, None)]


def test_exact_drop_decides_by_row(spark, monkeypatch):
    from phredlens.llm import tables

    want = [(1, "same text"), (5, "a text found nowhere else"), (None, "alone without an id"), (7, "twice the same row"), (9, None)]
    for most in (tables.MAX_FILTER_BITS, 6):
        monkeypatch.setattr(tables, "MAX_FILTER_BITS", most)  # 6: no filter holds the keys
        for parts in (1, 5):
            got = [(r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(frame(spark, AWKWARD).repartition(parts)).collect()]
            assert spelled([r for r in got if r[1] not in ("two  of these", "two of these")]) == spelled(want)
            assert len([r for r in got if r[1] in ("two  of these", "two of these")]) == 1 and len(got) == 6


def test_near_drop_decides_by_row(spark):
    got = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(frame(spark, AWKWARD)).collect()]
    fixed = [(1, "same text"), (5, "a text found nowhere else"), (None, "alone without an id"), (7, "twice the same row"), (9, None)]
    assert len(got) == 6 and set(fixed) <= set(got) and {t for _, t in got} - {t for _, t in fixed} <= {"two  of these", "two of these"}


def test_drops_keep_rows_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, True, 9), (2, "a b", 6, False, 9), (3, "c", 7, True, 9)], "doc_id long, text string, n long, once boolean, fp long")
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        got = drop(docs)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "a b", 5, True, 9), (3, "c", 7, True, 9)]


def test_bitmaps_are_marked_in_place():
    """The work and the memory of a batch follow its rows, not the bitmap."""
    import tracemalloc

    from phredlens.llm import tables

    bits = 1 << 28
    rng = np.random.default_rng(1)
    once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    halves = [rng.integers(0, 1 << 63, 10_000).astype(np.uint64) for _ in range(2)]
    tracemalloc.start()
    tables.mark(once, again, tables._positions(*halves, bits))
    tables.mark(once, again, tables._positions(*(h[:500] for h in halves), bits))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    assert tables.in_bloom(once, *halves).all()
    second = tables.in_bloom(again, *halves)
    assert second[:500].all() and second[500:].mean() < 0.01
    assert not len(tables.in_bloom(once, *(h[:0] for h in halves)))


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and bin(prints[i] ^ prints[j]).count("1") <= radius:
                    label[i] = label[j]
                    changed = True
    return label


def test_simhash_matches_brute_force(spark):
    rows = corpus(n=60)
    base = " ".join(f"w{i}" for i in range(400))
    rows += [(1000 + k, base.replace(f"w{k * 7} ", f"v{k} ")) for k in range(12)]
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len({c for i, (_, c) in got.items() if i >= 1000}) < 12
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == set(want.values())


def test_simhash_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_covering_code_covers_every_pair():
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 31 and all(28 <= m.bit_count() <= 36 for m in masks)
    rng = random.Random(1)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & x == 0 for m in masks)


@pytest.mark.parametrize("bucket", [4, 1024])
def test_full_buckets_lose_no_link(spark, bucket):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(60)})
    prints = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    labels = {r.node: r.label for r in connected(simhash.fingerprint_links(prints, bucket=bucket)).collect()}
    want = brute_components({v: v for v in values})
    groups = lambda label: {frozenset(x for x in values if label(x) == g) for g in {label(v) for v in values}}
    assert groups(lambda v: labels.get(simhash._signed(v), simhash._signed(v))) == groups(want.get)


def test_cube_equals_direct_comparison():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 16, 2500).astype(np.uint64))
    cube = simhash.bucket_links(values, 1)
    direct = brute_components({int(v): int(v) for v in values[:0]}) or None
    assert direct is None
    label = {int(v): int(v) for v in values}
    find = lambda x: x if label[x] == x else find(label[x])
    for a in label:
        for b in range(16):
            if (c := a ^ (1 << b)) in label and find(a) != find(c):
                label[max(find(a), find(c))] = min(find(a), find(c))
    root = {a: find(a) for a in label}
    assert {a: b for a, b in cube} == {a: r for a, r in root.items() if a != r}


@pytest.mark.parametrize("heavy", [1, 1_000_000])
def test_hot_and_cold_groups_give_the_same_rows(spark, monkeypatch, heavy):
    from phredlens.llm import tables

    monkeypatch.setattr(tables, "HEAVY_GROUPS", heavy)
    rows = [(i, "same text" if i % 3 else f"text {i // 9}") for i in range(200)]
    assert sorted(map(tuple, exact_dedup.exact_duplicates(frame(spark, rows)).collect())) == brute_exact(rows)


def test_components_of_a_path_in_few_rounds(spark, monkeypatch):
    from phredlens.llm import components

    rounds, own = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df: rounds.append(1) or own(df))
    path = [0, *range(1024, 0, -1)]
    got = connected(spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")).collect()
    assert {r.node for r in got} == set(path) and {r.label for r in got} == {0}
    assert len(rounds) <= 15
    assert connected(spark.createDataFrame([(None, 1), (4, 4), (4, 4)], "a long, b long")).collect() == [(4, 4)]


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 150)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5000, 5001)]
    got = {r.node: r.label for r in connected(spark.createDataFrame([(b, a) for a, b in links], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(151)} | {1000 + k: 1000 for k in range(60)} | {5000: 5000, 5001: 5000}
