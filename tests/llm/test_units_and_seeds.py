"""Line hashing and spaced seeds against brute force."""

import random

import numpy as np

from phredlens.llm import decontaminate as dec
from phredlens.llm import substring_dedup as sub

SCHEMA = "doc_id long, text string, unit string, item_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def lines_corpus(seed=1):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("aa Bb cé dd".split()) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    line = lambda: rng.choice(pool) + "".join(rng.choice([". ", "! ", ".\t", "."]) + rng.choice(pool) for _ in range(rng.choice([0, 0, 1, 3]))) + " " * rng.randint(0, 2)
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 9)))) for i in range(40)]
    return [*rows, (90, None), (91, ""), (92, "\n\n"), (93, "word " * 50_000), (94, "WORD " * 50_000)]


def brute_lines(rows, least=8, least_line=1):
    """All repeated units, then without the sentences of repeated lines."""
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        start = 0
        for number, line in enumerate((text or "").split("\n")):
            cuts = [0, *(k + 2 for k in range(len(line) - 1) if line[k] in ".!?" and line[k + 1] in " \t"), len(line) + 1]
            parts = [("line", 0, len(line))] + [("sentence", a, z - 1) for a, z in zip(cuts, cuts[1:], strict=False)] * (len(cuts) > 2)
            for level, a, z in parts:
                key = " ".join(line[a:z].lower().split())
                if len(key.split()) >= (least_line if level == "line" else least):
                    seen.setdefault(key, []).append((i, number, level, start + a, start + z, len(key.split())))
            start += len(line) + 1
    for places in seen.values():
        places.sort(key=lambda p: (p[0], p[3]))
        out += [(*p, places[0][0], places[0][3], len(places)) for p in places[1:]]
    whole = {r[:2] for r in out if r[2] == "line"}
    return sorted(r for r in out if r[2] == "line" or r[:2] not in whole)


def test_units_match_brute_force(spark):
    for seed in (1, 2):
        rows = lines_corpus(seed)
        got = sorted(map(tuple, sub.repeated_units(frame(spark, rows)).collect()))
        assert got == brute_lines(rows) and {r[2] for r in got} == {"line", "sentence"}


def test_units_are_cut_by_their_offsets(spark):
    rows = lines_corpus(2)
    want = dict(rows)
    for i, _, _, a, z, *_ in sorted(brute_lines(rows), key=lambda r: -r[3]):
        want[i] = want[i][:a] + want[i][z + 1 :]
    docs = frame(spark, rows)
    got = sub.without_repeated_units(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_short_lines_are_found(spark):
    rows = [(i, "Subscribe to our daily newsletter") for i in range(500)]
    assert sub.repeated_units(frame(spark, rows)).count() == 499
    rows = [(i, f"Skip to content\nunlike {i}\n\nHome") for i in range(20)]
    assert sub.repeated_units(frame(spark, rows), line_words=8).count() == 0
    got = sub.repeated_units(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.line, r.n_words, r.keep_doc_id, r.n_copies) for r in got) == sorted((i, line, n, 0, 20) for i in range(1, 20) for line, n in ((0, 3), (3, 1)))
    left = {r.doc_id: r.text for r in sub.without_repeated_units(frame(spark, rows)).collect()}
    assert left == {i: t if i == 0 else f"unlike {i}\n\n" for i, t in rows}


def test_lines_of_other_rows_hide_no_sentence(spark):
    words = lambda k: " ".join(f"w{k}x{n}" for n in range(9)) + "."
    line, sentence = words(0), words(1)
    for i in (None, 7):
        rows = [(1, line), (2, f"{sentence} {words(2)}"), (i, line), (i, f"{sentence} {words(3)}")]
        got = sub.repeated_units(frame(spark, rows)).collect()
        assert sorted((r.level, r.start, r.stop, r.keep_doc_id) for r in got if r.doc_id == i) == [("line", 0, len(line), 1), ("sentence", 0, len(sentence), 2)]


def test_passages_inside_lines_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n)) + "."
    passage = prose(60)
    rows = [(i, f"{prose(30)} {passage} {prose(20)}" if i % 3 == 0 else prose(80)) for i in range(30)]
    got = sub.repeated_units(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {i for i in range(30) if i % 3 == 0} - {0} and {r.keep_doc_id for r in got} == {0}
    for i in range(3, 30, 3):
        assert sum(r.n_words for r in got if r.doc_id == i) >= 50


def test_units_edge_cases(spark):
    assert sub.repeated_units(frame(spark, [])).count() == 0
    line = "one two three four five six seven eight nine ten"
    got = [tuple(r) for r in sub.repeated_units(frame(spark, [(None, line), (5, line), (5, line), (7, f"x\n{line.upper()}")])).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, "line", 0, len(line), 10, 5, 0, 4), (7, 1, "line", 2, 2 + len(line), 10, 5, 0, 4)], key=str)


def test_rows_are_cut_by_their_own_spans(spark):
    line, other = "one two three four five six seven eight nine", "a row of its own that has nothing to do with it"
    rows = [(1, line), (2, f"{line}\nand more"), (2, other), (None, f"x\n{line}"), (None, other[::-1]), (None, line), (None, None)]
    got = sub.without_repeated_units(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, line), (2, "and more"), (2, other), (None, "x\n"), (None, other[::-1]), (None, ""), (None, None)], key=str)


def test_control_characters_part_nothing(spark):
    line = "one two three four five six seven eight nine\x01ten. eleven\x02 twelve"
    assert [(level, a, z, n) for _, level, a, z, n, _ in sub.line_units(line)] == [("line", 0, len(line), 11), ("sentence", 0, line.index(" eleven"), 9)]
    got = sub.repeated_units(frame(spark, [(1, line), (2, line)])).collect()
    assert [(r.doc_id, r.level, r.start, r.stop) for r in got] == [(2, "line", 0, len(line))]


def planted(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(rng.randint(14, 60)))) for i in range(30)]
    docs, truth = [], set()
    for i in range(120):
        words = [word() for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            item, text = rng.choice(items)
            part = text.split()
            for k in range(rng.randint(1, 5), len(part), rng.randint(6, 9)):
                part[k] = word()
            at = rng.randint(0, len(words))
            words[at:at] = part
            truth.add((i, item))
        docs.append((i, " ".join(words)))
    return docs, items, truth


def test_substituted_passages_are_found_and_clean_documents_left(spark):
    docs, items, truth = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (400, dec.BLOCK_CHARS):
        got = dec.overlaps(frame(spark, docs), bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == truth
        assert all(r.identity >= 0.8 and r.n_matches >= 10 for r in got)
    kept = {r.doc_id for r in dec.drop_contaminated(frame(spark, docs), bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in truth}


def test_one_block_of_items_is_alive_at_a_time(spark, monkeypatch):
    """Five blocks: the broadcast of each is gone before the next is built, and staged tables but the result go."""
    docs, items, truth = planted(5)
    live, staged, dropped = [], [], []
    overlaps, stage, unstage = dec._overlaps, dec.stage, dec.unstage

    def watched(source, items, *rest):
        assert all(not b._jbroadcast.isValid() for b in live)
        live.append(items)
        return overlaps(source, items, *rest)

    monkeypatch.setattr(dec, "_overlaps", watched)
    monkeypatch.setattr(dec, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    monkeypatch.setattr(dec, "unstage", lambda *dfs: dropped.extend(dfs) or unstage(*dfs))
    bench = spark.createDataFrame(items, "item_id long, text string")
    most = sum(len(t) for _, t in items) // 5 + 1
    got = dec.overlaps(frame(spark, docs), bench, block_chars=most)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == truth
    assert len(live) >= 5 and not live[-1]._jbroadcast.isValid() and len(staged) == 2 and {id(d) for d in dropped} == {id(d) for d in staged}
    one = dec.overlaps(frame(spark, docs), bench)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))


def test_seed_hits_match_brute_force():
    docs, items, _ = planted(5)
    seeds = dec.Seeds(items)
    for _, text in docs[:40]:
        words = dec.tokens(text)
        want = {(k, p - q) for m in dec.MASKS for k, (_, t) in enumerate(items) for q in range(len(dec.tokens(t)) - len(m) + 1) for p in range(len(words) - len(m) + 1) if all(words[p + o] == dec.tokens(t)[q + o] for o in dec.mask_offsets(m))}
        got = {(int(a), int(b)) for a, b, _ in seeds.hits(dec.token_hashes(words))}
        assert got == want


def test_best_overlap_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        text, item = rng.integers(0, 2, 40).astype(np.uint64), rng.integers(0, 2, 25).astype(np.uint64)
        d = int(rng.integers(-10, 30))
        got = dec.best_overlap(text, item, d, 5, 0.8)
        same = [(p, int(text[p] == item[p - d])) for p in range(max(0, d), min(40, d + 25))]
        allowed = [same[a:z] for a in range(len(same)) for z in range(a + 1, len(same) + 1) if round(0.2 * sum(s for _, s in same[a:z]) - 0.8 * sum(1 - s for _, s in same[a:z]), 9) >= 0]
        longest = max(map(len, allowed), default=0)
        matches = [sum(s for _, s in x) for x in allowed if len(x) == longest]
        if got:
            assert got[2] in matches and got[2] >= 5 and 5 * got[2] >= 4 * got[1]
            assert int((text[got[0] : got[0] + got[1]] == item[got[0] - d : got[0] - d + got[1]]).sum()) == got[2]
        else:
            assert not matches or matches[0] < 5


def test_decontamination_edge_cases(spark):
    text = "a b c d e f g h i j k l"
    bench = spark.createDataFrame([(1, text), (2, None), (3, "")], "item_id long, text string")
    docs = frame(spark, [(1, text.upper()), (1, text), (None, text), (4, None), (5, ""), (6, "x " * 100_000 + text)])
    assert sorted((r.doc_id or 0, r.item_id, r.first_word) for r in dec.overlaps(docs, bench).collect()) == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (6, 1, 100_000)]
    assert dec.overlaps(docs.limit(0), bench).count() == 0
    assert dec.overlaps(docs, bench.limit(0)).count() == 0
    assert dec.drop_contaminated(docs, bench.limit(0)).count() == 6


def test_rows_are_dropped_by_their_own_text(spark):
    text = "a b c d e f g h i j k l"
    rows = [(1, "x " + text), (1, "another text of the same id"), (None, text), (None, "clean"), (3, None), (3, None)]
    for bench, block in (([(1, text)], 10), ([(1, text), (2, "m n o p q r s t u v w")], 10), ([(1, text), (2, None)], dec.BLOCK_CHARS)):
        kept = dec.drop_contaminated(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), block_chars=block)
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(rows[1:2] + rows[3:], key=str) and kept.columns == frame(spark, rows).columns


def test_repeated_words_cost_bounded_hits(monkeypatch):
    monkeypatch.setattr(dec, "_AT_ONCE", 1000)
    seeds = dec.Seeds([(7, "x " * 300), (8, "y " * 20 + "x " * 9)])
    import pyarrow as pa

    got = sorted(dec.found_in(seeds, pa.array(["x " * 3000, None, "z " * 50 + "x " * 200, "y y y y y y y y y y y"]), 10, 0.8))
    assert [(k, item, n, m) for k, item, _, n, m in got] == [(0, 0, 300, 300), (2, 0, 200, 200), (3, 1, 11, 11)]


def test_tokens_are_parted_by_any_blank():
    assert dec.tokens("Caf\u00e9\u00a0au\u3000lait\u2014\u00abd\u00e9j\u00e0\u00bb vu\u2026 O\u2019Neil") == [w.encode() for w in "caf\u00e9 au lait d\u00e9j\u00e0 vu o neil".split()]
    assert dec.tokens("\u4e00\u4e8c\u3002\u30ab") == [c.encode() for c in "\u4e00\u4e8c\u30ab"]


def test_overlaps_of_low_identity_are_found():
    """Recall of planted passages whose tokens were changed here and there, down to four in five alike."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    found = total = 0
    for k in range(300):
        item = rng.choices(words, k=50)
        part = list(item)
        for at in rng.sample(range(50), rng.randint(5, 9)):
            part[at] = "changed"
        text = " ".join(rng.choices(words, k=100) + part + rng.choices(words, k=100))
        import pyarrow as pa

        found += any(True for _ in dec.found_in(dec.Seeds([(k, " ".join(item))]), pa.array([text]), dec.MIN_MATCHES, dec.MIN_IDENTITY))
        total += 1
    assert found >= 0.99 * total


def test_items_of_few_tokens_are_found_whole(spark):
    bench = spark.createDataFrame([(1, "Forty-two!"), (2, "xylem"), (3, "a b c d"), (4, "a b"), (5, "...")], "item_id long, text string")
    docs = frame(spark, [(1, "it is forty two, yes forty two"), (2, "a b c, a b c d"), (3, "forty xylems two a c b"), (4, "Xylem")])
    got = {(r.doc_id, r.item_id, r.first_word, r.n_words, r.n_matches, r.identity) for r in dec.overlaps(docs, bench).collect()}
    assert got == {(1, 1, 2, 2, 2, 1.0), (2, 3, 3, 4, 4, 1.0), (2, 4, 0, 2, 2, 1.0), (4, 2, 0, 1, 1, 1.0)}
