"""Packing against the tokenizers library and exact optima."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from phredlens.llm import bin_completion as bins
from phredlens.llm.packing import cuts, packed, slots

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(items, capacity):
    """The optimum, by all subsets."""
    best = [(1, 0)] + [(99, 0)] * (2 ** len(items) - 1)
    for mask in range(1, 1 << len(items)):
        for k, x in enumerate(items):
            if mask >> k & 1:
                n, filled = best[mask ^ 1 << k]
                best[mask] = min(best[mask], (n, filled + x) if filled + x <= capacity else (n + 1, x))
    return best[-1][0]


def checked(counts, capacity, packing):
    used = np.zeros(len(counts), np.int64)
    for n, contents in packing:
        assert n > 0 and sum(s * t for s, t in contents) <= capacity
        for s, t in contents:
            used[s] += n * t
    assert (used == counts).all()
    return sum(n for n, _ in packing)


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fitting = [k for k, r in enumerate(rooms) if r >= x]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_small_instances_are_packed_best():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 20, 37, 100])
        items = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(max(1, capacity // 5), capacity // 2 + 1) for _ in range(rng.randint(0, 10))]
        counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, np.int64)
        want = fewest(items, capacity) if items else 0
        assert checked(counts, capacity, bins.pack(counts, capacity)) == want
        assert bins.fewest_bins(counts, capacity) <= want


def test_alike_bins_are_filled_as_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([10, 31, 64])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 80))]
        counts = np.bincount(items, minlength=capacity + 1)
        packing = bins.best_fit(counts, capacity)
        checked(counts, capacity, packing)
        assert sorted(r for n, c in packing for r in [capacity - sum(s * t for s, t in c)] * n) == plain_best_fit(items, capacity)


def test_dominated_fillings_are_left_out():
    counts = np.zeros(101, np.int64)
    counts[[30, 20, 10]] = 3
    assert bins.fillings(counts, 30) == [(30,)]  # 20 and 10, or three 10, fit where 30 goes
    counts[30] = 0
    assert bins.fillings(counts, 30) == [(20, 10)]
    assert bins.fillings(np.zeros(101, np.int64), 30) == [()]


def test_many_items_cost_as_much_as_few():
    """A hundred thousand million items: the packing has few kinds of bins and is within a part in a thousand of the bound."""
    sizes = np.clip(np.random.default_rng(0).lognormal(5.5, 0.8, 50_000).astype(int), 1, 1024)
    counts = np.bincount(sizes, minlength=1025) * 2_000_000
    packing = bins.pack(counts, 1024, nodes=1500)
    assert checked(counts, 1024, packing) <= bins.fewest_bins(counts, 1024) * 1.001 and len(packing) < 3000


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (3000, [(0, 952), (952, 1024), (1976, 1024)])])
def test_the_first_piece_is_the_shorter_one(n, want):
    assert cuts(n, 1024) == want


def test_slots_follow_ranks():
    table = slots([(2, ((5, 2), (3, 1))), (1, ((3, 1),))])
    assert table[:, 1:].tolist() == [[1, 0, 10], [1, 2, 0], [2, 0, 0]]


def rows_of(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, length int")
    return packed(docs.repartition(5), PATH, **options).collect()


def valid(rows, texts, capacity, end):
    """Pieces are those of the library's ids; sequences have no gap and aren't too long."""
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        starts = [0] + [len(ids) - capacity * k for k in range((len(ids) - 1) // capacity, 0, -1)]
        want += [(i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    filled: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values(), default=0) <= capacity
    return len(filled)


def test_pieces_and_sequences(spark):
    rng = random.Random(1)
    words = "the of Größe 中文 don't x1 <|endoftext|> \n\n   . ".split(" ")
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for k in range(150)]
    texts += [(None, "no id"), (3, "twice"), (3, "twice"), (4, None), (5, ""), (6, "long " * 5000), (7, " " * 200_000 + "x"), *((8, "copy of one text"),) * 60]
    n = valid(rows_of(spark, texts, capacity=64, nodes=100), texts, 64, 2)
    lengths = sum(len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert n <= -(-lengths // 64) * 1.01 + 1


def test_empty_and_single(spark):
    assert rows_of(spark, []) == []
    (row,) = rows_of(spark, [(1, None)])
    assert (row.piece, row.start, row.length, row.offset, row.ids_crc32) == (0, 0, 1, 0, zlib.crc32(np.array([2], "<u4").tobytes()))


def test_the_query_covers_the_table(spark, sf_dir):
    from phredlens.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    valid(queries.op11_packing(spark, sf_dir).collect(), [tuple(r) for r in docs], 1024, 2)
