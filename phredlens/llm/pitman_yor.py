"""LM scoring: a hierarchical Pitman-Yor model of words, seated by Gibbs sampling, spread over the cluster.

Restaurants. Every training word has a context restaurant of its own for the words that follow it; the start of a text
has one too. All context restaurants share the unigram restaurant as their parent, whose base spreads
``1 - UNKNOWN_MASS`` evenly over the known words and the rest on any unknown word. A table of a context restaurant is a
customer of the parent.

Sampling. Given a restaurant's size (a gamma variable of its number of tables) and its parent, the dishes of a restaurant
are seated independently, so a sweep draws the number of tables of all dishes of all restaurants from their exact
distribution given the sweep before. Every draw is a function of the words it is for and the sweep, of nothing else, and
all sums are of whole numbers: the scores depend on the rows alone, not on partitions, buckets or retries.

Where things live. Every (context, word) pair is in one bucket, by the hash of the word (of the pair, for words of very
many tokens, so no bucket gets them whole), with its customers, tables and places. A bucket has all that its words need
for the parent restaurant. What it needs of contexts, their customers and tables over all buckets, it gets from their
owners: it sends its part of the sums to the owner of each context, who adds them up and sends the whole back to those who
asked, as arrays of about two bytes an entry in an order that both sides know. Pairs of one customer always have one
table, so only pairs of two and more, and their contexts, take part in the sweeps. The driver gets totals, and sums of the
words of very many tokens, whose number the size of a bucket bounds.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import ExitStack
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.llm.tables import begin, release_memory, stage, text_rows, unstage
from phredlens.sources.staging import fresh_path

SWEEPS, BURN_IN = 3, 1
UNKNOWN_MASS = 0.5
STRENGTH = 1.0
#: Customers of a dish up to which its tables are drawn by a table of Stirling numbers; above, by integrals. Cells at once.
EXACT, _CELLS = 512, 1_000_000
#: Tokens of a bucket and of a chunk of documents, about; these bound the memory of a task.
BUCKET_TOKENS, CHUNK_TOKENS, CHUNK_DOCS = 2_000_000, 1_500_000, 60_000
#: A word with 1 / SPREAD of all training tokens, or a quarter of a bucket's, is dealt out by pairs.
SPREAD = 8192
_REMEMBERED = 300_000
END, START = b"\n", b"\r"  # no word has white space
#: Bits of a document of a chunk (with its training bit) and of a context, or a word, in a sort code.
_DOC, _CONTEXT = 17, 22
#: Logarithms are added as whole numbers of 2 ** -30, so they add up to the same whatever their order.
_FINE = float(1 << 30)


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_key(word: bytes) -> int:
    """Words are told apart by 64-bit hashes, contexts by the upper 48 bits of theirs (``context_key``)."""
    return xxhash.xxh64_intdigest(word)


def context_key(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(16)


def packed(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def unpacked(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes of whole numbers from 0 to 2 ** 56 - 1, all lowest ones first: high bytes repeat, so they pack well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:7].copy()


def whole(bytes_: np.ndarray) -> np.ndarray:
    return sum(b.astype(np.int64) << (8 * k) for k, b in enumerate(bytes_))


def steps(keys: np.ndarray) -> np.ndarray:
    """Byte planes of the differences of sorted 64-bit keys."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()


def climbed(bytes_: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(bytes_.T).view("<u8").ravel(), dtype=np.uint64)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 2, F.lit(False))


# --- draws -------------------------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern (the finish of a public generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(word ^ mixed(context + np.uint64(0x9E3779B97F4A7C15)))


class Draws:
    """Random numbers that are functions of a key, the sweep and a running number."""

    def __init__(self, keys: np.ndarray, sweep: int):
        self.keys, self.sweep = keys.astype(np.uint64), sweep

    def uniform(self, at: np.ndarray, number: int) -> np.ndarray:
        """Above 0 and below 1, for the keys at the given places."""
        salt = np.uint64((self.sweep * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return ((mixed(mixed(self.keys[at] + salt)) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52

    def gamma(self, shape: np.ndarray) -> np.ndarray:
        """Gamma variables of shapes of 1 or more, by squeezing a transformed normal; retried until all are taken."""
        out = np.zeros(len(self.keys))
        left, turn = np.arange(len(self.keys)), 2
        while len(left):
            d = shape[left] - 1 / 3
            normal = np.sqrt(-2 * np.log(self.uniform(left, turn))) * np.cos(2 * np.pi * self.uniform(left, turn + 1))
            v = (1 + normal / np.sqrt(9 * d)) ** 3
            with np.errstate(invalid="ignore", divide="ignore"):
                fine = (v > 0) & (np.log(self.uniform(left, turn + 2)) < 0.5 * normal**2 + d - d * v + d * np.log(np.maximum(v, 1e-300)))
            out[left[fine]] = (d * v)[fine]
            left, turn = left[~fine], turn + 3
        return out


# --- seating -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers [customers, tables] up to ``most`` customers."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, :-1][t - 1], np.where(t <= c, np.log(np.maximum(c - t * discount, 0)) + out[c, 1:][t - 1], -np.inf))
    return out


def log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 8.0  # Stirling's series for n + 7, and back
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - sum(np.log(n + k) for k in range(1, 8))


def _log1p(z: np.ndarray) -> np.ndarray:
    """Of complex numbers, with no loss near 0."""
    return 0.5 * np.log1p(z.real * (2 + z.real) + z.imag**2) + 1j * np.arctan2(z.imag, 1 + z.real)


def table_weights(customers: np.ndarray, new_weight: np.ndarray, discount: float, points: int = 96, nodes: int = 64):
    """(first, stride, weights): of first + k * stride tables for dishes with many customers, up to a factor each.

    a ** t times the Stirling number of (c, t) is the coefficient of x ** c in (u * (1 - (1 - x) ** d)) ** t / t!, with
    u = a / d. It is integrated on a contour through the saddle point of their sum over t: a parabola around the cut
    from 1 on, or a circle around 0 where the saddle is far from 1. The points cover 8 standard deviations.
    """
    c, u, d = customers.astype(float)[:, None], new_weight[:, None] / discount, discount
    low, high = np.full_like(c, -700.0), np.full_like(c, -1e-12)
    for _ in range(60):  # saddle: c = a * x * (1 - x) ** (d - 1), by the logarithm of s = 1 - x
        middle = (low + high) / 2
        under = np.log(u * d) + np.log(-np.expm1(middle)) + (d - 1) * middle > np.log(c)
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    s = np.exp(high)
    mean = u * -np.expm1(d * high)
    deviation = np.sqrt(np.maximum(0, mean - c * s / (s + (1 - d) * (1 - s))))
    first, last = np.maximum(1, np.floor(mean - 8 * deviation - 8)), np.minimum(c, np.ceil(mean + 8 * deviation + 16))
    first = np.minimum(first, last)
    stride = 2 * np.ceil(np.maximum(0, (last - first + 1) / points - 1) / 2) + 1
    step = (np.arange(nodes) + 0.5) / nodes
    circle = s >= 0.5
    s = np.where(circle, s, np.minimum(0.6, np.maximum(s, 4 / c)))
    spread = np.maximum(1e-9, c + c * (1 - d) * (1 - s) / s - c * c / np.maximum(mean, 1e-300))
    angle = np.minimum(np.pi, np.sqrt(60 / spread)) * step
    theta = np.sqrt(15 / ((1 - d) * c * s)) * step
    at = np.where(circle, 1 - (1 - s) * np.exp(1j * angle), s * (1 + 1j * theta) ** 2)
    # Logarithms at each node, less those on the real axis, for each table and for all customers.
    scale = np.log(-np.expm1(d * np.log(s)))
    table = np.log(-np.expm1(d * np.log(at))) - scale
    rest = -c * np.where(circle, 1j * angle, _log1p(-np.where(circle, 0, at)) - np.log1p(-np.where(circle, 0, s)))
    measure = np.where(circle, 1, 2 * s * (1 + 1j * theta) / (1 - at))
    value = np.exp(table * first + rest) * measure
    factor = np.exp(table * stride)
    tables = first + stride * np.arange(points)
    density = np.empty(tables.shape)
    for k in range(points):
        density[:, k] = value.real.sum(axis=1)
        value *= factor
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.where((tables <= last) & (density > 0), tables * (np.log(u) + scale) - log_factorial(tables) + np.log(density), -np.inf)
    return first[:, 0], stride[:, 0], np.exp(log - log.max(axis=1, keepdims=True))


def drawn_tables(customers: np.ndarray, new_weight: np.ndarray, discount: float, draws: Draws) -> np.ndarray:
    """Numbers of tables of dishes, each by its weight a ** t times the Stirling number; none without a customer."""
    out = np.minimum(customers, 1)
    order = np.argsort(customers, kind="stable")
    ranked = customers[order]
    start, exact = np.searchsorted(ranked, [2, EXACT + 1])
    log = log_stirling(discount)
    while start < exact:
        c = int(ranked[start])
        stop = min(int(np.searchsorted(ranked, c, "right")), start + max(1, _CELLS // c))
        at = order[start:stop]
        weight = np.log(new_weight[at])[:, None] * np.arange(1, c + 1) + log[c, 1 : c + 1]
        sums = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        out[at] = 1 + (sums < (draws.uniform(at, 0) * sums[:, -1])[:, None]).sum(axis=1)
        start = stop
    for start in range(exact, len(ranked), 512):
        at = order[start : start + 512]
        first, stride, weight = table_weights(customers[at], new_weight[at], discount)
        sums = np.cumsum(weight, axis=1)
        k = (sums < (draws.uniform(at, 0) * sums[:, -1])[:, None]).sum(axis=1)
        inside = np.floor(draws.uniform(at, 1) * stride) - (stride - 1) / 2
        out[at] = np.clip(first + k * stride + inside, 1, customers[at])
    return out


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate from the dishes with one and two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


#: Totals over all buckets, in the order of their numbers.
TOTALS = ("tokens", "words", "customers", "tables", "pair_ones", "pair_twos", "word_ones", "word_twos")


class State:
    """The parent restaurant after a sweep: totals, and the words that are dealt out by pairs. All buckets get a copy.

    ``sums``: totals of the other words by name, and by dealt-out word its tokens and customers.
    """

    def __init__(self, heads: np.ndarray, totals: dict[str, int], tokens: np.ndarray, customers: np.ndarray, before: State | None, sweep: int):
        self.heads, self.head_tokens, self.head_customers = heads, tokens, customers
        if before is None:
            self.tokens = totals["tokens"] + int(tokens.sum())
            self.words = totals["words"] + int((tokens > 0).sum())
            self.pair_discount = discount_of(totals["pair_ones"], totals["pair_twos"])
            self.word_discount = discount_of(totals["word_ones"] + int((customers == 1).sum()), totals["word_twos"] + int((customers == 2).sum()))
            self.head_tables = np.minimum(customers, 1)
        else:
            self.tokens, self.words, self.pair_discount, self.word_discount = before.tokens, before.words, before.pair_discount, before.word_discount
            self.head_tables = before.seated(heads, customers, sweep)
        self.root_customers = totals["customers"] + int(customers.sum())
        self.root_tables = totals["tables"] + int(self.head_tables.sum())
        size = Draws(np.zeros(1, np.uint64), sweep).gamma(np.array([STRENGTH / self.word_discount + self.root_tables]))[0]
        #: Of a new table of a known word when the parent is seated next.
        self.new_table = self.word_discount * size * (1 - UNKNOWN_MASS) / max(1, self.words)

    def seated(self, words: np.ndarray, customers: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of words in the parent restaurant, drawn given the state before."""
        return drawn_tables(customers, np.full(len(customers), self.new_table), self.word_discount, Draws(words, sweep))

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Unigram probability of known words."""
        new = (STRENGTH + self.word_discount * self.root_tables) * (1 - UNKNOWN_MASS) / max(1, self.words)
        return (np.maximum(0, customers - self.word_discount * tables) + new) / (STRENGTH + self.root_customers)

    def unknown(self) -> float:
        return (STRENGTH + self.word_discount * self.root_tables) * UNKNOWN_MASS / (STRENGTH + self.root_customers)

    def restaurant_sizes(self, contexts: np.ndarray, tables: np.ndarray, sweep: int) -> np.ndarray:
        """Weight of new tables in context restaurants, per unit of the parent's probability."""
        return self.pair_discount * Draws(contexts, sweep).gamma(STRENGTH / self.pair_discount + np.maximum(tables, 1))

    def predictive(self, customers, tables, context_customers, context_tables, parent) -> np.ndarray:
        """Probability of each pair's word after its context."""
        back_off = (STRENGTH + self.pair_discount * context_tables) * parent
        return (np.maximum(0, customers - self.pair_discount * tables) + back_off) / (STRENGTH + context_customers)


# --- chunks and buckets ------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, spread: int = SPREAD) -> tuple[np.ndarray, int]:
    """(sorted keys of words that are dealt out by pairs, all tokens): only the layout depends on them, no score does.

    Each task counts its words by lossy counting with an error of 1 / (8 * spread) of its tokens, in memory that doesn't
    grow with the corpus, and passes on those with 7 / (8 * spread) or more. Words that add up to 1 / spread of all
    training tokens are taken; spread follows the tokens, so that no other word has over a quarter of a bucket.
    """

    def run(batches):
        counts: Counter[bytes] = Counter()
        missed: dict[bytes, int] = {}  # at most so many were dropped before a word was kept
        n = every = bound = 0
        for b in batches:
            for text, out in zip(b.column("text"), b.column("held_out").to_pylist(), strict=True):
                words = words_of(text.as_py())
                every += len(words)
                if out:
                    continue
                n += len(words)
                counts.update(words)
                if len(counts) > _REMEMBERED:
                    now = n // (8 * spread) + 1
                    for w, c in list(counts.items()):
                        if c + missed.setdefault(w, bound) <= now:
                            del counts[w], missed[w]
                    bound = now
        least = max(1, 7 * n // (8 * spread))
        kept = [(w, c) for w, c in counts.items() if c >= least]
        yield pa.RecordBatch.from_arrays([pa.array([None, b"", *(w for w, _ in kept)], pa.binary()), pa.array([n, every, *(c for _, c in kept)], pa.int64())], ["word", "n"])
        del counts, missed
        release_memory()

    rows = stage(docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    totals = {r.word is None: r.n for r in rows.where("word is null or word = X''").collect()}
    n, every = totals.get(True, 0), totals.get(False, 0)
    found = rows.where((F.col("n") * spread >= max(n, 1)) | (F.col("n") * 4 >= BUCKET_TOKENS)).where("word is not null and word <> X''").collect()
    unstage(rows)
    return np.array(sorted(word_key(bytes(r.word)) for r in found), np.uint64), every


class _Words:
    """Rows and keys of the words that a task has met."""

    def __init__(self):
        self._reset()

    def _reset(self):
        self.rows: dict[bytes, int] = {START: 0}
        self.key = np.zeros(1024, np.uint64)
        self.key[0] = word_key(START)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            at = len(rows)
            while at + len(new) > len(self.key):
                self.key = np.append(self.key, np.zeros_like(self.key))
            self.key[at : at + len(new)] = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            rows.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))


def bucket_of(words: np.ndarray, contexts: np.ndarray, spread_out: np.ndarray, buckets: int) -> np.ndarray:
    return (np.where(spread_out, pair_key(contexts, words), words) % np.uint64(buckets)).astype(np.int64)


def chunk_blobs(key: np.ndarray, words: np.ndarray, contexts: np.ndarray, doc: np.ndarray, heads: np.ndarray, buckets: int):
    """(bucket, packed pairs and their documents) of one chunk of tokens; words and contexts are rows of ``key``.

    A blob has word keys, pairs of each, context keys, the context of each pair, documents of each pair, and each
    document with its training bit and how often it has the pair.
    """
    used = np.zeros(len(key), bool)
    used[words] = used[contexts] = True
    used = np.flatnonzero(used)
    keys = key[used]
    order = np.argsort(keys)
    keys, rank = keys[order], np.zeros(len(key), np.int64)
    rank[used[order]] = np.arange(len(order))
    word, context = rank[words], rank[contexts]
    if len(keys) < 1 << _CONTEXT:
        code = np.sort(word << (_CONTEXT + _DOC) | context << _DOC | doc)
        word, context, doc = code >> (_CONTEXT + _DOC), code >> _DOC & ((1 << _CONTEXT) - 1), code & ((1 << _DOC) - 1)
    else:  # one text of millions of different words
        order = np.lexsort((doc, context, word))
        word, context, doc = word[order], context[order], doc[order]
    new_pair = np.append(True, (word[1:] != word[:-1]) | (context[1:] != context[:-1]))
    entry = np.flatnonzero(new_pair | np.append(True, doc[1:] != doc[:-1]))
    times, doc = np.diff(np.append(entry, len(word))), doc[entry]
    pair = np.flatnonzero(new_pair[entry])
    n_docs = np.diff(np.append(pair, len(entry)))
    word, context = word[entry][pair], context[entry][pair]
    bucket = bucket_of(keys[word], context_key(keys[context]), np.isin(keys, heads)[word], buckets)
    by = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
    word, context, bucket, sizes = word[by], context[by], bucket[by], n_docs[by]
    ends = np.cumsum(sizes)
    entries = np.repeat(pair[by] - ends + sizes, sizes) + np.arange(len(entry))
    doc, times = doc[entries], times[entries]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, z in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        e = slice(ends[a] - sizes[a], ends[z - 1])
        first = np.flatnonzero(np.append(True, word[a + 1 : z] != word[a : z - 1]))
        own, which = np.unique(context[a:z], return_inverse=True)
        yield int(bucket[a]), packed(steps(keys[word[a:z][first]]), small(np.diff(np.append(first, z - a))), steps(context_key(keys[own])), small(which), small(sizes[a:z]), small(doc[e]), small(times[e]))


def gathered(blobs: list[tuple[int, bytes]]) -> tuple[bytes, bytes]:
    """(pairs, places) of a bucket from its chunks' blobs: pairs as ``Pairs`` reads them; places by chunk."""
    parts = [unpacked(blob) for _, blob in blobs]
    word_keys, context_keys = [climbed(p[0]) for p in parts], [climbed(p[2]) for p in parts]
    words, contexts = np.unique(np.concatenate(word_keys)), np.unique(np.concatenate(context_keys))
    codes, customers = [], []
    for w, c, (_, n_pairs, _, which, n_docs, doc, times) in zip(word_keys, context_keys, parts, strict=True):
        codes.append(np.repeat(np.searchsorted(words, w), n_pairs) << 32 | np.searchsorted(contexts, c)[which])
        customers.append(np.add.reduceat(times.astype(np.int64) * (doc & 1), np.cumsum(n_docs, dtype=np.int64) - n_docs))
    del word_keys, context_keys
    code = np.concatenate(codes)
    del codes
    pairs = np.unique(code)
    pair_of = np.searchsorted(pairs, code).astype(np.int32)
    del code
    total = np.bincount(pair_of, np.concatenate(customers), len(pairs)).astype(np.int64)
    del customers
    places, done = [], 0
    for (chunk, _), (*_, n_docs, doc, times) in zip(blobs, parts, strict=True):
        places.append((chunk, small(pair_of[done : done + len(n_docs)]), n_docs, doc, times))
        done += len(n_docs)
    per_word = np.bincount(pairs >> 32, minlength=len(words))
    return packed(steps(words), small(per_word), steps(contexts), small(pairs & 0xFFFFFFFF), small(total)), packed(*places)


class Pairs:
    """The pairs of one bucket, by word, then context; words and contexts are sorted keys."""

    def __init__(self, blob: bytes, owners: int):
        words, per_word, contexts, context, customers = unpacked(blob)
        self.words, self.contexts = climbed(words), climbed(contexts)
        self.word, self.context = np.repeat(np.arange(len(self.words)), per_word), context.astype(np.int64)
        self.customers = customers.astype(np.int64)
        #: Pairs whose tables are drawn, and contexts by owner: the order of all messages.
        self.moving = self.customers > 1
        owner = (self.contexts % np.uint64(owners)).astype(np.int64)
        self.by_owner = np.lexsort((self.contexts, owner))
        self.owner = owner[self.by_owner]

    def of_words(self, values=None) -> np.ndarray:
        return np.bincount(self.word, values, len(self.words)).astype(np.int64)

    def of_contexts(self, values) -> np.ndarray:
        return np.bincount(self.context, values, len(self.contexts)).astype(np.int64)

    def seats(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is the word dealt out by pairs, customers of each word in the parent from pairs of one customer, words whose
        seats in the parent can change)."""
        fixed = self.of_words(self.customers == 1)
        head = np.isin(self.words, heads)
        return head, fixed, head | (fixed + self.of_words(self.moving) > 1) | (self.of_words(self.moving) > 0)


def by_owner(owner: np.ndarray):
    """(owner, slice) of runs of equal owners."""
    if not len(owner):
        return
    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    yield from ((int(owner[a]), slice(int(a), int(z))) for a, z in zip(edges, np.append(edges[1:], len(owner)), strict=True))


# --- messages ----------------------------------------------------------------------------------------------------

#: kind; whom it is for; who sent it; content. Totals have their number as target and the value.
_LETTERS = "kind int, target long, source long, blob binary, value long"
_SUMS, _TO_OWNER, _TO_BUCKET, _ACTIVE, _BOOK, _HOLDER, _SEATS = range(7)
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())


def letters(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], ["kind", "target", "source", "blob", "value"])


def sums(totals: dict[str, int], heads: np.ndarray, *by_head: tuple[np.ndarray, np.ndarray]):
    """Letters to the driver: totals by their number, then for each kind of values those of dealt-out words."""
    yield from ((_SUMS, k, 0, None, int(totals.get(name, 0))) for k, name in enumerate(TOTALS))
    for k, (keys, values) in enumerate(by_head):
        at = np.searchsorted(heads, keys)
        yield from ((_SUMS, len(TOTALS) + 2 * int(i) + k, 0, None, int(v)) for i, v in zip(at, values, strict=True) if v)


def added(rows: DataFrame, heads: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Totals, and tokens and customers of dealt-out words, over all buckets."""
    found = dict(rows.where(F.col("kind") == _SUMS).groupBy("target").agg(F.sum("value")).collect())
    by_head = np.zeros((heads, 2), np.int64)
    for k, v in found.items():
        if k >= len(TOTALS):
            by_head[(k - len(TOTALS)) // 2, (k - len(TOTALS)) % 2] = v
    return {name: found.get(k, 0) or 0 for k, name in enumerate(TOTALS)}, by_head[:, 0], by_head[:, 1]


def opened(number: int, pairs: Pairs, heads: np.ndarray):
    """What a bucket says first: totals, and to the owners, for each context, its customers, its pairs of one customer
    and its pairs of more."""
    c = pairs.customers
    head, fixed, _ = pairs.seats(heads)
    seated, tokens = pairs.of_words(c > 0), pairs.of_words(c)
    own = seated[~head]
    totals = {"tokens": tokens[~head].sum(), "words": (own > 0).sum(), "customers": own.sum(), "tables": (own > 0).sum(), "pair_ones": (c == 1).sum(), "pair_twos": (c == 2).sum(), "word_ones": (own == 1).sum(), "word_twos": (own == 2).sum()}
    yield from sums(totals, heads, (pairs.words[head], tokens[head]), (pairs.words[head], seated[head]))
    parts = [pairs.of_contexts(x)[pairs.by_owner] for x in (c, c == 1, pairs.moving)]
    keys = pairs.contexts[pairs.by_owner]
    for owner, at in by_owner(pairs.owner):
        yield _TO_OWNER, owner, number, packed(steps(keys[at]), *(small(x[at]) for x in parts)), None


def first_answers(owner: int, sent: list[tuple[int, bytes]]):
    """To each bucket, for its contexts: customers, pairs of one customer, pairs of more, and their number among the
    owner's contexts that have pairs of more (0: none; others from 1)."""
    parts = [(source, climbed(p[0]), p[1:]) for source, p in ((s, unpacked(b)) for s, b in sent)]
    keys = np.unique(np.concatenate([k for _, k, _ in parts]))
    places = [np.searchsorted(keys, k) for _, k, _ in parts]
    whole_ = [np.bincount(np.concatenate(places), np.concatenate([p[j] for _, _, p in parts]), len(keys)).astype(np.int64) for j in range(3)]
    number = np.where(whole_[2] > 0, np.cumsum(whole_[2] > 0), 0)
    for (source, _, _), at in zip(parts, places, strict=True):
        yield _TO_BUCKET, source, owner, packed(*(small(x[at]) for x in (*whole_, number))), None


def later_answers(owner: int, rows: list[tuple[int, int, bytes]]):
    """To each bucket that asked with numbers of contexts, their tables (of pairs of more) over all buckets, for each
    sweep at hand. rows: (sweep, bucket, blob of numbers and, from buckets that have such pairs, tables); sweep 0 asks."""
    sent = [(sweep, source, *unpacked(blob)) for sweep, source, blob in rows]
    numbers = [np.cumsum(n, dtype=np.int64) for _, _, n, _ in sent]
    most = max((int(n[-1]) for n in numbers if len(n)), default=0) + 1
    sweeps = sorted({k for k, *_ in sent if k})
    whole_ = {k: np.zeros(most, np.int64) for k in sweeps}
    for (sweep, _, _, tables), n in zip(sent, numbers, strict=True):
        if sweep:
            np.add.at(whole_[sweep], n, tables)
    asking = 0 if any(k == 0 for k, *_ in sent) else sweeps[-1]
    for (sweep, source, _, _), n in zip(sent, numbers, strict=True):
        if sweep == asking:
            yield _TO_BUCKET, source, owner, packed(*(small(whole_[k][n]) for k in sweeps)), None


def numbered_message(numbers: np.ndarray, tables: np.ndarray | None) -> bytes:
    """Numbers of contexts in their order, as steps, and their tables; None asks for these."""
    order = np.argsort(numbers, kind="stable")
    return packed(small(np.diff(numbers[order], prepend=0)), None if tables is None else small(tables[order]))


def books(number: int, pairs: Pairs, answers: list[tuple[int, bytes]], heads: np.ndarray):
    """From the owners' first answers: the bucket's book of contexts; its active part, which is all that sweeps need; and
    to the owners, which of their contexts with pairs of more it has."""
    parts = [unpacked(blob) for _, blob in sorted(answers)]
    customers, ones, more, numbers = (np.concatenate([p[j] for p in parts]).astype(np.int64) for j in range(4))
    yield _BOOK, number, 0, packed(small(customers), small(ones), small(numbers)), None
    for owner, at in by_owner(pairs.owner):
        asked = np.sort(numbers[at][numbers[at] > 0])
        if len(asked):
            yield _HOLDER, owner, number, numbered_message(asked, None), None
    head, fixed, mutable = pairs.seats(heads)
    place = np.zeros(len(pairs.contexts), np.int64)  # of contexts in the order by owner
    place[pairs.by_owner] = np.arange(len(place))
    moving = place[pairs.context[pairs.moving]]
    own, context = np.unique(moving, return_inverse=True)
    listed = np.cumsum(mutable) - 1
    constant = int((~mutable & (fixed > 0)).sum())
    yield _ACTIVE, number, 0, packed(steps(pairs.words[mutable]), small(fixed[mutable]), head[mutable], small(listed[pairs.word[pairs.moving]]), small(context), small(pairs.customers[pairs.moving]), pairs.contexts[pairs.by_owner][own], small(pairs.owner[own]), small(numbers[own]), small(ones[own]), small(more[own]), constant), None


class Active:
    """The part of a bucket that sweeps change."""

    def __init__(self, number: int, blob: bytes):
        words, fixed, self.head, word, context, customers, self.contexts, owner, numbers, ones, more, self.constant = unpacked(blob)
        self.number, self.words = number, climbed(words)
        self.fixed, self.word, self.context, self.customers = (x.astype(np.int64) for x in (fixed, word, context, customers))
        self.owner, self.numbers, self.ones, self.more = (x.astype(np.int64) for x in (owner, numbers, ones, more))

    def sweep(self, state: State, sweep: int, seats: bytes | None, answers: list[tuple[int, bytes]]):
        """One sweep given the state, the bucket's seats and the owners' answers of the sweep before (None and none: as at
        the start, with one table for each dish)."""
        if seats is None:
            tables = np.ones(len(self.customers), np.int64)
            customers, seated = self.parent_customers(tables), np.minimum(self.parent_customers(tables), 1)
            context_tables = self.ones + self.more
        else:
            _, customers, seated = (x.astype(np.int64) for x in unpacked(seats))
            context_tables = self.ones + self.told(answers)
        parent = state.parent(customers, seated)
        at = np.searchsorted(state.heads, self.words[self.head])
        parent[self.head] = state.parent(state.head_customers[at], state.head_tables[at])
        size = state.restaurant_sizes(self.contexts, context_tables, sweep)
        draws = Draws(pair_key(self.contexts[self.context], self.words[self.word]), sweep)
        tables = drawn_tables(self.customers, size[self.context] * parent[self.word], state.pair_discount, draws)
        customers = self.parent_customers(tables)
        seated = np.zeros(len(self.words), np.int64)
        seated[~self.head] = state.seated(self.words[~self.head], customers[~self.head], sweep)
        totals = {"customers": customers[~self.head].sum() + self.constant, "tables": seated.sum() + self.constant}
        yield from sums(totals, state.heads, (self.words[:0], customers[:0]), (self.words[self.head], customers[self.head]))
        yield _SEATS, self.number, sweep, packed(small(tables), small(customers), small(seated)), None
        part = np.bincount(self.context, tables, len(self.contexts)).astype(np.int64)
        for owner, at in by_owner(self.owner):
            yield _TO_OWNER, owner, self.number, numbered_message(self.numbers[at], part[at]), None

    def parent_customers(self, tables: np.ndarray) -> np.ndarray:
        return self.fixed + np.bincount(self.word, tables, len(self.words)).astype(np.int64)

    def told(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Tables of the contexts, in their order, from the owners' answers, which are in the order of the numbers."""
        out = np.zeros(len(self.contexts), np.int64)
        by = dict(answers)
        for owner, at in by_owner(self.owner):
            (tables,) = unpacked(by[owner])
            out[at.start + np.argsort(self.numbers[at], kind="stable")] = tables
        return out


def pair_scores(pairs: Pairs, book: bytes, seats: dict[int, bytes], answers: list[tuple[int, bytes]], states: dict[int, State]):
    """(log10 probability, base log10 probability, is the word known) of each pair; probabilities are the mean over the
    samples, the sweeps of ``states``."""
    context_customers, ones, numbers = (x.astype(np.int64) for x in unpacked(book))
    by = dict(answers)
    told = {k: np.zeros(len(numbers), np.int64) for k in states}
    for owner, at in by_owner(pairs.owner):
        asked = np.flatnonzero(numbers[at])
        if len(asked):
            order = at.start + asked[np.argsort(numbers[at][asked], kind="stable")]
            for k, tables in zip(sorted(states), unpacked(by[owner]), strict=True):
                told[k][order] = tables
    place = np.zeros(len(pairs.contexts), np.int64)
    place[pairs.by_owner] = np.arange(len(place))
    context = place[pairs.context]
    last = states[max(states)]
    head, fixed, mutable = pairs.seats(last.heads)
    at = np.searchsorted(last.heads, pairs.words[head])
    tokens = pairs.of_words(pairs.customers)
    tokens[head] = last.head_tokens[at]
    known = tokens > 0
    total = np.zeros(len(pairs.customers))
    for k, state in states.items():
        moved, customers, seated = (x.astype(np.int64) for x in unpacked(seats[k]))
        tables = np.minimum(pairs.customers, 1)
        tables[pairs.moving] = moved
        word_customers, word_tables = np.minimum(fixed, 1), np.minimum(fixed, 1)
        word_customers[mutable], word_tables[mutable] = customers, seated
        word_customers[head], word_tables[head] = state.head_customers[at], state.head_tables[at]
        parent = np.where(known, state.parent(word_customers, word_tables), state.unknown())
        total += state.predictive(pairs.customers, tables, context_customers[context], (ones + told[k])[context], parent[pairs.word])
    base = np.log10((tokens + 1.0) / (last.tokens + last.words + 1))
    return np.log10(total / len(states)), base[pairs.word], known[pairs.word]


# --- the passes over the corpus ----------------------------------------------------------------------------------


def token_table(docs: DataFrame, heads: np.ndarray, buckets: int) -> DataFrame:
    """Rows (bucket, pairs, places): of each bucket its pairs and the documents they stand in; bucket < 0: the documents
    of a chunk. One shuffle moves every distinct (context, word, document) in a few bytes."""
    shipped = docs.sparkSession.sparkContext.broadcast(heads)

    def run(batches):
        begin()
        table = _Words()
        chunk, part = 0, TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        ids: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, ids, size, chunk
            number = part << 24 | chunk
            doc = np.repeat(np.arange(len(held)), [len(r) for r in held])
            train = np.array([not x[1] for x in ids])
            words = np.concatenate(held)
            context = np.append(0, words[:-1])
            context[np.cumsum([0, *map(len, held[:-1])])] = 0
            out = [(-1 - number, number, packed(ids)), *((b, number, blob) for b, blob in chunk_blobs(table.key[: len(table.rows)], words, context, doc * 2 + train[doc], shipped.value, buckets))]
            held, ids, size, chunk = [], [], 0, chunk + 1
            if len(table.rows) > _REMEMBERED:
                table._reset()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "chunk", "blob"])

        for b in batches:
            texts, docs_of, out = b.column("text"), b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()
            for k, text in enumerate(texts):
                words = words_of(text.as_py())
                held.append(table.numbered(words).astype(np.int32))
                ids.append((docs_of[k], out[k], len(words)))
                size += len(words)
                if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield from flush()
        if ids:
            yield from flush()
        del table
        release_memory()

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = key[0].as_py()
        blobs = sorted((c, blob) for b in batches for c, blob in zip(b.column("chunk").to_pylist(), b.column("blob").to_pylist(), strict=True))
        pairs, places = (None, blobs[0][1]) if number < 0 else gathered(blobs)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pairs], pa.binary()), pa.array([places], pa.binary())], ["bucket", "pairs", "places"])
        if number >= 0:
            del blobs, pairs, places
            release_memory()

    return docs.mapInArrow(run, "bucket long, chunk long, blob binary").groupBy("bucket").applyInArrow(gather, "bucket long, pairs binary, places binary")


class _Kept:
    """A table that stays dealt by bucket on disk, so that letters come to it and it isn't shuffled again. It is a table of
    the current database, and goes, whatever happens, with the rest of ``left``."""

    def __init__(self, rows: DataFrame, parts: int, left: ExitStack):
        self.spark, self.name = rows.sparkSession, f"phredlens_{uuid.uuid4().hex}"
        self.path, self.rows = fresh_path(self.spark), None
        left.callback(self.drop)
        rows.write.bucketBy(parts, "bucket").option("path", self.path).format("parquet").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)
        self.rows._phredlens_path = self.path

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.rows is not None:
            unstage(self.rows)


def _meeting(kept: DataFrame, mail: DataFrame, answer, schema: str = _LETTERS) -> DataFrame:
    """``answer(bucket, row of kept, letters by kind as (source, blob))`` for every bucket; gives a record batch."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        by: dict[int, list] = {}
        for kind, source, blob in zip(*(right.column(c).to_pylist() for c in ("kind", "source", "blob")), strict=True):
            by.setdefault(kind, []).append((source, blob))
        out = pa.Table.from_batches([answer(row["bucket"], row, by)])
        del row, by, left, right
        release_memory()
        return out

    return kept.groupBy("bucket").cogroup(mail.withColumnRenamed("target", "bucket").groupBy("bucket")).applyInArrow(run, schema)


def _at_owners(rows: DataFrame, answer) -> DataFrame:
    """``answer(owner, [(sweep, source, blob)])`` for every owner. rows: target, sweep, source, blob."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("sweep", "source", "blob")), strict=True)]
        yield letters(list(answer(key[0].as_py(), sent)))
        del sent
        release_memory()

    return rows.groupBy("target").applyInArrow(run, _LETTERS)


def _post(table: DataFrame, kind: int, sweep: int) -> DataFrame:
    return table.where(F.col("kind") == kind).select("target", F.lit(sweep).alias("sweep"), "source", "blob")


def language_model_scores(docs: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, spread: int = SPREAD) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    score is the log10 probability of the whole text, each token's being the mean over the samples after burn-in;
    perplexity is 10 ** (-score / n_tokens). The training documents are those not held out (crc32 of doc_id mod 7 is
    not 2). A null text counts as empty: its end is its one token. A null doc_id isn't held out. Rows that repeat are
    scored, and learned from, each by itself. Without training documents every token is unknown; an empty table gives
    no rows; other columns are ignored. Scores depend on the rows only. The result is staged; all else that was written
    on the way is deleted, also when a job fails.
    """
    if not 0 <= burn_in < sweeps:
        raise ValueError("there must be a sweep after the burn-in")
    with ExitStack() as left:
        return _scored(docs, sweeps, burn_in, spread, left)


def _scored(docs: DataFrame, sweeps: int, burn_in: int, spread: int, left: ExitStack) -> DataFrame:
    """See ``language_model_scores``; what is written on the way goes with ``left``."""

    def kept_for_now(df: DataFrame) -> DataFrame:
        out = stage(df)
        left.callback(unstage, out)
        return out

    spark = docs.sparkSession
    source = text_rows(docs, held_out().alias("held_out"))
    heads, every = frequent_words(source, spread)
    buckets = max(12, -(-every // BUCKET_TOKENS))
    parts = 2 * buckets
    static = _Kept(token_table(source, heads, buckets), parts, left)
    listed = static.rows.where("bucket >= 0").select("bucket", "pairs")
    shipped = spark.sparkContext.broadcast(heads)

    def open_(batches):
        for b in batches:
            for number, pairs in zip(b.column("bucket").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                yield letters(list(opened(number, Pairs(pairs, buckets), shipped.value)))
        release_memory()

    said = kept_for_now(listed.mapInArrow(open_, _LETTERS))
    states = {0: State(heads, *added(said, len(heads)), None, 0)}
    answers = _at_owners(_post(said, _TO_OWNER, 0), lambda owner, sent: first_answers(owner, [(s, b) for _, s, b in sent]))
    booked = kept_for_now(_meeting(listed, answers, lambda number, row, by: letters(list(books(number, Pairs(row["pairs"], buckets), by.get(_TO_BUCKET, []), shipped.value)))))
    active = _Kept(booked.where(F.col("kind") == _ACTIVE).select(F.col("target").alias("bucket"), "blob"), parts, left)
    swept: dict[int, DataFrame] = {}
    for k in range(1, sweeps + 1):
        state = spark.sparkContext.broadcast(states[k - 1])

        def turn(number, row, by, k=k, state=state):
            seats = by.get(_SEATS)
            return letters(list(Active(number, row["blob"]).sweep(state.value, k, seats[0][1] if seats else None, by.get(_TO_BUCKET, []))))

        mail = spark.createDataFrame([], _LETTERS)
        if k > 1:
            mail = _at_owners(_post(swept[k - 1], _TO_OWNER, k - 1), later_answers).unionByName(swept[k - 1].where(F.col("kind") == _SEATS))
        swept[k] = kept_for_now(_meeting(active.rows, mail, turn))
        totals, _, customers = added(swept[k], len(heads))
        states[k] = State(heads, totals, states[0].head_tokens, customers, states[k - 1], k)
    samples = {k: states[k] for k in range(burn_in + 1, sweeps + 1)}
    asked = _post(booked, _HOLDER, 0)
    mail = booked.where(F.col("kind") == _BOOK)
    for k in samples:
        asked = asked.unionByName(_post(swept[k], _TO_OWNER, k))
        mail = mail.unionByName(swept[k].where(F.col("kind") == _SEATS))
    mail = mail.unionByName(_at_owners(asked, later_answers))
    model = spark.sparkContext.broadcast(samples)

    def score(number, row, by):
        if number < 0:
            return pa.RecordBatch.from_arrays([pa.array([-1 - number]), pa.array([True]), pa.array([row["places"]], pa.binary())], ["chunk", "docs", "blob"])
        pairs = Pairs(row["pairs"], buckets)
        values = pair_scores(pairs, by[_BOOK][0][1], dict(by[_SEATS]), by.get(_TO_BUCKET, []), model.value)
        fine = [*(np.maximum(0, -x * _FINE) for x in values[:2]), values[2].astype(float)]
        out = []
        for chunk, pair, n_docs, doc, times in unpacked(row["places"]):
            each, doc = np.repeat(pair, n_docs), doc >> 1
            at = np.flatnonzero(np.bincount(doc))
            of_docs = [np.bincount(doc, np.rint(x[each] * times))[at].astype(np.int64) for x in fine]
            out.append((chunk, packed(small(np.diff(at, prepend=0)), planes(of_docs[0]), planes(of_docs[1]), small(of_docs[2]))))
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([False] * len(out)), pa.array([b for _, b in out], pa.binary())], ["chunk", "docs", "blob"])

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    train_tokens = states[0].tokens

    def collect(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blobs = [], []
        for b in batches:
            for is_docs, blob in zip(b.column("docs").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if is_docs:
                    (ids,) = unpacked(blob)
                else:
                    blobs.append(blob)
        score, base, known = (np.zeros(len(ids), np.int64) for _ in range(3))
        for jumps, s, b0, k in map(unpacked, blobs):
            at = np.cumsum(jumps, dtype=np.int64)
            score[at] += whole(s)
            base[at] += whole(b0)
            known[at] += k
        columns = [pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.bool_()), pa.array([x[2] for x in ids], pa.int64()), pa.array(known), pa.array(np.full(len(ids), train_tokens, np.int64)), pa.array(-base / _FINE), pa.array(-score / _FINE)]
        yield pa.RecordBatch.from_arrays(columns, names)
        del blobs, ids, columns
        release_memory()

    of_chunks = _meeting(static.rows, mail, score, "chunk long, docs boolean, blob binary").groupBy("chunk")
    rows = of_chunks.applyInArrow(collect, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return stage(rows.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
