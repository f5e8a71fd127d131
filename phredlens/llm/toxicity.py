"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A text is cut into overlapping windows; every window is scored and a text is as toxic as its worst window. Training
learns from document labels alone: the worst windows of toxic documents are the positive examples, chosen anew as the
network improves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.llm.decontaminate import tokens
from phredlens.llm.tables import begin, few_texts, release_memory, rows_where, slices_of, text_rows

WINDOW, STRIDE = 32, 24
DIM, HIDDEN, ATTENTION = 8, 8, 8
WORDS, CHARS = 20_000, 1 << 14
#: Labelled rows that training takes at most, of each label, by the smallest hash of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
#: Bytes of a word that are one input; a longer word is several words in a row, so all of it is read.
LONGEST = 40
_REMEMBERED = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Tokens of a text, longer ones cut into consecutive pieces of ``LONGEST`` bytes."""
    words = tokens(text)
    if max(map(len, words), default=0) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def char_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): hashed trigrams of each bounded word, its beginnings of 3 to 7 and endings of 3 and 4
    characters; the features of word k start at first[k]. Words have at most ``LONGEST`` bytes."""
    bounded = [b"<" + w + b">" for w in words]
    size = np.fromiter(map(len, bounded), np.int64, len(bounded))
    m = np.frombuffer(b"".join(w.ljust(42, b"\0") for w in bounded), np.uint8).reshape(-1, 42).astype(np.uint32)
    code = lambda parts, salt: sum(c * np.uint32(f) for c, f in zip(parts, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09), strict=False)) * np.uint32(2 * salt + 1)
    codes, real = [code([m[:, k : 40 + k] for k in range(3)], 0)], [np.arange(40) < size[:, None] - 2]
    rows = np.arange(len(m))
    for k in range(4, 9):
        codes.append(code([m[:, i] for i in range(k)], k)[:, None])
        real.append((size >= k)[:, None])
    for k in (4, 5):
        codes.append(code([m[rows, np.maximum(size - k, 0) + i] for i in range(k)], 8 + k)[:, None])
        real.append((size >= k)[:, None])
    real, codes = np.concatenate(real, axis=1), np.concatenate(codes, axis=1)
    real[:, 0] = True  # a word of no byte has one feature too
    codes ^= codes >> np.uint32(15)
    return (codes[real] % np.uint32(CHARS)).astype(np.int64), np.concatenate([[0], np.cumsum(real.sum(axis=1))[:-1]])


def char_features_of_many(words: list[bytes], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """``char_features`` in parts, so that its matrices stay small."""
    codes, first, n = [], [], 0
    for i in range(0, len(words), at_once):
        c, f = char_features(words[i : i + at_once])
        codes.append(c.astype(np.int32))
        first.append(f + n)
        n += len(c)
    return np.concatenate(codes), np.concatenate(first)


def _summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``index``."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    order = np.argsort(index, kind="stable")
    at, begin = np.unique(index[order], return_index=True)
    if len(at):
        out[at] = np.add.reduceat(values[order], begin, axis=0)
    return out


def window_starts(n: int) -> range:
    """Starts of windows over ``n`` tokens: all overlap their neighbours, and the last reaches the end."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters ``p``; ``words`` numbers the known words from 1. Word 0 is any other word."""

    words: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, words: dict[bytes, int], seed: int = 7, dtype=np.float32) -> Network:
        rng = np.random.default_rng(seed)
        shape = {"word": (len(words) + 1, DIM), "char": (CHARS, DIM), "wx": (DIM, 6 * HIDDEN), "b": (6 * HIDDEN,), "u0": (HIDDEN, 3 * HIDDEN), "u1": (HIDDEN, 3 * HIDDEN), "wa": (2 * HIDDEN, ATTENTION), "va": (ATTENTION,), "out": (2 * HIDDEN,), "bias": (1,)}
        scale = {"word": 0.1, "char": 0.1, "b": 0.0, "bias": 0.0}
        return cls(words, {k: (rng.standard_normal(s) * scale.get(k, 0.5 / np.sqrt(s[0]) + 0.1)).astype(dtype) for k, s in shape.items()})

    def inputs(self, ids: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input vectors of words: the word's vector plus the mean of its character features' vectors."""
        n = np.diff(np.append(first, len(chars)))
        return self.p["word"][ids] + np.add.reduceat(self.p["char"][chars], first, axis=0) / n[:, None].astype(self.p["char"].dtype)

    def projections(self, ids: np.ndarray, chars: np.ndarray, first: np.ndarray, at_once: int = 20_000) -> np.ndarray:
        """Input projections of words, in parts, so that their features' vectors never stand together."""
        ends = np.append(first, len(chars))
        parts = [self.inputs(ids[i : i + at_once], chars[ends[i] : ends[min(i + at_once, len(ids))]], first[i : i + at_once] - first[i]) @ self.p["wx"] + self.p["b"] for i in range(0, len(ids), at_once)]
        return np.concatenate(parts)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. x: (time, window, 6 * HIDDEN) input projections; mask: (time, window) of real tokens."""
        steps, count = mask.shape
        h_all = np.empty((steps, count, 2 * HIDDEN), x.dtype)
        kept = []
        for side, u in enumerate((self.p["u0"], self.p["u1"])):
            h = np.zeros((count, HIDDEN), x.dtype)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                a = x[t, :, 3 * HIDDEN * side : 3 * HIDDEN * (side + 1)]
                b = h @ u
                gates = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
                r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if not mask[t].all():
                    new = np.where(mask[t][:, None], new, h)
                if keep:
                    kept.append((side, t, h, r, z, c, b[:, 2 * HIDDEN :]))
                h = new
                h_all[t, :, HIDDEN * side : HIDDEN * (side + 1)] = h
        e = np.tanh(h_all @ self.p["wa"])
        s = np.where(mask, e @ self.p["va"], -1e9)
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tbh,tb->bh", h_all, w)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (h_all, e, w, pooled, kept)) if keep else logits

    def gradients(self, x, mask, labels, weights):
        """Loss (weighted cross-entropy), gradients of the parameters above the inputs, and of x."""
        logits, (h_all, e, w, pooled, kept) = self.forward(x, mask, keep=True)
        p = _sigmoid(logits)
        loss = float((weights * (np.logaddexp(0, logits) - labels * logits)).sum() / weights.sum())
        d = (weights * (p - labels) / weights.sum()).astype(x.dtype)
        g = {k: np.zeros_like(self.p[k]) for k in ("u0", "u1")}
        g |= {"out": pooled.T @ d, "bias": np.array([d.sum()], x.dtype)}
        d_pooled = d[:, None] * self.p["out"]
        d_w = np.einsum("tbh,bh->tb", h_all, d_pooled)
        d_s = w * (d_w - (w * d_w).sum(axis=0))
        d_e = d_s[:, :, None] * self.p["va"] * (1 - e * e)
        g |= {"va": np.einsum("tba,tb->a", e, d_s), "wa": np.einsum("tbh,tba->ha", h_all, d_e)}
        d_h_all = w[:, :, None] * d_pooled + d_e @ self.p["wa"].T
        d_x = np.zeros_like(x)
        d_h = np.zeros((mask.shape[1], HIDDEN), x.dtype)
        last = None
        for side, t, h, r, z, c, bn in reversed(kept):
            if side != last:
                d_h, last = np.zeros_like(d_h), side
            u = self.p[f"u{side}"]
            total = d_h + d_h_all[t, :, HIDDEN * side : HIDDEN * (side + 1)]
            real = mask[t][:, None]
            new = np.where(real, total, 0)
            d_c = new * (1 - z) * (1 - c * c)
            d_z = new * (h - c) * z * (1 - z)
            d_r = d_c * bn * r * (1 - r)
            d_b = np.concatenate([d_r, d_z, d_c * r], axis=1)
            g[f"u{side}"] += h.T @ d_b
            d_x[t, :, 3 * HIDDEN * side : 3 * HIDDEN * (side + 1)] = np.concatenate([d_r, d_z, d_c], axis=1)
            d_h = np.where(real, new * z + d_b @ u.T, total)
        return loss, g, d_x


class Scorer:
    """Scores texts; keeps the input projections of words it has met, up to a bound."""

    def __init__(self, network: Network):
        self.net = network
        self._reset()

    def _reset(self):
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """Rows of ``table`` for words; new words are added."""
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(new) > _REMEMBERED and rows:
            self._reset()
            rows, new = self.rows, list(dict.fromkeys(words))
        if new:
            known = self.net.words.get
            x = self.net.projections(np.array([known(w, 0) for w in new]), *char_features_of_many(new))
            at = len(rows)
            while at + len(new) + 1 > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at + 1 : at + 1 + len(new)] = x
            rows.update(zip(new, range(at + 1, at + 1 + len(new)), strict=True))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def window_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, first token, logit) of all windows of all texts; a text without words is one empty window."""
        words = [words_of(t) for t in texts]
        ids = self.numbered([w for x in words for w in x])
        first = np.concatenate([[0], np.cumsum([len(x) for x in words])])
        spans = [(k, s, min(WINDOW, len(x) - s)) for k, x in enumerate(words) for s in window_starts(len(x))]
        doc, start, size = (np.array(c, np.int64) for c in zip(*spans, strict=True))
        padded = np.append(ids, np.zeros(WINDOW, np.int64))
        logits = np.empty(len(doc), np.float32)
        for i in range(0, len(doc), 1024):
            part = slice(i, i + 1024)
            mask = np.arange(WINDOW)[:, None] < size[part]
            at = np.where(mask, padded[first[doc[part]] + start[part] + np.arange(WINDOW)[:, None]], 0)
            mask[0] = True  # an empty window has one empty token
            logits[part] = self.net.forward(self.table[at], mask)
        return doc, start, logits

    def scores(self, texts: list[str | None]) -> np.ndarray:
        doc, _, logits = self.window_logits(texts)
        worst = np.full(len(texts), -np.inf, np.float64)
        np.maximum.at(worst, doc, logits)
        return _sigmoid(worst)


def train(texts: list[str], labels: list[int], seed: int = 7, rounds: int = 4, epochs: int = 3, batch: int = 128) -> Network:
    """A network from labelled texts. With one label only, or no text, every text gets a score on that side."""
    y = np.array(labels, np.float32)
    number: dict[bytes, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
    known = list(number)
    counts = np.zeros((len(known), 2))
    for label, doc in zip(labels, docs, strict=True):
        counts[np.unique(doc), label] += 1
    often = np.flatnonzero(counts.sum(axis=1) >= 3)
    vocabulary = sorted(often.tolist(), key=lambda k: (-counts[k].sum(), known[k]))[:WORDS]
    net = Network.fresh({known[k]: n + 1 for n, k in enumerate(vocabulary)}, seed)
    if not len(y) or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["bias"][:] = 4.0 if len(y) and y[0] else -4.0
        return net
    if not known:
        return net
    # Where a word or character feature starts: its log odds over documents (over words for characters), in dimension 0.
    odds = lambda c, n: np.clip(np.log((c[:, 1] + 0.5) / n[1]) - np.log((c[:, 0] + 0.5) / n[0]), -3, 3) / 3
    word_odds = odds(counts, [(y == k).sum() + 1 for k in (0, 1)])
    net.p["word"][1 : len(vocabulary) + 1, 0] = word_odds[vocabulary]
    chars, begin = char_features_of_many(known)
    sizes = np.diff(np.append(begin, len(chars)))
    word_ids = np.array([net.words.get(w, 0) for w in known])
    by_char = np.stack([np.bincount(chars, np.repeat(counts[:, k], sizes), CHARS) for k in (0, 1)], axis=1)
    net.p["char"][:, 0] = np.where(by_char.sum(axis=1) > 0, odds(by_char, by_char.sum(axis=0) + 1), 0)
    rng = np.random.default_rng(seed)
    ids = np.concatenate([*docs, np.zeros(WINDOW, np.int32)])
    first = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    spans = [(k, s, min(WINDOW, len(x) - s)) for k, x in enumerate(docs) for s in window_starts(len(x)) if len(x)]
    doc, start, size = (np.array(c, np.int64) for c in zip(*spans, strict=True))
    steps = np.arange(WINDOW)[:, None]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    tick = 0

    def gathered(rows):
        mask = steps < size[rows]
        return np.where(mask, ids[first[doc[rows]] + start[rows] + steps], 0), mask

    batches_of_windows = [np.arange(i, min(i + 2048, len(doc))) for i in range(0, len(doc), 2048)]
    # The first choice of windows: the sum of the clearly toxic words' odds.
    prior = np.maximum(0, word_odds - 0.5)
    score = np.concatenate([np.where(m, prior[at], 0).sum(axis=0) for at, m in map(gathered, batches_of_windows)])
    for step in range(rounds):
        rate = 0.01 * 0.5**step
        if step:
            table = net.projections(word_ids, chars, begin)
            score = np.concatenate([net.forward(table[at], m) for at, m in map(gathered, batches_of_windows)])
            del table
        order = np.lexsort((-score, doc))
        top = order[np.unique(doc[order], return_index=True)[1]]
        positive = top[y[doc[top]] == 1]
        clean = np.flatnonzero(y[doc] == 0)
        hard = top[y[doc[top]] == 0]
        for _ in range(epochs):
            negative = np.concatenate([hard, rng.choice(clean, min(len(clean), 2 * len(hard)), replace=False)])
            rows = rng.permutation(np.concatenate([positive, negative]))
            weight = {1: 0.3 / max(1, len(positive)), 0: 0.7 / max(1, len(negative))}
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                at, mask = gathered(part)
                used, back = np.unique(at, return_inverse=True)
                back = back.reshape(at.shape)
                taken = np.concatenate([np.arange(begin[k], begin[k] + sizes[k]) for k in used])
                firsts = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
                x = net.inputs(word_ids[used], chars[taken], firsts)
                target = y[doc[part]]
                weights = np.array([weight[int(v)] for v in target], np.float32)
                _, g, d_x = net.gradients((x @ net.p["wx"] + net.p["b"])[back], mask, target, weights)
                d_rows = _summed(back[mask], d_x[mask], len(used))
                d_in = d_rows @ net.p["wx"].T
                spread = np.repeat(d_in / sizes[used][:, None].astype(np.float32), sizes[used], axis=0)
                g |= {"wx": x.T @ d_rows, "b": d_rows.sum(axis=0), "word": _summed(word_ids[used], d_in, len(net.words) + 1), "char": _summed(chars[taken], spread, CHARS)}
                g["word"][0] = 0
                tick += 1
                for k, v in g.items():
                    m, s = moments[k]
                    m += 0.1 * (v - m)
                    s += 0.01 * (v * v - s)
                    net.p[k] -= (rate * (m / (1 - 0.9**tick)) / (np.sqrt(s / (1 - 0.99**tick)) + 1e-8)).astype(np.float32)
    return net


def held_out() -> F.Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0


def learn(documents: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Network:
    """Train on at most ``toxic`` and ``clean`` labelled documents outside the held-out fifth.

    The labelled rows with the smallest hashes of doc_id are taken, so the sample is the same on every run and its
    size has a bound that doesn't depend on the corpus: in rows, and in bytes as ``few_texts`` has it. Rows with null
    ids or labels are no examples; of repeated label rows the highest label counts, of repeated documents one.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda k, n: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = part(1, toxic).unionByName(part(0, clean)).select("doc_id", "toxic").collect()
    if not chosen:
        return train([], [])
    ids = documents.sparkSession.createDataFrame([(r.doc_id, int(r.toxic)) for r in chosen], "__phl_id long, __phl_toxic int")
    rows = few_texts(documents.where("text is not null").join(F.broadcast(ids), F.col("doc_id") == F.col("__phl_id")).select("doc_id", F.col("text").cast("string").alias("text"), "__phl_toxic"), toxic + clean)
    return train([r[1] for r in rows], [r[2] for r in rows])


def toxicity(docs: DataFrame, network: Network) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_windows. All windows of every whole text are scored.

    A null or empty text is one window with one empty token, so it has a score too. A null doc_id isn't held out.
    Rows are independent: repeated rows repeat, an empty table gives none, other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((network.words, network.p))

    def run(batches):
        begin()
        scorer = Scorer(Network(*shipped.value))
        for b in batches:
            texts = b.column("text")
            out, count = [], []
            for a, z in slices_of(texts, 1 << 19):
                doc, _, logits = scorer.window_logits(texts[a:z].to_pylist())
                worst = np.full(z - a, -np.inf)
                np.maximum.at(worst, doc, logits)
                out.append(_sigmoid(worst))
                count.append(np.bincount(doc, minlength=z - a))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.concatenate(count) if count else [], pa.int64())], ["doc_id", "held_out", "score", "predicted", "n_windows"])
        del scorer
        release_memory()

    rows = text_rows(docs, F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_windows long")


def drop_toxic(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` (all its columns) without the rows whose text the network calls toxic, whatever their doc_id."""
    shipped = docs.sparkSession.sparkContext.broadcast((network.words, network.p))
    held: list[Scorer] = []  # of one task

    def clean(texts: pa.Array) -> np.ndarray:
        if not held:
            held.append(Scorer(Network(*shipped.value)))
        return np.concatenate([held[0].scores(texts[a:z].to_pylist()) < 0.5 for a, z in slices_of(texts, 1 << 19)] + [np.zeros(0, bool)])

    return rows_where(docs, clean, held.clear)
