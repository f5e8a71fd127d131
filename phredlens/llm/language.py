"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of the pieces' probabilities; a forward pass over the word's bytes
takes that sum for all languages at once. A text scores the product over its words.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.llm.bpe import byte_alphabet
from phredlens.llm.decontaminate import tokens
from phredlens.llm.tables import begin, few_texts, release_memory, slices_of, text_rows

#: Documents of each language that learning takes, about, and documents of all; languages, more than the world has.
SAMPLE_DOCS, SAMPLE_ALL, MAX_LANGUAGES = 500, 20_000, 8192
#: Bytes of a word that are learned from in one go, and numbers of the tables of one go.
SPAN, _CELLS = 40, 4_000_000
EM_ROUNDS, SMOOTHING = 5, 0.05
UNKNOWN = "und"
#: Numbers kept for words a Python worker has met.
_REMEMBERED = 3_200_000
_LETTER = regex.compile(r"\p{L}")


class Pieces:
    """The vocabulary as bytes (in Latin-1 characters); a word starts with a space."""

    def __init__(self, vocabulary: str):
        to_byte = byte_alphabet()
        names = sorted({"".join(chr(to_byte[c]) for c in s) for s in json.loads(vocabulary)["model"]["vocab"]} | {chr(b) for b in range(256)})
        self.names = names
        self.longest = max(map(len, names))
        self.automaton = ahocorasick.Automaton()
        for k, name in enumerate(names):
            self.automaton.add_word(name, (k, len(name)))
        self.automaton.make_automaton()

    def lattice(self, words: list[str]):
        """(word, start, stop, piece) of all pieces of all words, by stop, then word. One pass over the joined words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        found = np.array([(end, *piece) for end, piece in self.automaton.iter("Ā".join(words))], np.int64).reshape(-1, 3)
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        word = np.searchsorted(first, found[:, 0], "right") - 1
        stop = found[:, 0] + 1 - first[word]
        order = np.lexsort((word, stop))
        return word[order], (stop - found[:, 2])[order], stop[order], found[order, 1], sizes


def _by_stop(stop: np.ndarray, most: int) -> np.ndarray:
    return np.searchsorted(stop, np.arange(1, most + 2))


def forward(lattice, probs: np.ndarray, longest: int):
    """(alpha, scale): alpha[w, j] is the sum over all cuts of the first j bytes, times exp(scale[w, j])."""
    word, start, stop, piece, sizes = lattice
    most = int(sizes.max(initial=0))
    alpha = np.zeros((len(sizes), most + 1, probs.shape[1]))
    alpha[:, 0] = 1
    scale = np.zeros((len(sizes), most + 1))
    edges = _by_stop(stop, most)
    for j in range(1, most + 1):
        part = slice(edges[j - 1], edges[j])
        w = word[part]
        if not len(w):
            continue
        begin = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        terms = alpha[w, start[part]] * probs[piece[part]]
        # Terms of one word may start in places of unlike scale; all are brought to the scale of the place before.
        terms *= np.exp(scale[w, start[part]] - scale[w, j - 1])[:, None]
        own = w[begin]
        total = np.add.reduceat(terms, begin, axis=0)
        top = total.max(axis=1)
        alpha[own, j] = total / top[:, None]
        scale[own, j] = scale[own, j - 1] + np.log(top)
    return alpha, scale


def log_probabilities(pieces: Pieces, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows) in each language, by batches of like length."""
    out = np.empty((len(words), probs.shape[1]))
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    at = 0
    while at < len(order):
        n = len(words[order[at]])
        stop = at + 1
        while stop < len(order) and len(words[order[stop]]) <= n + 8 and (stop - at) * (n + 8) * probs.shape[1] < 2_000_000:
            stop += 1
        part = order[at:stop]
        lattice = pieces.lattice([words[k] for k in part])
        alpha, scale = forward(lattice, probs, pieces.longest)
        last = lattice[4]
        rows = np.arange(len(part))
        out[part] = np.log(np.maximum(alpha[rows, last], 1e-300)) + scale[rows, last][:, None]
        at = stop
    return out


def expected_counts(pieces: Pieces, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (rows) in each language over all cuts; weights: occurrences, words by languages."""
    out = np.zeros_like(probs)
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    i = 0
    while i < len(order):
        n = max(1, min(20_000, len(order) - i))
        while n > 1 and n * (len(words[order[i + n - 1]]) + 1) * probs.shape[1] > _CELLS:
            n = (n + 1) // 2
        part = order[i : i + n]
        i += n
        word, start, stop, piece, sizes = pieces.lattice([words[k] for k in part])
        most = int(sizes.max())
        alpha, beta = np.zeros((len(part), most + 1, probs.shape[1])), np.zeros((len(part), most + 1, probs.shape[1]))
        alpha[:, 0] = 1
        beta[np.arange(len(part)), sizes] = 1
        edges = _by_stop(stop, most)
        for j in range(1, most + 1):
            e = slice(edges[j - 1], edges[j])
            if edges[j] > edges[j - 1]:
                begin = np.flatnonzero(np.append(True, word[e][1:] != word[e][:-1]))
                alpha[word[e][begin], j] = np.add.reduceat(alpha[word[e], start[e]] * probs[piece[e]], begin, axis=0)
        back = np.lexsort((word, start))
        froms = np.searchsorted(start[back], np.arange(most + 1))
        for j in range(most - 1, -1, -1):
            e = back[froms[j] : froms[j + 1]]
            if len(e):
                begin = np.flatnonzero(np.append(True, word[e][1:] != word[e][:-1]))
                beta[word[e][begin], j] += np.add.reduceat(beta[word[e], stop[e]] * probs[piece[e]], begin, axis=0)
        whole = np.maximum(alpha[np.arange(len(part)), sizes], 1e-300)
        uses = alpha[word, start] * probs[piece] * beta[word, stop] * (weights[part] / whole)[word]
        by_piece = np.argsort(piece, kind="stable")
        used, begin = np.unique(piece[by_piece], return_index=True)
        out[used] += np.add.reduceat(uses[by_piece], begin, axis=0)
    return out


def spelled(word: bytes) -> str:
    return " " + word.decode("latin-1")


def fit(pieces: Pieces, texts: list[str], langs: list[str], rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities by language) by expectation maximisation over the words of labelled texts.

    Longer words are learned from in consecutive spans of ``SPAN`` bytes, so every byte takes part."""
    names = sorted(set(langs))
    number = {x: k for k, x in enumerate(names)}
    counts: dict[str, np.ndarray] = {}
    for text, lang in zip(texts, langs, strict=True):
        for w in tokens(text):
            for part in (spelled(w)[i : i + SPAN] for i in range(0, len(w) + 1, SPAN)):
                if part not in counts:
                    counts[part] = np.zeros(len(names))
                counts[part][number[lang]] += 1
    words = sorted(counts)
    probs = np.full((len(pieces.names), len(names)), 1.0)
    # At the start a piece is the likelier the longer it is, so that cuts into few pieces lead.
    probs *= np.array([len(x) ** 2 for x in pieces.names], float)[:, None]
    probs /= probs.sum(axis=0)
    for _ in range(rounds if words else 0):
        probs = expected_counts(pieces, words, np.array([counts[w] for w in words]), probs) + SMOOTHING
        probs /= probs.sum(axis=0)
    return names, probs


class Identifier:
    def __init__(self, vocabulary: str, names: list[str], probs: np.ndarray):
        self.pieces, self.names, self.probs = Pieces(vocabulary), names, probs
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((0, len(names)))

    def numbered(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if (len(self.rows) + len(new)) * (len(self.names) + 4) > _REMEMBERED and self.rows:
            self.rows, self.table = {}, np.zeros((0, len(self.names)))
            new = list(dict.fromkeys(words))
        if new:
            at = len(self.rows)
            if at + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(new)), len(self.names)))])
            self.table[at : at + len(new)] = log_probabilities(self.pieces, [spelled(w) for w in new], self.probs)
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability (all languages alike beforehand) of each whole text."""
        words = [tokens(t) for t in texts]
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names:
            return langs, scores
        ids = self.numbered([w for x in words for w in x])
        sums = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(self.table[ids], axis=0)])
        ends = np.cumsum([0, *map(len, words)])
        total = sums[ends[1:]] - sums[ends[:-1]]
        for k, t in enumerate(texts):
            if t is not None and _LETTER.search(t):
                p = np.exp(total[k] - total[k].max())
                best = int(p.argmax())
                langs[k], scores[k] = self.names[best], float(p[best] / p.sum())
        return langs, scores


def held_out() -> F.Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0


def learn(docs: DataFrame, vocabulary: str, sample: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Fit on about ``sample`` documents of each language, ``SAMPLE_ALL`` of all, none held out.

    A document is taken if the hash of its doc_id is below its language's share, so the sample is the same on every
    run and its size doesn't grow with the corpus: in rows, and in bytes as ``few_texts`` has it. Rows that repeat
    count once. Every language that has a label is learned, up to ``MAX_LANGUAGES``, more than there are; the model's
    size grows with their number.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return [], np.zeros((0, 0))
    each = min(sample, max(1, SAMPLE_ALL // len(sizes)))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in sizes], "__phl_lang string, __phl_share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(share), F.col("lang") == F.col("__phl_lang")).where(place < F.col("__phl_share"))
    rows = few_texts(chosen.select("doc_id", F.col("text").cast("string").alias("text"), "lang"), 2 * SAMPLE_ALL)
    return fit(Pieces(vocabulary), [r[1] for r in rows], [r[2] for r in rows])


def languages(docs: DataFrame, vocabulary_path: str, sample: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (posterior probability of lang_pred).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned. A
    null doc_id isn't held out and teaches nothing. Rows are independent: repeated rows repeat, an empty table gives
    none, other columns are ignored.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, *learn(docs, vocabulary, sample)))

    def run(batches):
        begin()
        model = Identifier(*shipped.value)
        for b in batches:
            texts, langs, scores = b.column("text"), [], []
            for a, z in slices_of(texts, 1 << 20):
                one, two = model.predict(texts[a:z].to_pylist())
                langs += one
                scores.append(two)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        del model
        release_memory()

    rows = text_rows(docs, F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
