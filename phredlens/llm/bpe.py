"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds, in one pass over a piece, the longest token that starts at every
position. The encoder takes those tokens greedily and keeps one only if it is compatible with the token before it:
two neighbours are compatible when merging their joined bytes gives back just these two. Where no token fits, the
position is marked dead and the encoder backs up, so every position is entered a bounded number of times.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.llm.tables import begin, keep, release_memory, slices_of, text_rows

#: How byte-level vocabularies split text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered per Python worker; the memory is emptied when full, and when a task ends.
REMEMBERED = 250_000


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBPE:
    """Tables of one vocabulary. Inside, tokens are numbered by merge order: the bytes first, then every merge."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        ids = spec["model"]["vocab"]
        order = {raw(c): k for k, c in enumerate(to_byte)}
        names = list(order)
        self.left, self.right, self.merged = list(range(256)), list(range(256)), {}
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
            x, y = order[raw(a)], order[raw(b)]
            token = order.setdefault(raw(a + b), len(names))
            if token == len(names):
                names.append(raw(a + b))
                self.left.append(x)
                self.right.append(y)
            self.merged.setdefault((x, y), token)
        self.size = [len(x) for x in names]
        by_bytes = {raw(s): i for s, i in ids.items()}
        self.public = np.array([by_bytes[x] for x in names], np.uint32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The longest token that is a proper prefix of each token, or -1.
        self.shorter = [next((order[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in order), -1) for x in names]
        self.automaton = ahocorasick.Automaton()
        for x, token in order.items():
            self.automaton.add_word(x.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        special = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.splitter = regex.compile(f"({special})") if special else None
        self.finder = regex.compile(PIECES)
        # Decoding: token i is blob[offset[i] : offset[i + 1]].
        texts = {int(p): x for p, x in zip(self.public, names, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        in_order = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in in_order])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(in_order), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge joins the two sides before both are whole. Merges are undone from the latest back."""
        latest = len(self.size)
        while True:
            if self.merged.get((a, b), latest) < latest:
                return False
            if a > b and a >= 256:
                latest, a = a, self.right[a]
            elif b >= 256:
                # Equal merges apply from the left, so one across the border comes before the same one inside b.
                latest, b = b + 1, self.left[b]
            else:
                return True

    def merge_piece(self, piece: str) -> list[int]:
        """Token numbers (by merge order) of one piece, given as bytes in Latin-1 characters."""
        n = len(piece)
        longest, size, pairs = [-1] * n, self.size, self.pairs
        for end, token in self.automaton.iter(piece):
            start = end + 1 - size[token]
            if longest[start] < 0 or size[token] > size[longest[start]]:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + size[token]]:
                    if not out:
                        break
                    pair = (out[-1], token)
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= REMEMBERED:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(*pair)
                    if fits:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = self.shorter[token]
        return out

    def _piece(self, piece: str) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.public[self.merge_piece(piece.encode("utf-8").decode("latin-1"))].astype("<u4").tobytes()
        if len(piece) <= 64:
            self.known[piece] = found
        return found

    def forget(self) -> None:
        """Python workers outlive a stage; what they remember shouldn't."""
        self.known.clear()
        self.pairs.clear()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.splitter.split(text) if self.splitter else [text]):
            if k % 2:
                out.append(int(self.special[part]).to_bytes(4, "little"))
            else:
                known, miss = self.known.get, self._piece
                out += [known(p) or miss(p) for p in self.finder.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters."""
        out = []
        whole = np.frombuffer(ids, "<u4").astype(np.int64)
        for i in range(0, len(whole), 1 << 16):
            part = whole[i : i + (1 << 16)]
            start = self.offset[part]
            n = self.offset[part + 1] - start
            out.append(self.blob[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def _loaded(vocabulary) -> ByteBPE:
    """One set of tables per Python worker and vocabulary; they go when another operator's task begins there."""
    begin("bpe")
    keep("bpe", _LOADED.clear)
    key = hashlib.sha256(vocabulary.value.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(vocabulary.value)
    return _LOADED[key]


def _vocabulary(spark, path: str):
    """The vocabulary file, of a few MB whatever the corpus, read on the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids is binary, little-endian unsigned 32-bit, of every whole text.

    A null text counts as empty: no ids. Strings of the vocabulary's special tokens become those tokens, as its own
    library has it. Rows are independent: repeated rows repeat, an empty table gives none, other columns are ignored.
    """
    vocabulary = _vocabulary(docs.sparkSession, path)

    def run(batches):
        bpe = _loaded(vocabulary)
        for b in batches:
            ids = [bpe.encode(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        bpe.forget()
        release_memory()

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of a table with ids as ``encode`` returns them; null ids give an empty text."""
    vocabulary = _vocabulary(encoded.sparkSession, path)

    def run(batches):
        bpe = _loaded(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(x.as_py() or b"") for x in b.column("ids")], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked): both directions in one pass over the texts."""
    vocabulary = _vocabulary(docs.sparkSession, path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_ids]

    def run(batches):
        bpe = _loaded(vocabulary)
        for b in batches:
            # Ids take more room than texts, so a batch goes out in parts.
            for a, z in slices_of(b.column("text"), 1 << 22):
                rows = []
                for t in b.column("text")[a:z]:
                    ids = bpe.encode(t.as_py() or "")
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest(), *[ids] * keep_ids))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[a:z], *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names)
        bpe.forget()
        release_memory()

    return text_rows(docs).mapInArrow(run, schema)
