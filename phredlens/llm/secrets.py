"""Secret scans: a linear-chain conditional random field tags tokens as begin, inside or outside of a secret.

Features are a token's shape and look, its neighbours' words and shapes, and features of the whole file. They add up
per distinct token, so a text is scored by table look-ups, and every line is decoded by Viterbi. The field is trained
in numpy on generated lines (many kinds of secrets and of harmless look-alikes) and on a bounded sample of the corpus
with the base patterns as labels. The base patterns are found on their own; the field adds spans that overlap none.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.llm.tables import begin, few_texts, release_memory, slices_of, text_rows

OUT, BEGIN, INSIDE = 0, 1, 2
#: Base patterns by kind: pattern, group whose length counts, least length. Kinds are listed in their output order.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
_COMPILED = {k: re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)) for k, (p, _, _) in BASE.items()}
#: Texts that lack these can't match; they only save time.
_GATES = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
_FIELD = "crf"
_HEX = set("0123456789abcdefABCDEF")
_TOKEN = re.compile(r"\n|[\w+/.-]+|[^\w\s]")
#: Words around secrets; other words count by their shape only.
CONTEXT = "password passwd pwd passphrase secret token key apikey api_key auth authorization bearer basic credential credentials login access private client account session cookie signature sign id user username host commit version sha checksum uuid phone http https www com org href src import return public license isbn order invoice page chapter".split()
_CONTEXT = frozenset(CONTEXT)
SAMPLE_DOCS, EPOCHS = 300, 12
#: Tokens of a sequence in training; a longer line is several sequences in a row, of which every token counts.
LINE_TOKENS = 60
_REMEMBERED = 250_000


def base_spans(text: str, kinds=tuple(BASE)) -> list[tuple[int, int, int]]:
    """(start, stop, kind number) of the base matches in code points, leftmost and non-overlapping per kind."""
    found = []
    for n, kind in enumerate(BASE):
        if kind in kinds:
            _, group, least = BASE[kind]
            found += [(m.start(), m.end(), n) for m in _COMPILED[kind].finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], s[2]))


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secret itself in each base match."""
    out = []
    for kind, (_, group, least) in BASE.items():
        out += [m.span(group) for m in _COMPILED[kind].finditer(text) if len(m[group]) >= least]
    return out


def shape(word: str) -> str:
    """Classes of all characters, runs made one; of a long list its four first and four last, and a mark between."""
    classes = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    runs = re.sub(r"(.)\1+", r"\1", classes)
    return runs if len(runs) <= 8 else f"{runs[:4]}~{runs[-4:]}"


def variety(word: str) -> int:
    """Distinct characters of the word, in eighths of what it could have (64 at most)."""
    return min(8, 8 * len(set(word)) // min(len(word), 64))


def signature(word: str):
    """What alone decides the features of a plain word (letters in lower or title case, no context word); else None."""
    n = len(word)
    if n > 1 and word.isalpha() and (word.islower() or word.istitle()) and word.lower() not in _CONTEXT:
        return (word[0].isupper(), min(n, 48) // 4, n if n < 3 else 3, n >= 12 and (variety(word), set(word) <= _HEX))
    return None


def word_features(word: str) -> list[str]:
    if word == "\n":
        return ["line"]
    if len(word) == 1 and not word.isalnum():
        return ["p:" + word]
    low = word.lower()
    kinds = "".join(k for k, has in (("U", any(c.isupper() for c in word[1:])), ("l", any(c.islower() for c in word)), ("d", any(c.isdigit() for c in word)), ("s", any(not c.isalnum() for c in word))) if has)
    out = ["s:" + shape(word), "k:" + kinds, f"n:{min(len(word), 48) // 4}", f"kn:{kinds}{min(len(word), 48) // 8}"]
    out += ["w:" + part for part in set(re.split(r"[_.\-/+]", low)) if part in _CONTEXT]
    if "d" in kinds or "U" in kinds:
        out.append("b:" + word[:4])
    if len(word) >= 12:
        out.append(f"u:{variety(word)}")
        if set(word) <= _HEX:
            out.append("hex")
        if re.search("[a-z][A-Z]|[A-Z][a-z]{0,2}[A-Z0-9]|[0-9][A-Za-z][0-9]", word):
            out.append("mixed")
    return out


def flags(word: str) -> tuple[int, int, int]:
    """What a token adds to its file's features: token, with a digit, assignment mark."""
    return int(word != "\n"), int(any(c.isdigit() for c in word)), int(word in "=:" and word != "")


def file_features(sums: np.ndarray) -> np.ndarray:
    """0/1 features of files from their flag sums (rows): many digits, many assignments, none, short."""
    n = np.maximum(sums[:, 0], 1)
    return np.stack([sums[:, 1] > 0.05 * n, sums[:, 2] > 0.03 * n, sums[:, 2] == 0, n < 60], axis=1).astype(np.float64)


#: Where a feature looks from: the token itself, the one before, two before, and after.
ROLES = (0, -1, -2, 1)


class Field:
    """Weights: features by role and tag, file features by tag, transitions, and start scores."""

    def __init__(self, features: dict[str, int]):
        n = len(features) + 1  # 0: any unknown feature, weight zero
        self.features = features
        self.p = {"w": np.zeros((n, len(ROLES), 3)), "file": np.zeros((4, 3)), "move": np.zeros((3, 3)), "start": np.zeros(3)}
        self._reset()

    def _reset(self):
        self.rows: dict[str, int] = {}
        self.alike: dict[tuple, int] = {}
        self.table, self.flag, self.used = np.zeros((64, len(ROLES), 3)), np.zeros((64, 3)), 0

    def numbered(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys([*words, "\n"]) if w not in self.rows]
        if len(self.rows) + len(new) > _REMEMBERED and self.rows:
            self._reset()
            new = list(dict.fromkeys([*words, "\n"]))
        for word in new:
            key = signature(word)
            row = self.alike.get(key) if key else None
            if row is None:
                row, self.used = self.used, self.used + 1
                if row == len(self.table):
                    self.table, self.flag = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.flag, np.zeros_like(self.flag)])
                self.table[row] = self.p["w"][[self.features.get(f, 0) for f in word_features(word)]].sum(axis=0)
                self.flag[row] = flags(word)
                if key:
                    self.alike[key] = row
            self.rows[word] = row
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def decode(self, texts: list[list[str]]) -> np.ndarray:
        """Tags of all tokens of all texts, each line decoded by Viterbi. ``texts``: tokens, line breaks among them."""
        ends = np.cumsum([len(t) for t in texts])
        words = [w for t in texts for w in t]
        if not words:
            return np.zeros(0, np.int64)
        ids = self.numbered(words)
        edge = self.rows["\n"]
        sums = np.concatenate([np.zeros((1, 3)), np.cumsum(self.flag[ids], axis=0)])[np.concatenate([[0], ends])]
        of_file = file_features(np.diff(sums, axis=0)) @ self.p["file"]
        doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
        score = of_file[doc]
        n = len(ids)
        for role, shift in enumerate(ROLES):
            at = np.arange(n) + shift
            inside = (at >= 0) & (at < n)
            inside[inside] = doc[at[inside]] == doc[inside]
            score += self.table[np.where(inside, ids[np.clip(at, 0, n - 1)], edge), role]
        breaks = np.flatnonzero(ids == edge)
        starts = np.unique(np.concatenate([[0], ends[:-1], breaks + 1]))
        starts = starts[starts < n]
        stops = np.append(starts[1:], n)
        return viterbi(score, starts, stops, self.p["move"], self.p["start"])


def viterbi(score: np.ndarray, starts: np.ndarray, stops: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags of the sequences [starts, stops) over rows of ``score``; the lower tag wins ties."""
    order = np.argsort(starts - stops, kind="stable")
    begin, size = starts[order], (stops - starts)[order]
    active = np.searchsorted(-size, -np.arange(size[0]) - 1, "right")  # sequences longer than t
    back = np.zeros(score.shape, np.int8)
    best = score[begin] + start
    final = np.zeros(len(begin), np.int64)
    tags = np.zeros(len(score), np.int64)
    for t in range(1, int(size[0])):
        k = active[t]
        done = active[t - 1]
        final[k:done] = best[k:done].argmax(axis=1)
        at = begin[:k] + t
        options = best[:k, :, None] + move
        choice = options.argmax(axis=1)
        back[at] = choice
        best = np.take_along_axis(options, choice[:, None, :], axis=1)[:, 0] + score[at]
    final[: len(best)] = best.argmax(axis=1)
    tag = np.zeros(len(begin), np.int64)
    for t in range(int(size[0]) - 1, -1, -1):
        k = active[t]
        ends_here = size[:k] == t + 1
        tag[:k] = np.where(ends_here, final[:k], tag[:k])
        at = begin[:k] + t
        tags[at] = tag[:k]
        if t:
            tag[:k] = back[at, tag[:k]]
    return tags


def likelihood(p, own: np.ndarray, mask: np.ndarray, tags: np.ndarray):
    """Negative log likelihood of padded sequences and its gradients by score, transition and start."""
    count, steps, _ = own.shape
    safe = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    alpha, beta = np.zeros_like(own), np.zeros_like(own)
    alpha[:, 0] = own[:, 0] + p["start"]
    for t in range(1, steps):
        alpha[:, t] = np.where(mask[:, t, None], safe(alpha[:, t - 1, :, None] + p["move"], 1) + own[:, t], alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        beta[:, t] = np.where(mask[:, t + 1, None], safe(p["move"] + (own[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
    whole = safe(alpha[:, -1], 1)
    marginal = np.exp(alpha + beta - whole[:, None, None]) * mask[..., None]
    rows = np.arange(count)
    g_own = marginal.copy()
    g_start, g_move = marginal[:, 0].sum(axis=0), np.zeros((3, 3))
    gold = p["start"][tags[:, 0]] + own[rows, 0, tags[:, 0]]
    np.add.at(g_start, tags[:, 0], -1)
    for t in range(steps):
        g_own[rows, t, tags[:, t]] -= mask[:, t]
        if t:
            m = mask[:, t]
            pair = np.exp(alpha[:, t - 1, :, None] + p["move"] + (own[:, t] + beta[:, t])[:, None, :] - whole[:, None, None])
            g_move += (pair * m[:, None, None]).sum(axis=0)
            np.add.at(g_move, (tags[m, t - 1], tags[m, t]), -1)
            gold += m * (p["move"][tags[:, t - 1], tags[:, t]] + own[rows, t, tags[:, t]])
    return float((whole - gold).sum()), g_own, g_move, g_start


def generated(seed: int = 3, n: int = 260) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with their secret spans: prose, settings, code, headers; and harmless look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, a, b: "".join(rng.choice(list(alphabet), rng.integers(a, b + 1)))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(lower, 1, 9)
    prose = lambda a, b: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(rng.integers(a, b)))
    base64 = lower + upper + digit + "+/"
    values = [
        lambda: pick(lower + upper + digit, 16, 40), lambda: pick("0123456789abcdef", 24, 64), lambda: pick("0123456789ABCDEF", 32, 64), lambda: "AKIA" + pick(upper + digit, 16, 16),
        lambda: rng.choice(["ghp_", "gho_", "sk-", "pk_live_", "sk_live_", "xoxb-", "glpat-", "npm_"]) + pick(lower + upper + digit, 20, 40), lambda: "eyJ" + pick(base64, 16, 30) + ".eyJ" + pick(base64, 20, 60) + "." + pick(base64, 20, 43),
        lambda: pick(lower, 3, 7) + pick(digit, 2, 4) + rng.choice(["", "_", "-"]) + pick(lower + upper, 1, 5), lambda: pick(base64, 28, 60),
    ]
    quote = lambda v: rng.choice(["", '"', "'"], p=[0.4, 0.4, 0.2])
    names = "password passwd pwd passphrase secret token api_key apikey access_key client_secret auth_token private_key session_token".split()
    harmless = [
        lambda: f"+{pick(digit, 1, 2)} ({pick(digit, 3, 3)}) {pick(digit, 3, 3)}-{pick(digit, 4, 4)}", lambda: f"https://www.{word()}.com/{word()}/{word()}-{word()}.html", lambda: f"{word()}.{word()}@{word()}.org", lambda: f"version {pick(digit, 1, 2)}.{pick(digit, 1, 2)}.{pick(digit, 1, 2)}",
        lambda: f"ISBN {pick(digit, 13, 13)}", lambda: f"{word()} = {pick(digit, 1, 5)}", lambda: f"import {word()}.{word()}", lambda: f"invoice {pick(upper, 2, 3)}-{pick(digit, 5, 8)}", lambda: f"the {rng.choice(['password', 'token', 'secret', 'key'])} {rng.choice(['is', 'was', 'of', 'must'])} {prose(2, 6)}", lambda: f"{pick(upper, 3, 9)} {pick(upper, 3, 9)}",
        lambda: f"{pick(digit, 4, 4)}-{pick(digit, 2, 2)}-{pick(digit, 2, 2)}T{pick(digit, 2, 2)}:{pick(digit, 2, 2)}", lambda: "".join(word() for _ in range(5)), lambda: " | ".join(word() for _ in range(6)), lambda: f"{word()}*** {word()}### {word()}%%%", lambda: f"{pick(digit, 3, 3)}.{pick(digit, 1, 3)}.{pick(digit, 1, 3)}.{pick(digit, 1, 3)}", lambda: f"/usr/{word()}/{word()}_{word()}.{word()}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(2, 9)):
            kind = rng.random()
            if kind < 0.4:
                text += prose(3, 25)
            elif kind < 0.65:
                text += (prose(1, 8) + " ") * int(rng.random() < 0.5) + harmless[rng.integers(len(harmless))]() + (" " + prose(1, 8)) * int(rng.random() < 0.5)
            else:
                v = values[rng.integers(len(values))]()
                style, q = rng.integers(6), str(quote(v))
                name = str(rng.choice(names))
                name = name.upper() if rng.random() < 0.25 else name
                before, after = [(f"{name}{q if q and style == 0 else ''}{rng.choice([' = ', '=', ': ', ':'])}{q}", q), (f"Authorization: {rng.choice(['Bearer', 'Basic', 'token'])} ", ""), (f"https://{word()}:", f"@{word()}.com/{word()}"), (f"export {name.upper()}={q}", q), (f"my {name} is {q}", q), (f'{{"{name}": "', '"}')][style]
                if style in (4, 1) and len(v) < 12:
                    v += pick(digit, 6, 8)
                text += (prose(1, 8) + " ") * int(rng.random() < 0.5) + before
                spans.append((len(text), len(text) + len(v)))
                text += v + after + (" " + prose(1, 8)) * int(rng.random() < 0.5)
            text += "\n"
        out.append((text, spans))
    return out


def tagged(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    words, tags, spans, last = [], [], sorted(spans), None
    for m in _TOKEN.finditer(text):
        inside = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None) if m[0] != "\n" else None
        tags.append(OUT if inside is None else INSIDE if inside == last else BEGIN)
        words.append(m[0])
        last = inside
    return words, tags


def train(examples: list[tuple[str, list[tuple[int, int]]]], epochs: int = EPOCHS, seed: int = 5) -> Field:
    """A field from texts and their secret spans, by Adam on the L2-penalised likelihood; lines are the sequences."""
    parsed = [tagged(t, s) for t, s in examples]
    seen = Counter(f for words, _ in parsed for w in set(words) for f in word_features(w))
    field = Field({f: k + 1 for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 2))})
    sequences = []  # (features by position, file features, tags)
    for words, tags in parsed:
        of_file = file_features(np.array([flags(w) for w in words], float).reshape(-1, 3).sum(axis=0, keepdims=True))[0]
        coded = [[field.features.get(f, 0) for f in word_features(w)] for w in words]
        edge = [field.features.get("line", 0)]
        at = 0
        while at < len(words):
            stop = next((k + 1 for k in range(at, min(len(words), at + LINE_TOKENS)) if words[k] == "\n"), min(len(words), at + LINE_TOKENS))
            around = [[coded[k + s] if 0 <= k + s < len(coded) else edge for s in ROLES] for k in range(at, stop)]
            sequences.append((around, of_file, tags[at:stop]))
            at = stop
    rng, p = np.random.default_rng(seed), field.p
    moments, tick = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}, 0
    for epoch in range(epochs if sequences else 0):
        order = rng.permutation(len(sequences))
        order = order[np.argsort([len(sequences[k][2]) // 8 for k in order], kind="stable")]
        batches = [order[i : i + 64] for i in range(0, len(order), 64)]
        for b in rng.permutation(len(batches)):
            part = [sequences[k] for k in batches[b]]
            steps = max(len(t) for _, _, t in part)
            mask, tags = np.zeros((len(part), steps), bool), np.zeros((len(part), steps), np.int64)
            index = []
            for k, (around, _, t) in enumerate(part):
                mask[k, : len(t)], tags[k, : len(t)] = True, t
                index += [(f, r, k, pos) for pos, by_role in enumerate(around) for r, fs in enumerate(by_role) for f in fs]
            f, r, k, pos = np.array(index).T
            own = np.repeat((np.array([x for _, x, _ in part]) @ p["file"])[:, None], steps, axis=1)
            np.add.at(own, (k, pos), p["w"][f, r])
            _, g_own, g_move, g_start = likelihood(p, own, mask, tags)
            g = {"w": np.zeros_like(p["w"]), "file": np.array([x for _, x, _ in part]).T @ g_own.sum(axis=1), "move": g_move, "start": g_start}
            np.add.at(g["w"], (f, r), g_own[k, pos])
            g["w"][0] = 0
            tick += 1
            for name in p:
                v = g[name] / len(part) + 1e-4 * p[name]
                m, s = moments[name]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                p[name] -= 0.05 * 0.8**epoch * (m / (1 - 0.9**tick)) / (np.sqrt(s / (1 - 0.99**tick)) + 1e-8)
    field._reset()
    return field


def learn(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Field:
    """Train on generated texts and about ``sample`` documents (by hash of doc_id) with the base matches as secrets; twice
    as many at most, and so many bytes as ``few_texts`` has it, whatever the corpus repeats."""
    known = docs.where("text is not null and doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    total = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < (sample / total if total else 0))
    return train(generated() + [(t, value_spans(t)) for _, t in few_texts(chosen, 2 * sample)])


def field_spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """Spans in code points; a span inside a secret that nothing begins is a secret too."""
    out: list[tuple[int, int]] = []
    last = OUT
    for m, tag in zip(_TOKEN.finditer(text), tags.tolist(), strict=True):
        if tag == BEGIN or (tag == INSIDE and last == OUT):
            out.append(m.span())
        elif tag == INSIDE:
            out[-1] = (out[-1][0], m.end())
        last = tag if m[0] != "\n" else OUT
    return out


def scan(field: Field, texts: list[str], gates: dict[str, np.ndarray]) -> list[tuple]:
    """(n_assign, n_access, n_hex, base spans, all spans) of each text; gates: may the text match a base kind."""
    words = [_TOKEN.findall(t) for t in texts]
    tags = field.decode(words)
    ends = np.cumsum([0, *map(len, words)])
    names, out = [*BASE, _FIELD], []
    for k, text in enumerate(texts):
        base = base_spans(text, [x for x in BASE if gates[x][k]])
        own = tags[ends[k] : ends[k + 1]]
        more = [(a, z, len(BASE)) for a, z in field_spans(text, own) if not any(a < s[1] and s[0] < z for s in base)] if own.any() else []
        label = lambda spans: ",".join(f"{names[n]}:{a}:{z}" for a, z, n in spans)
        counts = Counter(s[2] for s in base)
        out.append((counts[0], counts[1], counts[2], label(base), label(sorted(base + more, key=lambda s: (s[0], s[2])))))
    return out


def secrets(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_field.

    Whole texts are scanned. Offsets are code points, ends exclusive, kinds in the order assign, access, hex, crf. A
    null text counts as empty: no spans, and the digest of the empty string. Rows are independent: repeated rows
    repeat, an empty table gives none, other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((field.features, field.p))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        begin()
        features, p = shipped.value
        own = Field(features)
        own.p = p
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            rows = []
            for a, z in slices_of(texts):
                part = texts[a:z]
                gates = {k: np.asarray(pc.match_substring_regex(part, pattern=g)) for k, g in _GATES.items()}
                rows += scan(own, part.to_pylist(), gates)
            digest = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest(), r[4], r[4].count(_FIELD + ":")) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in digest], kind) for k, kind in enumerate(kinds))], names)
        del own
        release_memory()

    return text_rows(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_field long")
