"""The conditional random field: likelihood and Viterbi against enumeration, base patterns against plain search."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from phredlens.llm import secrets as sec


@pytest.fixture(scope="module")
def field():
    return sec.train(sec.generated(n=120), epochs=6)


def test_likelihood_and_gradients_match_enumeration():
    rng = np.random.default_rng(0)
    p = {"move": rng.standard_normal((3, 3)), "start": rng.standard_normal(3)}
    own, mask, tags = rng.standard_normal((2, 4, 3)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool), rng.integers(0, 3, (2, 4))

    def brute(p, own):
        total = 0.0
        for k in range(2):
            n = int(mask[k].sum())
            score = lambda y: p["start"][y[0]] + sum(own[k, t, y[t]] for t in range(n)) + sum(p["move"][y[t - 1], y[t]] for t in range(1, n))  # noqa: B023, E731
            total += np.log(sum(np.exp(score(y)) for y in itertools.product(range(3), repeat=n))) - score(tags[k])
        return total

    loss, g_own, g_move, g_start = sec.likelihood(p, own, mask, tags)
    assert loss == pytest.approx(brute(p, own))
    for target, grad in ((own, g_own), (p["move"], g_move), (p["start"], g_start)):
        for at in np.ndindex(target.shape):
            target[at] += 1e-6
            up = brute(p, own)
            target[at] -= 2e-6
            down = brute(p, own)
            target[at] += 1e-6
            assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(1)
    move, start = rng.standard_normal((3, 3)), rng.standard_normal(3)
    sizes = [1, 5, 2, 5, 7, 1]
    stops = np.cumsum(sizes)
    score = rng.standard_normal((stops[-1], 3))
    got = sec.viterbi(score, stops - sizes, stops, move, start)
    for a, z in zip(stops - sizes, stops, strict=True):
        best = max(itertools.product(range(3), repeat=int(z - a)), key=lambda y: start[y[0]] + sum(score[a + t, c] for t, c in enumerate(y)) + sum(move[y[t], y[t + 1]] for t in range(len(y) - 1)))  # noqa: B023
        assert tuple(got[a:z]) == best


def test_alike_words_have_the_same_features():
    rng = random.Random(2)
    by: dict = {}
    for _ in range(4000):
        w = "".join(rng.choice("abcdefgxyzé") for _ in range(rng.randint(2, 30)))
        for x in (w, w.title(), w.upper()):
            if key := sec.signature(x):
                assert sorted(by.setdefault(key, sec.word_features(x))) == sorted(sec.word_features(x)), x
    assert sec.signature("token") is None and sec.signature("a1") is None


def test_new_secrets_are_found_and_prose_is_left(field):
    right = found = wanted = 0
    for text, spans in sec.generated(seed=77, n=60):
        got = set(sec.field_spans(text, field.decode([sec._TOKEN.findall(text)])))
        right, found, wanted = right + len(got & set(spans)), found + len(got), wanted + len(spans)
    assert right >= 0.9 * found and right >= 0.9 * wanted


def plain(text):
    """The base rules restated on plain regular expressions."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    found.sort()
    kinds = ["assign", "access", "hex"]
    return [sum(k == n for _, k, _ in found) for n in range(3)], ",".join(f"{kinds[k]}:{a}:{z}" for a, k, z in found)


def test_documents(spark, field):
    rng = random.Random(4)
    bits = ["token", "TOKEN=", "Api_Key : ", 'secret":"', "ſecret=abcdefgh", "passwd='", "abcdef", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é ", " ", "\n", "x", "token = token = abcdefgh", "passKword=", "=="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", "word " * 60_000 + "token=abcdef12", "a" * 200_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "token=abcdef12", "x")], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in sec.secrets(docs, field).collect()}
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        counts, spans = plain(t)
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == counts, repr(t)
        assert rows[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        kept = [s for s in rows[i].spans.split(",") if s and not s.startswith("crf")]
        assert ",".join(kept) == spans
    assert sec.secrets(docs.limit(0), field).count() == 0
    assert sec.learn(docs.limit(0), 5).features


def test_all_characters_of_a_word_count():
    assert sec.shape("a" * 100 + "9") == "x9" and sec.shape("aB1-" * 3) == "xX9-~xX9-"
    assert sec.variety("a" * 64 + "bcdefgh") > sec.variety("a" * 71)
