"""License scans in DataFrame functions only: base phrases by word place, and ordered signature rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phredlens.llm.license_rules import ROOTS, Rule, rules

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BASE_CONFIDENCE = 0.5
#: Letters that are lower-cased; places stay what they are in the text.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MATCH = "array<struct<start:int,stop:int,priority:int,label:string,confidence:double>>"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever number of times the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_places(words: Column, phrase: str) -> Column:
    """Starts of the phrase in an array of words."""
    parts = phrase.split(" ")
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))
    same = lambda i: _all([F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.filter(at, same)


def labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def rule_matches(text: Column, rule: Column) -> Column:
    """All matches of one rule: between the pieces that a split leaves, the found strings stand in order."""
    pair = F.struct(F.split(text, rule["regex"], -1).alias("rest"), F.regexp_extract_all(text, rule["regex"], F.lit(0)).alias("found"))

    def placed(p):
        start = F.struct(F.length(F.get(p["rest"], F.lit(0))).alias("at"), F.array().cast(_MATCH).alias("out"))

        def step(state, i):
            stop = state["at"] + F.length(F.get(p["found"], i))
            match = F.struct(state["at"].alias("start"), stop.alias("stop"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))
            return F.struct((stop + F.length(F.get(p["rest"], i + 1))).alias("at"), F.concat(state["out"], F.array(match)).alias("out"))

        places = F.when(F.size(p["found"]) > 0, F.sequence(F.lit(0), F.size(p["found"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda s: s["out"])

    return bound(pair, placed)


def specific(matches: Column, loose: list[int]) -> Column:
    """Matches without those of loose rules that overlap a match of another rule, so no name is swallowed by them."""
    is_loose = lambda m: m["priority"].isin(loose)
    hidden = lambda all_, m: F.exists(all_, lambda o: ~is_loose(o) & (o["start"] < m["stop"]) & (m["start"] < o["stop"]))
    return bound(matches, lambda all_: F.filter(all_, lambda m: ~is_loose(m) | ~hidden(all_, m)))


def resolved(matches: Column) -> Column:
    """Matches left after suppression, from left to right.

    Matches rank by priority, then the longer first, then from the left, then by label. A match stays unless it overlaps,
    or lies in, one of better rank that stays; what a suppressed match overlaps isn't suppressed by it.
    """
    ranked = F.array_sort(F.transform(matches, lambda m: F.struct(m["priority"].alias("priority"), (m["start"] - m["stop"]).alias("short"), m["start"].alias("start"), m["label"].alias("label"), m["stop"].alias("stop"), m["confidence"].alias("confidence"))))
    back = lambda m: F.struct(*(m[c].alias(c) for c in ("start", "stop", "priority", "label", "confidence")))

    def step(kept, m):
        free = ~F.exists(kept, lambda o: (o["start"] < m["stop"]) & (m["start"] < o["stop"]))
        return F.when(free, F.concat(kept, F.array(back(m)))).otherwise(kept)

    return F.array_sort(F.aggregate(ranked, F.array().cast(_MATCH), step))


def license_scan(docs: DataFrame, signature_rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A match of a loose rule goes where it overlaps one of another rule. spans are the rule matches left (start and stop in code points, rule number as priority, label, confidence).
    score is the largest confidence of a span, or ``BASE_CONFIDENCE`` where a base phrase stands, or 0. One narrow
    projection: no shuffle, no Python. A null text counts as empty: no words, null places, empty labels, score 0.
    Ties: places of equal base phrases all count, the smallest and largest start are told, and of matches of equal rank
    one stays (see ``resolved``). Rows are independent: repeated rows repeat, an empty table gives none, other columns are
    ignored.
    """
    known = rules() if signature_rules is None else signature_rules
    loose = [k for k, r in enumerate(known) if r.loose]
    by_keyword: dict[str, list[Column]] = {}
    for k, r in enumerate(known):
        by_keyword.setdefault(r.keyword, []).append(F.struct(F.lit(k).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence"), F.lit(r.regex).alias("regex")))
    # A keyword is looked for once for all its rules, and a rule's matches are laid out only if it has one.
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*x).alias("rules")) for k, x in by_keyword.items()])
    tried = lambda t: F.flatten(F.transform(F.filter(table, lambda g: F.contains(t, g["keyword"])), lambda g: g["rules"]))
    low = docs.select(F.col("doc_id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower()).alias("low"))
    norm = F.trim(F.regexp_replace("low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    wanted = F.lit(False)
    for root in ROOTS:
        wanted = wanted | F.contains("low", F.lit(root))
    found = F.when(wanted, bound(F.col("low"), lambda t: F.flatten(F.transform(F.filter(tried(t), lambda r: F.rlike(t, r["regex"])), lambda r: rule_matches(t, r)))))
    step = low.select("doc_id", norm.alias("norm"), F.coalesce(found, F.array().cast(_MATCH)).alias("found"))
    some = F.lit(False)
    for phrase, _ in PHRASES:
        some = some | F.contains("norm", F.lit(phrase))
    places = bound(
        F.split("norm", " "),
        lambda w: F.concat(*[labelled(word_places(w, phrase), label) for phrase, label in PHRASES]),
    )
    step = step.select(
        "doc_id",
        F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.coalesce(F.when(some, places), F.array().cast("array<struct<at:int,label:string>>")).alias("base"),
        F.when(F.size("found") > 0, resolved(specific(F.col("found"), loose))).otherwise(F.array().cast(_MATCH)).alias("spans"),
    )
    joined = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    base_score = F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0)
    return step.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.at")).cast("long").alias("first_word"),
        F.array_max(F.col("base.at")).cast("long").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.col("base.label"), F.col("spans.label")).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.col("spans.confidence")), F.lit(0.0)), base_score).alias("score"),
        "spans",
    )
