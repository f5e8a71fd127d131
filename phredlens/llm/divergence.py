"""Divergence of sources: how far the words of each source stray from those of every other source of its language.

Plain relational: matches are exploded and counted by group, groups meet the kept vocabulary so that words a group lacks
count as zero, the dense counts meet themselves on language and term, and windows rank the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phredlens.llm.tables import stage, unstage

#: A term of a lower-cased text is a run of ASCII letters and of characters beyond ASCII.
TERM = r"[a-z\x80-\x{10FFFF}]+"
#: Documents of a language that a kept term stands in, at least; parts of a whole; ranks of terms that are told.
MIN_DOCS, WHOLE, TOP_TERMS = 3, 1_000_000_000, 200
#: Counts below this keep their product with ``WHOLE`` inside a long.
LONG_COUNTS = (2**63 - 1) // WHOLE
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spread_join(many: DataFrame, few: DataFrame, by: list[str], spread: str) -> DataFrame:
    """``many`` and ``few`` inner-joined on ``by``, keys of few values. A row of ``many`` goes to one of as many places as
    there are shuffle partitions by its ``spread``, and ``few`` to all of them, so a key of any size is dealt out."""
    places = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = many.withColumn("__phl_place", F.pmod(F.xxhash64(spread), F.lit(places)).cast("int"))
    right = few.withColumn("__phl_place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    return left.join(right, [*by, "__phl_place"]).drop("__phl_place")


def numbered(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """(groups: lang, source, l, g; columns l and g of any rows): numbers of 64 bits for languages and groups. They are
    hashes under a seed for which no two languages and no two groups have the same, which is counted."""
    names = stage(rows.select("lang", "source").distinct())
    for seed in range(100):
        numbers = [F.xxhash64(F.lit(seed), "lang").alias("l"), F.xxhash64(F.lit(seed), "lang", F.lit("source"), "source").alias("g")]
        groups = names.select("lang", "source", *numbers)
        n = groups.agg(F.countDistinct("lang"), F.countDistinct("l"), F.count(F.lit(1)), F.countDistinct("g")).first()
        if n[0] == n[1] and n[2] == n[3]:
            return groups, numbers
    raise ValueError("no seed tells the groups apart")


def term_counts(rows: DataFrame, numbers: list[Column]) -> DataFrame:
    """(l, g, term, n, docs): occurrences of a term in a group, and documents that have it.

    Only A-Z are lower-cased. A row's terms are sorted inside the row, so the first of equal ones counts the document;
    both counts are combined before they move.
    """
    ascii_only = F.octet_length("text") == F.length("text")
    low = F.when(ascii_only, F.lower("text")).otherwise(F.translate("text", _UPPER, _UPPER.lower()))
    terms = rows.select(*numbers, F.sort_array(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("terms"))
    before = F.concat(F.array(F.lit(None).cast("string")), "terms")
    each = terms.select("l", "g", F.inline(F.arrays_zip(F.col("terms").alias("term"), before.alias("before")))).where("term is not null")
    return each.groupBy("l", "g", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("docs"))


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + size)), exact: a product that a long can't hold is a decimal."""
    product = F.lit(WHOLE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    large = F.call_function("div", product, (total + size).cast("decimal(19,0)"))
    small = F.call_function("div", F.lit(WHOLE).cast("long") * (count + 1), total + size)
    return F.when(count < LONG_COUNTS, small).otherwise(large) + 1


def strain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares, which are at most 10^9 + 1 and at least 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every group (lang, source) that occurs.

    Part ``pair`` has a row for every other source of the language: the strain of the group's shares against that
    source's, summed over the language's kept terms. Part ``term`` has the terms of the group whose share is above the
    language's, with that strain, the ``top_terms`` largest. Ranks count from 1, the largest value first, ties by the
    item's bytes. Shares count a term one more than it occurs, of parts of 10^9.

    Null text, lang and source count as empty, and an empty lang or source is a group like others; a group without a
    term, or a language without a kept term, has pairs of value 0. Every row is a document, rows that repeat too. An empty
    table gives no rows; other columns are ignored. Results grow with the square of the sources of a language, as asked.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    names, numbers = numbered(rows)
    counts = stage(term_counts(rows, numbers))
    words = counts.groupBy("l", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    vocabulary = stage(words.select("l", "term", "lang_n"))
    kept = stage(counts.join(vocabulary, ["l", "term"]).select("l", "g", "term", "n", "lang_n"))
    unstage(counts)
    langs = vocabulary.groupBy("l").agg(F.count(F.lit(1)).alias("size"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("g").agg(F.sum("n").alias("total"))
    some = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    found = names.join(totals, "g", "left").join(langs, "l", "left")
    groups = stage(found.select("lang", "source", "l", "g", some("total"), some("size"), some("lang_total")))

    every = spread_join(vocabulary.select("l", "term"), groups.select("l", "g", "total", "size"), ["l"], "term")
    dense = every.join(kept.select("l", "g", "term", "n"), ["l", "g", "term"], "left")
    shares = stage(dense.select("l", "term", "g", share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("size")).alias("p")))
    met = shares.join(shares.select("l", "term", F.col("g").alias("other"), F.col("p").alias("q")), ["l", "term"]).where(F.col("g") != F.col("other"))
    sums = met.groupBy("g", "other").agg(F.sum(strain(F.col("p"), F.col("q"))).alias("value"))
    others = groups.select("l", F.col("g").alias("other"), F.col("source").alias("item"))
    pairs = spread_join(groups.select("lang", "source", "l", "g"), others, ["l"], "g").where(F.col("g") != F.col("other"))
    pairs = pairs.join(sums, ["g", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", some("value"))

    own = spread_join(kept, groups.select("g", "total", "size", "lang_total"), ["g"], "term")
    own = own.withColumns({"p": share(F.col("n"), F.col("total"), F.col("size")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("size"))})
    strained = own.where("n > 0 and p > q").select("g", F.col("term").alias("item"), strain(F.col("p"), F.col("q")).alias("value"))

    rank = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "item")).alias("rank")
    first = strained.select("*", rank("g")).where(F.col("rank") <= top_terms)
    terms = first.join(groups.select("g", "lang", "source"), "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.select("*", rank("lang", "source")).unionByName(terms)
