"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from phredlens.llm import language, secrets
from phredlens.llm.bpe import round_trip
from phredlens.llm.components import connected
from phredlens.llm.conversations import damaged, repaired, reports
from phredlens.llm.decontaminate import overlaps
from phredlens.llm.divergence import source_divergence
from phredlens.llm.exact_dedup import exact_duplicates
from phredlens.llm.licenses import license_scan
from phredlens.llm.packing import packed
from phredlens.llm.pitman_yor import language_model_scores
from phredlens.llm.simhash import fingerprint_links, near_duplicates
from phredlens.llm.substring_dedup import repeated_units
from phredlens.llm.tables import table
from phredlens.llm.toxicity import learn, toxicity

#: The vocabulary of op7 and op9; a file of the installed package, never copied here.
BPE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark, sf_dir):
    """The model's score of every document, learned from those whose checksum says so."""
    return language_model_scores(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    """For every document the one of equal text that stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    """Overlaps of documents and benchmark items, as pairs."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licenses(spark, sf_dir):
    """License labels of every document."""
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_secrets(spark, sf_dir):
    """Secrets in every document, by the base patterns and the trained tagger."""
    docs = table(spark, sf_dir, "documents")
    return secrets.secrets(docs, secrets.learn(docs))


def op6_substring_dedup(spark, sf_dir):
    """Repeated lines and sentences of all documents, lines of any length."""
    return repeated_units(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    """Digests of every document's ids and of the text they decode to."""
    return round_trip(table(spark, sf_dir, "documents"), BPE_VOCABULARY)


def op8_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))


def op9_language(spark, sf_dir):
    """Language of every document."""
    return language.languages(table(spark, sf_dir, "documents"), BPE_VOCABULARY)


def op10_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_packing(spark, sf_dir):
    """Pieces of all documents with their sequences of at most 1024 tokens."""
    return packed(table(spark, sf_dir, "documents"), BPE_VOCABULARY)


def op12_conversation_repair(spark, sf_dir):
    """Faults, cheapest repair and digest of every conversation, after the stated damage."""
    return reports(repaired(damaged(table(spark, sf_dir, "conversations"))))


def op13_source_divergence(spark, sf_dir):
    """Divergence of the sources of a language, in pairs and by term."""
    return source_divergence(table(spark, sf_dir, "documents"))


def lm_base_scores(spark, sf_dir):
    """The columns of op1 that SQL can express."""
    return op1_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def license_base(spark, sf_dir):
    """The columns of op4 that SQL can express."""
    return op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_counts(spark, sf_dir):
    """The columns of op5 that SQL can express."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def fingerprint_components(spark, sf_dir):
    """op10 from given fingerprints on, which parts stand for: families of seven, each a few bits from the next."""
    family = F.floor(F.col("p_partkey") / 7)
    base = (family * 2654435761) % 4294967291 * 65536 + (family * 40503 + 12345) % 65521
    flip = lambda n: F.expr(f"shiftleft(1L, cast(p_partkey % 7 * {n} % 40 as int))")
    prints = table(spark, sf_dir, "part").select(base.cast("long").bitwiseXOR(flip(5)).bitwiseXOR(flip(11)).alias("fp")).distinct()
    labels = connected(fingerprint_links(prints)).select(F.col("node").alias("fp"), "label")
    return prints.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("component"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
    "op11_packing": op11_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
    "lm_base_scores": lm_base_scores,
    "license_base": license_base,
    "secret_counts": secret_counts,
    "fingerprint_components": fingerprint_components,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc(key: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


_CRC = _crc("CAST(doc_id AS VARCHAR)")

ORACLES = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op6_substring_dedup": r"""
        WITH marked AS (
            -- chr(1) marks the end of a sentence; one that stands in a text, and chr(2), are written as two characters
            SELECT row_number() OVER () AS row, doc_id, regexp_replace(replace(replace(text, chr(2), chr(2) || 'b'), chr(1), chr(2) || 'a'), '([.!?])[ \t]', '\1' || chr(1), 'g') AS text FROM documents
        ), lines AS (
            SELECT row, doc_id, unnest(string_split(text, chr(10))) AS piece, unnest(range(len(string_split(text, chr(10))))) AS line FROM marked
        ), placed AS (
            SELECT row, doc_id, line, piece, coalesce(sum(length(replace(replace(piece, chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2))) + 1) OVER (PARTITION BY row ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines
        ), parts AS (
            SELECT row, doc_id, line, start AS line_start, unnest(string_split(piece, chr(1))) AS piece, unnest(range(len(string_split(piece, chr(1))))) AS part FROM placed WHERE contains(piece, chr(1))
        ), both_levels AS (
            SELECT row, doc_id, line, 'line' AS level, start, length(replace(replace(piece, chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2))) AS size, replace(replace(replace(piece, chr(1), ' '), chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2)) AS piece FROM placed
            UNION ALL
            SELECT row, doc_id, line, 'sentence', line_start + coalesce(sum(length(replace(replace(piece, chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2))) + 1) OVER (PARTITION BY row, line ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), length(replace(replace(piece, chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2))), replace(replace(piece, chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2)) FROM parts
        ), normal AS (
            SELECT row, doc_id, line, level, start, size, trim(regexp_replace(lower(piece), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM both_levels
        ), units AS (
            SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1 AS n_words FROM normal WHERE norm <> ''
        ), ranked AS (
            SELECT *, rank() OVER w AS place, first_value(doc_id) OVER w AS keep_doc_id, first_value(start) OVER w AS keep_start, count(*) OVER (PARTITION BY norm) AS n_copies
            FROM units WHERE level = 'line' OR n_words >= 8 WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, start)
        ), moved AS (SELECT *, bool_or(level = 'line') OVER (PARTITION BY row, line) AS whole FROM ranked WHERE place > 1)
        SELECT doc_id, line, level, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop, n_words, keep_doc_id, CAST(keep_start AS BIGINT) AS keep_start, n_copies
        FROM moved WHERE level = 'line' OR NOT whole
    """,
    "op12_conversation_repair": rf"""
        WITH RECURSIVE d AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations
        ), t AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM d WHERE kind <> 0
        ), o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t)
        ), f AS (
            SELECT conv_id, turn, role, text, i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
                role[1] AS r, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
        ), c AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
        ), step AS (
            SELECT conv_id, i, r, CASE WHEN fault IN ('b', 'd') THEN 1000000 WHEN fault = 't' THEN 1 ELSE 0 END AS e FROM f
        ), v AS (
            -- costs to go from the states: nothing yet, after system, after user, after assistant
            SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS w FROM c
            UNION ALL
            SELECT conv_id, i, [least(b[1], 2 + b[3], 4 + b[4]), least(b[2], 2 + b[3], 4 + b[4]), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])] FROM (
                SELECT s.conv_id, s.i, [
                    least(3 + w[1], e + CASE r WHEN 's' THEN w[2] WHEN 'u' THEN w[3] ELSE 1000000 END, e + 2 + w[3]), least(3 + w[2], e + CASE r WHEN 'u' THEN w[3] ELSE 1000000 END, e + 2 + w[3]),
                    least(3 + w[3], e + CASE r WHEN 'a' THEN w[4] ELSE 1000000 END, e + 2 + w[4]), least(3 + w[4], e + CASE r WHEN 'u' THEN w[3] ELSE 1000000 END, e + 2 + w[3])] AS b
                FROM v JOIN step s ON s.conv_id IS NOT DISTINCT FROM v.conv_id AND s.i = v.i - 1)
        ), walk AS (
            SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines, false AS done FROM c
            UNION ALL
            SELECT conv_id, i + CASE WHEN edit IN ('I', '') THEN 0 ELSE 1 END, CASE edit WHEN 'K' THEN kept WHEN 'I' THEN next WHEN 'R' THEN next ELSE q END, audit || edit,
                CASE edit WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'I' THEN list_append(lines, CASE next WHEN 3 THEN 'user:' ELSE 'assistant:' END)
                    WHEN 'R' THEN list_append(lines, CASE next WHEN 3 THEN 'user:' ELSE 'assistant:' END || text) ELSE lines END, edit = ''
            FROM (
                SELECT x.*, f.role, f.text, here.w AS w, CASE WHEN q = 3 THEN 4 ELSE 3 END AS next, CASE WHEN q = 1 AND r = 's' THEN 2 WHEN q <> 3 AND r = 'u' THEN 3 WHEN q = 3 AND r = 'a' THEN 4 END AS kept,
                    CASE WHEN 3 + after.w[q] = here.w[q] THEN 'D' WHEN 2 + here.w[next] = here.w[q] THEN 'I' WHEN f.i IS NULL THEN ''
                        WHEN fault NOT IN ('b', 'd') AND kept IS NOT NULL AND after.w[kept] + CASE WHEN fault = 't' THEN 1 ELSE 0 END = here.w[q] THEN 'K' ELSE 'R' END AS edit
                FROM walk x JOIN v here ON here.conv_id IS NOT DISTINCT FROM x.conv_id AND here.i = x.i LEFT JOIN v after ON after.conv_id IS NOT DISTINCT FROM x.conv_id AND after.i = x.i + 1
                LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i WHERE NOT done)
        ), told AS (
            SELECT c.*, w.w[1] AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM c
            JOIN v w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 1 JOIN walk ON walk.conv_id IS NOT DISTINCT FROM c.conv_id AND done
        )
        SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM a.conv_id
    """,
    "op13_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), t AS (SELECT lang, source, row, unnest(terms) AS term FROM d
        ), v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3
        ), l AS (SELECT lang, count(*) AS size, sum(n) AS total FROM v GROUP BY lang
        ), g AS (SELECT DISTINCT lang, source FROM d
        ), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
        ), z AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS lang_n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
        ), p AS (
            SELECT lang, source, term, z.n, 1 + (CAST(1000000000 AS HUGEINT) * (z.n + 1)) // (sum(z.n) OVER (PARTITION BY lang, source) + l.size) AS p,
                1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 1)) // (l.total + l.size) AS q FROM z JOIN l USING (lang)
        ), s AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), u AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
        ), r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u)
        SELECT * FROM r WHERE part = 'pair' OR rank <= 200
    """,
    "lm_base_scores": rf"""
        WITH d AS (
            SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), chr(10)) AS words FROM documents
        ), t AS (SELECT doc_id, held_out, unnest(words) AS word FROM d
        ), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word
        ), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 3) AS base_score
        FROM t LEFT JOIN c USING (word), n GROUP BY doc_id, held_out
    """,
    "license_base": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), x AS (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d)
        ), hits AS (
            SELECT doc_id, i, a AS label FROM x WHERE a IN ('mit', 'apache') AND b = 'license'
            UNION ALL SELECT doc_id, i, 'gpl' FROM x WHERE a = 'general' AND b = 'public' AND c = 'license'
        )
        SELECT doc_id, len(w) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM d LEFT JOIN hits USING (doc_id) GROUP BY doc_id, w
    """,
    "secret_counts": r"""
        SELECT doc_id,
            len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
            len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
            len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
        FROM documents
    """,
    "fingerprint_components": """
        WITH RECURSIVE k AS (SELECT p_partkey AS k, p_partkey // 7 AS f FROM part
        ), p AS (SELECT DISTINCT xor(xor((f * 2654435761) % 4294967291 * 65536 + (f * 40503 + 12345) % 65521, CAST(1 AS BIGINT) << CAST(k % 7 * 5 % 40 AS INT)), CAST(1 AS BIGINT) << CAST(k % 7 * 11 % 40 AS INT)) AS fp FROM k
        ), near AS (SELECT a.fp AS a, b.fp AS b FROM p a JOIN p b ON bit_count(xor(a.fp, b.fp)) <= 4
        ), reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)
        SELECT a AS fp, min(b) AS component FROM reach GROUP BY a
    """,
}
