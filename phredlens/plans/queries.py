"""Registered queries of the sequencing operators over the derived tables, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.functions.sequence import reverse_complement
from phredlens.operators import alignments as al
from phredlens.operators import calibration as cal
from phredlens.operators import mapping, pileup, planning, recalibration, statistics
from phredlens.operators import variants as var
from phredlens.plans import fixture as fx
from phredlens.schemas import MISMATCH_COLS
from phredlens.simulate import haplotype_offsets
from phredlens.sources.staging import stage


def wide(df: DataFrame, places: int = 6) -> DataFrame:
    """Integers as long, doubles rounded: what an engine prints alike."""
    kinds = {"int": lambda c: F.col(c).cast("long"), "double": lambda c: F.round(F.col(c), places)}
    return df.select(*[kinds.get(k, F.col)(c).alias(c) for c, k in df.dtypes])


def _reads(spark, sf):
    return fx.reads(spark, sf)


def _found(spark, sf, **options):
    return al.mismatches(_reads(spark, sf), fx.reference(spark), **options)


def _pieces(spark, sf, sites=None):
    return al.aligned_pieces(al.usable_reads(_reads(spark, sf)), fx.reference(spark), sites=sites)


def _keys(spark, sf, **options):
    return var.variant_keys(fx.variants(spark, sf), **options)


def _both_keys(spark, sf):
    return _keys(spark, sf), var.variant_keys(fx.variants(spark, sf, second=True))


def _classified(spark, sf):
    return var.classified(_found(spark, sf), _keys(spark, sf))


def _errors(spark, sf):
    return _classified(spark, sf).where("not is_variant")


def _counts(spark, sf):
    return cal.calibration_counts(_pieces(spark, sf, var.variant_sites(_keys(spark, sf))))


def _sides(spark, sf):
    """Both sides come from the same mismatches, which are written once."""
    return fx.recalibrated(stage(_found(spark, sf, min_mapq=1)))


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("technology"), F.floor("value").cast("int").alias("base_qual"))


def _asked(spark):
    return spark.createDataFrame([("illumina",), ("bgi",), ("ont",)], "technology string")


READ_COLS = ["read_name", "technology", "chrom", "ref_start", "mapq", "flag", "cigar"]

QUERIES = {
    "read_filter": lambda s, d: wide(al.usable_reads(_reads(s, d)).select(*READ_COLS)),
    "cigar_blocks": lambda s, d: wide(al.cigar_blocks(al.usable_reads(_reads(s, d))).select("read_name", "flag", "block_idx", "q", "r", "n")),
    "mismatches": lambda s, d: wide(_found(s, d).select(*MISMATCH_COLS)),
    "mismatches_min_qual": lambda s, d: wide(_found(s, d, min_mapq=20, min_base_qual=20).select(*MISMATCH_COLS)),
    "mismatches_md": lambda s, d: wide(al.mismatches(_reads(s, d)).select(*MISMATCH_COLS)),
    "mismatches_by_region": lambda s, d: wide(al.mismatches(al.reads_in_regions(al.usable_reads(_reads(s, d)), fx.regions(s)), fx.reference(s)).select("region_ord", *MISMATCH_COLS)),
    "reads_per_window": lambda s, d: wide(al.owned_by_window(al.usable_reads(_reads(s, d)), 700).groupBy("chrom", "window_id").agg(F.count(F.lit(1)).alias("n_reads"))),
    "variant_keys": lambda s, d: wide(_keys(s, d)),
    "variant_keys_minqual": lambda s, d: wide(_keys(s, d, min_qual=30.0, pass_only=False)),
    "variant_sites": lambda s, d: wide(var.variant_sites(_keys(s, d))),
    "variant_sites_union": lambda s, d: wide(var.variant_sites(*_both_keys(s, d))),
    "classified_errors": lambda s, d: wide(_errors(s, d).select(*MISMATCH_COLS)),
    "classified_variants": lambda s, d: wide(_classified(s, d).where("is_variant").select(*MISMATCH_COLS)),
    "extraction_counts": lambda s, d: wide(statistics.extraction_counts(_classified(s, d))),
    "error_histogram": lambda s, d: wide(statistics.error_histogram(_errors(s, d))),
    "quality_distribution": lambda s, d: wide(statistics.quality_distribution(statistics.error_histogram(_errors(s, d)))),
    "technology_comparison": lambda s, d: wide(statistics.compare_technologies(_errors(s, d), _asked(s))),
    "calibration_counts": lambda s, d: wide(_counts(s, d)),
    "calibration_counts_no_sites": lambda s, d: wide(cal.calibration_counts(_pieces(s, d))),
    "calibration_rows": lambda s, d: wide(cal.calibration_rows(_counts(s, d))),
    "calibration_summary": lambda s, d: wide(cal.calibration_summary(_counts(s, d))),
    "calibration_plot_points": lambda s, d: wide(cal.calibration_plot_points(_counts(s, d), 4)),
    "bqsr_deltas": lambda s, d: wide(recalibration.quality_deltas(*_sides(s, d))),
    "bqsr_dropped": lambda s, d: wide(recalibration.dropped_after(*_sides(s, d)).select(*MISMATCH_COLS)),
    "bqsr_mean_delta": lambda s, d: wide(recalibration.mean_delta(recalibration.quality_deltas(*_sides(s, d)))),
    "consensus_variants": lambda s, d: wide(var.consensus(fx.variants(s, d), fx.variants(s, d, second=True))),
    "scan_windows": lambda s, d: wide(planning.scan_windows(_reads(s, d), fx.contigs(s), 700)),
    "mapped_counts": lambda s, d: wide(statistics.mapped_counts(_reads(s, d), fx.contigs(s))),
    "interval_tasks": lambda s, d: wide(planning.interval_tasks(fx.planning_contigs(s, d), 10_000).select("task", F.array_join("intervals", ",").alias("intervals"))),
    "haplotype_offsets": lambda s, d: wide(haplotype_offsets(_keys(s, d), fx.contigs(s).where("ord < 5").select(F.col("name").alias("chrom"), F.explode(F.sequence(F.lit(0), F.lit(4500), F.lit(500))).alias("start")))),
    "reverse_complement": lambda s, d: _reads(s, d).select("read_name", "flag", reverse_complement("seq").alias("seq_rc")).transform(wide),
    "pileup_variants": lambda s, d: wide(pileup.pileup_variants(al.usable_reads(_reads(s, d)), _found(s, d), min_share=0.02)),
    "mapped_reads": lambda s, d: wide(mapping.map_reads(fx.unaligned_reads(s, d), fx.mapping_contigs(s, d), 12, 9, 2).select("ord", "read_name", "flag", "chrom", "ref_start", "mapq", "cigar", "seq", "mismatches", "places")),
    "event_quality_distribution": lambda s, d: wide(statistics.quality_distribution(_events(s, d).groupBy("technology", "base_qual").agg(F.count(F.lit(1)).alias("count")))),
}


# --- DuckDB ------------------------------------------------------------------------------------------------------


def _ref(p: str, ci: str) -> str:
    return f"substr('ACGT', CAST(((CAST({p} AS BIGINT) * 2654435761 + {ci} * 40503) // 65536) % 4 + 1 AS INT), 1)"


_SHIFT = "CASE kind " + " ".join(f"WHEN {i} THEN CASE " + " ".join(f"WHEN q >= {a} AND q < {z} THEN q + {s}" for a, z, s in blocks) + " END" for i, (_, blocks) in enumerate(fx.CIGARS)) + " END"
_CIGAR = "CASE kind " + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(fx.CIGARS)) + " END"
_READS = f"""
    reads AS (
        SELECT *, {_CIGAR} AS cigar, 'chr' || ci AS chrom FROM (
            SELECT o_orderkey AS k, m, 'r' || o_orderkey AS read_name, CASE WHEN o_orderkey % 2 = 0 THEN 'illumina' ELSE 'bgi' END AS technology, o_custkey % 5 + 1 AS ci,
                (o_orderkey * 37 + o_custkey * 11 + m * 45) % 5000 AS ref_start, CASE o_orderkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 20 ELSE 60 END AS mapq,
                (CASE WHEN m = 0 THEN 65 ELSE 145 END) + CASE o_orderkey % 50 WHEN 3 THEN 1024 WHEN 4 THEN 256 WHEN 5 THEN 2048 WHEN 6 THEN 4 ELSE 0 END AS flag, (o_orderkey + m) % 7 AS kind
            FROM orders, (VALUES (0), (1)) AS mates(m)
        )
    )"""
_USABLE = "usable AS (SELECT * FROM reads WHERE flag & 3332 = 0 AND mapq >= 1)"
_BASES = f"""
    placed AS (SELECT u.*, q, ref_start + {_SHIFT} AS p FROM usable u, (SELECT unnest(range(40)) AS q) qs),
    refs AS (SELECT *, {_ref("p", "ci")} AS ref_base, 2 + (k * 7 + q * 13 + m) % 40 AS base_qual, ((k * 2 + m) * 7919 + q * 104729) % 97 AS h FROM placed WHERE p IS NOT NULL),
    bases AS (SELECT *, p + 1 AS ref_pos, CASE h WHEN 0 THEN substr('ACGT', CAST((instr('ACGT', ref_base) + (k + q) % 3) % 4 + 1 AS INT), 1) WHEN 1 THEN 'N' ELSE ref_base END AS read_base FROM refs)"""
_ROW = "read_name, technology, chrom, ref_pos, ref_base, read_base, base_qual, mapq AS mapping_qual, cigar, flag & 64 <> 0 AS is_read1, flag & 16 <> 0 AS is_reverse"
_MIS = f"mis AS (SELECT k, m, k * 2 + m AS ord, {_ROW} FROM bases WHERE ref_base <> read_base)"
_COLS = ", ".join(MISMATCH_COLS)


def _sub(n: str) -> str:
    return f"substr('ACGT', CAST((instr('ACGT', b0) + ({n}) % 3) % 4 + 1 AS INT), 1)"


_VARIANTS = f"""
    parts AS (SELECT p_partkey AS k, p_partkey % 5 + 1 AS ci, (p_partkey * 53) % 5000 AS p FROM part),
    spelt AS (SELECT *, {_ref("p", "ci")} AS b0, {_ref("p + 1", "ci")} AS b1, {_ref("p + 2", "ci")} AS b2 FROM parts),
    vars AS (
        SELECT 'chr' || ci AS chrom, p + 1 AS pos, 'v' || k AS id, CASE WHEN k % 10 = 9 THEN b0 || b1 || b2 ELSE b0 END AS ref_allele,
            CASE k % 10 WHEN 9 THEN b0 WHEN 8 THEN b0 || 'AC' WHEN 7 THEN {_sub("k")} || ',' || {_sub("k + 1")} ELSE {_sub("k")} END AS alt,
            CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k % 60 AS DOUBLE) END AS qual,
            CASE k % 6 WHEN 5 THEN 'LowQual' WHEN 4 THEN 'q10;s50' WHEN 3 THEN '.' WHEN 2 THEN 'PASS;q10' ELSE 'PASS' END AS filter
        FROM spelt
    ),
    second AS (SELECT * FROM vars WHERE pos % 7 <> 0)"""
_PASS = "filter = '.' OR list_contains(string_split(filter, ';'), 'PASS')"


def _keys_sql(name: str, source: str, where: str = _PASS) -> str:
    return f"{name} AS (SELECT DISTINCT chrom, pos, ref_allele, unnest(string_split(alt, ',')) AS alt FROM {source} WHERE {where})"


def _sites_sql(name: str, *keys: str) -> str:
    return f"{name} AS (SELECT DISTINCT chrom, pos + i AS pos FROM ({' UNION '.join(f'SELECT chrom, pos, ref_allele FROM {k}' for k in keys)}) x, (SELECT unnest(range(3)) AS i) o WHERE i < length(ref_allele))"


_K, _S = _keys_sql("keys", "vars"), _sites_sql("sites", "keys")
_ALL = f"WITH {_READS}, {_USABLE}, {_BASES}, {_MIS}, {_VARIANTS}, {_K}, {_S}"
_IS_VARIANT = "EXISTS (SELECT 1 FROM keys v WHERE v.chrom = mis.chrom AND v.pos = mis.ref_pos AND v.ref_allele = mis.ref_base AND v.alt = mis.read_base)"
_COUNTS = """
    counts AS (
        SELECT technology, base_qual, count(*) AS n_bases, count(*) FILTER (read_base <> ref_base) AS n_errors FROM bases b
        WHERE read_base <> 'N' AND NOT EXISTS (SELECT 1 FROM sites s WHERE s.chrom = b.chrom AND s.pos = b.ref_pos) GROUP BY technology, base_qual
    )"""
_ROWS = "rates AS (SELECT *, n_errors / n_bases AS error_rate, CASE WHEN n_errors > 0 THEN -10 * log10(n_errors / n_bases) END AS empirical_q FROM counts)"
_BQSR = """
    changed AS (SELECT * REPLACE (2 + (base_qual * 3 + ref_pos) % 40 AS base_qual) FROM mis WHERE k % 11 <> 0),
    before AS (SELECT * FROM mis UNION ALL SELECT * REPLACE ((base_qual + 5) % 42 AS base_qual, ord + 10000000 AS ord) FROM mis WHERE k % 13 = 0),
    after AS (SELECT * FROM changed UNION ALL SELECT * REPLACE ((base_qual + 5) % 42 AS base_qual, ord + 10000000 AS ord) FROM changed WHERE k % 13 = 0),
    b AS (SELECT read_name, chrom, ref_pos, is_read1, arg_max(ref_base, ord) AS ref_base, arg_max(read_base, ord) AS read_base, arg_max(base_qual, ord) AS q, arg_max(mapping_qual, ord) AS mq, min(ord) AS first_ord FROM before GROUP BY ALL),
    a AS (SELECT read_name, chrom, ref_pos, is_read1, arg_max(base_qual, ord) AS q, arg_max(mapping_qual, ord) AS mq FROM after GROUP BY ALL),
    deltas AS (
        SELECT b.read_name, b.chrom, b.ref_pos, b.ref_base, b.read_base, b.q AS qual_before, a.q AS qual_after, a.q - b.q AS delta, b.mq AS mapq_before, a.mq AS mapq_after, b.first_ord
        FROM b JOIN a USING (read_name, chrom, ref_pos, is_read1)
    )"""
_DIST = "technology, count(*) AS n, round(avg(base_qual), 6) AS mean, round(median(base_qual), 6) AS median, round(stddev_pop(base_qual), 6) AS stdev"
_CTG = "contigs AS (SELECT * FROM (VALUES (0, 'chr1', 5200), (1, 'chr2', 5200), (2, 'chr3', 5200), (3, 'chr4', 5200), (4, 'chr5', 5200), (5, 'chrEmpty', 500)) t(ord, name, length))"

#: Every place with at most two unlike bases of 60 has a third of 20 bases that agree.
_MAPPED = f"""
    ctg AS (SELECT s_suppkey AS c, string_agg({fx.checksum_bases("s_suppkey || ':' || i")}, '' ORDER BY i) AS seq FROM supplier, range({fx.MAPPING_LENGTH // 32}) t(i) GROUP BY s_suppkey),
    cut AS (SELECT k, m, substr(seq, {fx.MAPPED_FROM} + 1, {fx.MAPPED_LENGTH}) AS seq FROM (SELECT o_orderkey AS k, m, o_custkey % (SELECT count(*) FROM supplier) AS c FROM orders, (VALUES (0), (1)) v(m)) JOIN ctg USING (c)),
    one AS (SELECT k, m, {fx.changed_base("seq", *fx.MAPPED_CHANGES[0])} AS seq FROM cut),
    two AS (SELECT k, m, {fx.changed_base("seq", *fx.MAPPED_CHANGES[1])} AS seq FROM one),
    three AS (SELECT k, m, {fx.changed_base("seq", *fx.MAPPED_CHANGES[2])} AS seq FROM two),
    sequenced AS (SELECT k, m, k * 2 + m AS ord, CASE m WHEN 1 THEN reverse(translate(bases, 'ACGTN', 'TGCAN')) ELSE bases END AS seq FROM (SELECT k, m, {fx.MAPPED_NOWHERE} AS bases FROM three)),
    strands AS (SELECT ord, false AS reverse, seq AS spelt FROM sequenced UNION ALL SELECT ord, true, reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM sequenced),
    thirds AS (SELECT ord, reverse, spelt, o, substr(spelt, o + 1, 20) AS part FROM strands, (VALUES (0), (20), (40)) v(o)),
    twenties AS (SELECT c, seq, p, substr(seq, p + 1, 20) AS part FROM ctg, (SELECT CAST(unnest(range({fx.MAPPING_LENGTH - 19})) AS INT) AS p)),
    near AS (SELECT DISTINCT ord, reverse, spelt, 'm' || c AS chrom, seq, p - o AS ref_start FROM thirds JOIN twenties USING (part) WHERE p - o BETWEEN 0 AND {fx.MAPPING_LENGTH - fx.MAPPED_LENGTH}),
    scored AS (SELECT *, hamming(spelt, substr(seq, ref_start + 1, {fx.MAPPED_LENGTH})) AS mismatches FROM near),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY mismatches, chrom, ref_start, reverse) AS nth, count(*) OVER (PARTITION BY ord, mismatches) AS places FROM scored WHERE mismatches <= 2)"""

ORACLES = {
    "mapped_reads": f"""WITH {_MAPPED} SELECT s.ord, 'r' || k AS read_name, CASE WHEN nth IS NULL THEN 4 WHEN reverse THEN 16 ELSE 0 END AS flag, chrom, ref_start, CASE WHEN places = 1 THEN 60 ELSE 0 END AS mapq,
        CASE WHEN nth = 1 THEN '{fx.MAPPED_LENGTH}M' END AS cigar, coalesce(spelt, s.seq) AS seq, mismatches, coalesce(places, 0) AS places FROM sequenced s LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) r ON s.ord = r.ord""",
    "read_filter": f"WITH {_READS}, {_USABLE} SELECT {', '.join(READ_COLS)} FROM usable",
    "cigar_blocks": f"""WITH {_READS}, {_USABLE}, {_BASES},
        runs AS (SELECT read_name, flag, q, p, p - q AS shift, row_number() OVER (PARTITION BY k, m ORDER BY q) - q AS gap FROM bases)
        SELECT read_name, flag, row_number() OVER (PARTITION BY read_name, flag ORDER BY min(q)) - 1 AS block_idx, min(q) AS q, min(p) AS r, count(*) AS n FROM runs GROUP BY read_name, flag, shift, gap""",
    "mismatches": f"{_ALL} SELECT {_COLS} FROM mis",
    "mismatches_min_qual": f"{_ALL} SELECT {_COLS} FROM mis WHERE mapping_qual >= 20 AND base_qual >= 20",
    "mismatches_md": f"{_ALL} SELECT {_COLS} FROM mis",
    "mismatches_by_region": f"""{_ALL}, regions AS (SELECT * FROM (VALUES (0, 'chr1', 100, 400), (1, 'chr1', 350, 700), (2, 'chr2', 0, 60), (3, 'chr4', 4900, 6000)) t(region_ord, chrom, start, stop)),
        spans AS (SELECT k, m, chrom, min(p) AS a, max(p) + 1 AS z FROM bases GROUP BY ALL)
        SELECT region_ord, {", ".join("mis." + c for c in MISMATCH_COLS)} FROM mis JOIN spans USING (k, m) JOIN regions r ON r.chrom = spans.chrom AND a < r.stop AND z > r.start""",
    "reads_per_window": f"WITH {_READS}, {_USABLE} SELECT chrom, ref_start // 700 AS window_id, count(*) AS n_reads FROM usable GROUP BY ALL",
    "variant_keys": f"{_ALL} SELECT * FROM keys",
    "variant_keys_minqual": f"WITH {_VARIANTS}, {_keys_sql('keys', 'vars', 'qual IS NULL OR qual >= 30')} SELECT * FROM keys",
    "variant_sites": f"{_ALL} SELECT * FROM sites",
    "variant_sites_union": f"WITH {_VARIANTS}, {_K}, {_keys_sql('keys2', 'second')}, {_sites_sql('sites', 'keys', 'keys2')} SELECT * FROM sites",
    "classified_errors": f"{_ALL} SELECT {_COLS} FROM mis WHERE NOT {_IS_VARIANT}",
    "classified_variants": f"{_ALL} SELECT {_COLS} FROM mis WHERE {_IS_VARIANT}",
    "extraction_counts": f"{_ALL}, c AS (SELECT technology, {_IS_VARIANT} AS v FROM mis) SELECT technology, count(*) AS n_mismatches, count(*) FILTER (NOT v) AS n_errors, count(*) FILTER (v) AS n_variants FROM c GROUP BY technology",
    "error_histogram": f'{_ALL} SELECT technology, base_qual, count(*) AS "count" FROM mis WHERE NOT {_IS_VARIANT} GROUP BY technology, base_qual',
    "quality_distribution": f"{_ALL} SELECT {_DIST} FROM mis WHERE NOT {_IS_VARIANT} GROUP BY technology",
    "technology_comparison": f"""{_ALL}, d AS (SELECT {_DIST} FROM mis WHERE NOT {_IS_VARIANT} GROUP BY technology)
        SELECT technology, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(median, 0) AS median, coalesce(stdev, 0) AS stdev FROM (VALUES ('illumina'), ('bgi'), ('ont')) t(technology) LEFT JOIN d USING (technology)""",
    "calibration_counts": f"{_ALL}, {_COUNTS} SELECT * FROM counts",
    "calibration_counts_no_sites": f"{_ALL} SELECT technology, base_qual, count(*) AS n_bases, count(*) FILTER (read_base <> ref_base) AS n_errors FROM bases WHERE read_base <> 'N' GROUP BY technology, base_qual",
    "calibration_rows": f"{_ALL}, {_COUNTS}, {_ROWS} SELECT technology, base_qual, n_bases, n_errors, round(error_rate, 6) AS error_rate, round(empirical_q, 6) AS empirical_q FROM rates",
    "calibration_summary": f"""{_ALL}, {_COUNTS}, s AS (SELECT technology, CAST(sum(n_bases) AS BIGINT) AS n_bases, CAST(sum(n_errors) AS BIGINT) AS n_errors, sum(n_bases * pow(10.0, -base_qual / 10)) AS e FROM counts GROUP BY technology)
        SELECT technology, n_bases, n_errors, round(n_errors / n_bases, 6) AS observed, round(e / n_bases, 6) AS expected, round(CASE WHEN e = 0 THEN 0 ELSE n_errors / e END, 6) AS ratio FROM s""",
    "calibration_plot_points": f"""{_ALL}, {_COUNTS}, {_ROWS}, p AS (SELECT technology, base_qual, empirical_q, n_errors FROM rates WHERE n_errors >= 4)
        SELECT technology, base_qual, round(empirical_q, 6) AS empirical_q, n_errors, round((SELECT coalesce(least(min(base_qual), min(empirical_q)) - 1, 0) FROM p), 6) AS lo, round((SELECT coalesce(greatest(max(base_qual), max(empirical_q)) + 1, 40) FROM p), 6) AS hi FROM p""",
    "bqsr_deltas": f"{_ALL}, {_BQSR} SELECT * FROM deltas",
    "bqsr_dropped": f"{_ALL}, {_BQSR} SELECT {_COLS} FROM before x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.read_name = x.read_name AND a.chrom = x.chrom AND a.ref_pos = x.ref_pos AND a.is_read1 = x.is_read1)",
    "bqsr_mean_delta": f"{_ALL}, {_BQSR} SELECT count(*) AS n, round(avg(delta), 6) AS mean_delta FROM deltas",
    "consensus_variants": f"WITH {_VARIANTS} SELECT v.* FROM vars v WHERE EXISTS (SELECT 1 FROM second s WHERE s.chrom = v.chrom AND s.pos = v.pos AND s.ref_allele = v.ref_allele AND list_sort(string_split(s.alt, ',')) = list_sort(string_split(v.alt, ',')))",
    "scan_windows": f"""WITH {_READS}, {_CTG}, live AS (SELECT * FROM contigs c WHERE EXISTS (SELECT 1 FROM reads r WHERE r.chrom = c.name AND r.flag & 4 = 0)),
        w AS (SELECT ord, name AS chrom, unnest(range(0, length, 700)) AS start, length FROM live)
        SELECT row_number() OVER (ORDER BY ord, start) - 1 AS idx, chrom, start, least(start + 700, length) AS stop FROM w""",
    "mapped_counts": f"WITH {_READS}, {_CTG} SELECT CAST(ord AS BIGINT) AS ord, name, CAST(length AS BIGINT) AS length, (SELECT count(*) FROM reads r WHERE r.chrom = c.name AND r.flag & 4 = 0) AS n_mapped FROM contigs c",
    "interval_tasks": """WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ord, 'ctg' || s_suppkey AS name, s_suppkey * 7919 % 13001 AS n FROM supplier),
        walk AS (
            SELECT -1 AS ord, 0 AS size, CAST([] AS VARCHAR[]) AS open, CAST([] AS VARCHAR[]) AS done
            UNION ALL
            SELECT c.ord, CASE WHEN c.n > 10000 OR w.size + c.n >= 10000 THEN 0 ELSE w.size + c.n END,
                CASE WHEN c.n > 10000 OR w.size + c.n >= 10000 THEN [] ELSE list_append(w.open, c.name) END,
                CASE WHEN c.n > 10000 THEN list_concat(CASE WHEN len(w.open) > 0 THEN list_append(w.done, array_to_string(w.open, ',')) ELSE w.done END,
                        [format('{}:{}-{}', c.name, a, least(a + 9999, c.n)) for a in range(1, c.n + 1, 10000)])
                    WHEN w.size + c.n >= 10000 THEN list_append(w.done, array_to_string(list_append(w.open, c.name), ',')) ELSE w.done END
            FROM walk w JOIN c ON c.ord = w.ord + 1
        ), last AS (SELECT CASE WHEN len(open) > 0 THEN list_append(done, array_to_string(open, ',')) ELSE done END AS t FROM walk ORDER BY ord DESC LIMIT 1)
        SELECT unnest(range(len(t))) AS task, unnest(t) AS intervals FROM last""",
    "haplotype_offsets": f"""{_ALL}, starts AS (SELECT unnest(range(0, 5000, 500)) AS start), c AS (SELECT 'chr' || unnest(range(1, 6)) AS chrom)
        SELECT chrom, start, CAST(coalesce((SELECT sum(length(alt) - length(ref_allele)) FROM keys k WHERE k.chrom = c.chrom AND k.pos - 1 < start), 0) AS BIGINT) AS "offset" FROM starts, c""",
    "reverse_complement": f"""WITH {_READS}, usable AS (SELECT * FROM reads), {_BASES}, letters AS (SELECT pl.k, pl.m, pl.q, coalesce(b.read_base, 'A') AS x FROM placed pl LEFT JOIN bases b ON pl.k = b.k AND pl.m = b.m AND pl.q = b.q)
        SELECT read_name, flag, s AS seq_rc FROM reads JOIN (SELECT k, m, reverse(translate(string_agg(x, '' ORDER BY q), 'ACGTN', 'TGCAN')) AS s FROM letters GROUP BY k, m) USING (k, m)""",
    "pileup_variants": f"""{_ALL}, depths AS (SELECT chrom, ref_pos AS pos, count(*) AS depth FROM bases GROUP BY ALL),
        seen AS (SELECT chrom, ref_pos AS pos, ref_base AS ref_allele, read_base AS alt, count(*) AS n_alt FROM mis WHERE read_base <> 'N' GROUP BY ALL)
        SELECT seen.*, depth, CASE WHEN n_alt * 5 >= depth * 4 THEN '1/1' ELSE '0/1' END AS genotype FROM seen JOIN depths USING (chrom, pos) WHERE n_alt >= 2 AND n_alt >= depth * CAST(0.02 AS DOUBLE)""",
    "event_quality_distribution": "SELECT technology, count(*) AS n, round(avg(q), 6) AS mean, round(median(q), 6) AS median, round(stddev_pop(q), 6) AS stdev FROM (SELECT event_type AS technology, CAST(floor(value) AS INT) AS q FROM events) GROUP BY technology",
}


def flagship(spark, sf_dir: str) -> DataFrame:
    """Declared quality against the observed error rate, for both technologies."""
    return QUERIES["calibration_rows"](spark, sf_dir)
