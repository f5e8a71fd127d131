"""Registered queries of readers, writers, orders and generators: what was written is read again and held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.operators import alignments as al
from phredlens.operators import variants as var
from phredlens.plans import fixture as fx
from phredlens.plans import queries as plans
from phredlens.schemas import MISMATCH_COLS
from phredlens.simulate import haplotypes, truth_variants
from phredlens.sources import sinks, text
from phredlens.sources.staging import fresh_path

READ_FIELDS = ["read_name", "flag", "chrom", "ref_start", "mapq", "cigar"]


def in_file_order(spark, path: str) -> DataFrame:
    """The rows of a Parquet folder with ordinal, their place in file and row order. One number a file comes to the driver."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    first, so_far = {}, 0
    for r in sorted(rows.groupBy("__file").count().collect()):
        first[r["__file"]] = so_far
        so_far += r["count"]
    offsets = spark.createDataFrame(list(first.items()) or [("", 0)], "__file string, __first long")
    return rows.join(F.broadcast(offsets), "__file").withColumn("ordinal", F.col("__first") + F.col("__row")).drop("__file", "__first", "__row")


def written(spark, ordered: DataFrame) -> DataFrame:
    path = fresh_path(spark, "ordered")
    ordered.write.parquet(path)
    return in_file_order(spark, path)


def fasta_contigs(spark, sf):
    path = fresh_path(spark, "fasta")
    sinks.write_fasta(fx.supplier_contigs(spark, sf).orderBy("ord").withColumnRenamed("name", "chrom"), path)
    found = text.read_fasta(spark, path)
    return plans.wide(text.contigs_of(found).join(found.select(F.col("chrom").alias("name"), F.md5("seq").alias("seq_md5")), "name"))


def fai_contigs(spark, sf):
    path = fresh_path(spark, "fai")
    fx.supplier_contigs(spark, sf).orderBy("ord").select(F.concat_ws("\t", "name", "length", F.lit(0), F.lit(60), F.lit(61))).write.text(path)
    return plans.wide(text.read_fai(spark, path))


def fastq_reads(spark, sf):
    path = fresh_path(spark, "fastq")
    sinks.write_fastq(fx.reads(spark, sf).select(F.concat_ws("/", "read_name", "flag").alias("read_name"), "seq", "qual"), path)
    return text.read_fastq(spark, path)


def sam_reads(spark, sf):
    path = fresh_path(spark, "sam")
    line = F.concat_ws("\t", "read_name", "flag", "chrom", F.col("ref_start") + 1, "mapq", "cigar", F.lit("*"), F.lit(0), F.lit(0), "seq", "qual", F.concat(F.lit("MD:Z:"), "md"))
    fx.reads(spark, sf).select(line).write.text(path)
    return plans.wide(text.read_sam(spark, path, "t").select(*READ_FIELDS, "seq", "qual"))


def vcf_records(spark, sf):
    path = fresh_path(spark, "vcf")
    sinks.vcf_lines(fx.variants(spark, sf)).write.text(path)
    return plans.wide(text.read_vcf(spark, path))


def error_file_histogram(spark, sf):
    out = None
    for name in ("bgi", "illumina"):
        path = fresh_path(spark, "errors")
        sinks.write_mismatches(plans._errors(spark, sf).where(F.col("technology") == name).drop("is_variant"), fx.contigs(spark), path, parts=True)
        one = text.read_error_qualities(spark, path, name)
        out = one if out is None else out.unionByName(one)
    return plans.wide(out)


def mismatches_in_order(spark, sf):
    found = al.mismatches(fx.reads(spark, sf), fx.reference(spark))
    return plans.wide(written(spark, al.coordinate_order(found, fx.contigs(spark), "ord", "ref_pos").select(*MISMATCH_COLS)))


def qualities_in_order(spark, sf):
    return plans.wide(written(spark, plans.QUERIES["calibration_counts"](spark, sf).orderBy("technology", "base_qual")))


def sites_in_order(spark, sf):
    return plans.wide(written(spark, var.variant_sites(plans._keys(spark, sf)).orderBy("chrom", "pos")))


def alignments_by_place(spark, sf):
    path = fresh_path(spark, "placed")
    sinks.write_alignments(fx.reads(spark, sf), fx.contigs(spark), path)
    return plans.wide(in_file_order(spark, path).select(*READ_FIELDS, "ordinal"))


def reads_with_payload(spark, sf):
    """Reads of which some have lost their bases and some their qualities."""
    k = F.floor(F.col("ord") / 2)
    torn = fx.reads(spark, sf).withColumns({"seq": F.when(k % 9 != 0, F.col("seq")), "qual": F.when(k % 7 != 0, F.col("qual"))})
    return plans.wide(al.usable_reads(torn).select(*READ_FIELDS))


#: Variants of haplotypes: position, bases of the reference that go, bases that come (none: the next base), zygosity.
PLANTED = ((700, 1, "T", "hom"), (1500, 3, "", "het"), (2500, 1, "GACC", "hom"))


def _planted(spark):
    base = fx.reference(spark).where("chrom = 'chr1'")
    alleles = base.select(*(F.substr("seq", F.lit(p + 1), F.lit(n)) for p, n, _, _ in PLANTED)).first()
    return base, [(p, ref, alt or ref[0], z) for (p, _, alt, z), ref in zip(PLANTED, alleles, strict=True)]


def haplotype_sequences(spark, sf):
    base, rows = _planted(spark)
    return haplotypes(base, rows).select("chrom", "haplotype", F.md5("seq").alias("seq_md5"))


def planted_variants(spark, sf):
    return plans.wide(truth_variants(spark, _planted(spark)[1]))


QUERIES = {f.__name__: f for f in (fasta_contigs, fai_contigs, fastq_reads, sam_reads, vcf_records, error_file_histogram, mismatches_in_order, qualities_in_order, sites_in_order, alignments_by_place, reads_with_payload, haplotype_sequences, planted_variants)}

_LETTERS = f"""{plans._READS}, usable AS (SELECT * FROM reads), {plans._BASES},
    letters AS (SELECT pl.k, pl.m, pl.q, coalesce(b.read_base, 'A') AS x FROM placed pl LEFT JOIN bases b ON pl.k = b.k AND pl.m = b.m AND pl.q = b.q),
    spelled AS (SELECT k, m, string_agg(x, '' ORDER BY q) AS seq, string_agg(chr(CAST(35 + (k * 7 + q * 13 + m) % 40 AS INT)), '' ORDER BY q) AS qual FROM letters GROUP BY k, m)"""
_SEQ = f"(SELECT string_agg({plans._ref('p', 'ci')}, '' ORDER BY p) FROM range(5200) t(p))"
_REF1 = f"ref1 AS (SELECT ci, {_SEQ} AS seq FROM (SELECT 1 AS ci))"
_FIELDS = ", ".join(READ_FIELDS)
_SUPPLIED = "SELECT s_suppkey AS k, 's' || s_suppkey AS name, repeat(translate(md5(CAST(s_suppkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1 + s_suppkey % 40) AS seq FROM supplier"
_SPLICED = lambda with_het: "substr(seq, 1, 700) || 'T' || substr(seq, 702, 799) || " + ("substr(seq, 1501, 1)" if with_het else "substr(seq, 1501, 3)") + " || substr(seq, 1504, 997) || 'GACC' || substr(seq, 2502)"

ORACLES = {
    "fasta_contigs": f"SELECT name, row_number() OVER (ORDER BY k) - 1 AS ord, length(seq) AS length, md5(seq) AS seq_md5 FROM ({_SUPPLIED})",
    "fai_contigs": f"SELECT name, row_number() OVER (ORDER BY k) - 1 AS ord, length(seq) AS length FROM ({_SUPPLIED})",
    "fastq_reads": f"WITH {_LETTERS} SELECT read_name || '/' || flag AS read_name, seq, qual FROM reads JOIN spelled USING (k, m)",
    "sam_reads": f"WITH {_LETTERS} SELECT {_FIELDS}, seq, qual FROM reads JOIN spelled USING (k, m)",
    "vcf_records": f"WITH {plans._VARIANTS} SELECT * FROM vars",
    "error_file_histogram": plans.ORACLES["error_histogram"],
    "mismatches_in_order": f"{plans._ALL}, {plans._CTG} SELECT {plans._COLS}, row_number() OVER (ORDER BY contigs.ord, mis.ord, ref_pos) - 1 AS ordinal FROM mis JOIN contigs ON name = chrom",
    "qualities_in_order": f"SELECT *, row_number() OVER (ORDER BY technology, base_qual) - 1 AS ordinal FROM ({plans.ORACLES['calibration_counts']})",
    "sites_in_order": f"SELECT *, row_number() OVER (ORDER BY chrom, pos) - 1 AS ordinal FROM ({plans.ORACLES['variant_sites']})",
    "alignments_by_place": f"WITH {plans._READS}, {plans._CTG} SELECT {_FIELDS}, row_number() OVER (ORDER BY contigs.ord, ref_start, k * 2 + m) - 1 AS ordinal FROM reads JOIN contigs ON name = chrom",
    "reads_with_payload": f"WITH {plans._READS}, {plans._USABLE} SELECT {_FIELDS} FROM usable WHERE k % 9 <> 0 AND k % 7 <> 0",
    "haplotype_sequences": f"WITH {_REF1} SELECT 'chr1' AS chrom, 'A' AS haplotype, md5({_SPLICED(False)}) AS seq_md5 FROM ref1 UNION ALL SELECT 'chr1', 'B', md5({_SPLICED(True)}) FROM ref1",
    "planted_variants": f"""WITH {_REF1} SELECT pos, ref, alt, zygosity, pos + 1 AS vcf_pos, CASE zygosity WHEN 'hom' THEN '1/1' ELSE '0/1' END AS genotype FROM (
        SELECT 700 AS pos, substr(seq, 701, 1) AS ref, 'T' AS alt, 'hom' AS zygosity FROM ref1
        UNION ALL SELECT 1500, substr(seq, 1501, 3), substr(seq, 1501, 1), 'het' FROM ref1
        UNION ALL SELECT 2500, substr(seq, 2501, 1), 'GACC', 'hom' FROM ref1)""",
}
