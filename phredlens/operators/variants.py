"""Known variants: records to keys and sites, classification, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most variant keys or sites that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _shared(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast of ``small`` if it has at most ``most`` rows; the count stops there."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def passing(filters: Column) -> Column:
    """No filter at all, or PASS among them."""
    empty = filters.isNull() | filters.isin("", ".")
    return empty | F.array_contains(F.split(filters, ";"), "PASS")


def variant_keys(records: DataFrame, min_qual: float | None = None, pass_only: bool = True) -> DataFrame:
    """Distinct (chrom, pos, ref_allele, alt), one per alternative allele, alleles as written.

    A record of low quality goes only if it has a quality; a record without alternatives has no key.
    """
    kept = records.where(passing(F.col("filter"))) if pass_only else records
    if min_qual is not None:
        kept = kept.where(F.col("qual").isNull() | (F.col("qual") >= min_qual))
    alts = F.filter(F.split("alt", ","), lambda a: ~a.isin("", "."))
    return kept.select("chrom", "pos", "ref_allele", F.explode(alts).alias("alt")).distinct()


def variant_sites(*keys: DataFrame) -> DataFrame:
    """Distinct (chrom, pos) that the reference alleles of all given keys cover."""
    together = keys[0].select("chrom", "pos", "ref_allele")
    for k in keys[1:]:
        together = together.unionByName(k.select("chrom", "pos", "ref_allele"))
    covered = F.explode(F.sequence(F.col("pos"), F.col("pos") + F.length("ref_allele") - 1))
    return together.where(F.length("ref_allele") > 0).distinct().select("chrom", covered.alias("pos")).distinct()


def classified(mismatches: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds is_variant: the mismatch's place and both bases are a key. Keys of longer alleles match no base."""
    marks = keys.select(F.col("chrom"), F.col("pos").alias("ref_pos"), F.col("ref_allele").alias("ref_base"), F.col("alt").alias("read_base")).distinct()
    marked = mismatches.join(_shared(marks.withColumn("is_variant", F.lit(True))), ["chrom", "ref_pos", "ref_base", "read_base"], "left")
    return marked.select(*mismatches.columns, F.coalesce("is_variant", F.lit(False)).alias("is_variant"))


def errors_and_variants(mismatches: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(errors, variants): the mismatches without and with a key; every row is in one of them, repeats too."""
    both = classified(mismatches, keys)
    return both.where(~F.col("is_variant")).drop("is_variant"), both.where("is_variant").drop("is_variant")


def off_sites(bases: DataFrame, sites: DataFrame | None) -> DataFrame:
    """Rows (chrom, ref_pos) that stand on no variant site."""
    if sites is None:
        return bases
    return bases.join(_shared(sites.select("chrom", F.col("pos").alias("ref_pos")).distinct()), ["chrom", "ref_pos"], "left_anti").select(*bases.columns)


def consensus(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of the first table whose place and exact alleles the second has too; filters don't count."""
    alleles = F.array_join(F.array_sort(F.split("alt", ",")), ",")
    other = second.select("chrom", "pos", "ref_allele", alleles.alias("__alts")).distinct()
    return first.withColumn("__alts", alleles).join(other, ["chrom", "pos", "ref_allele", "__alts"], "left_semi").select(*first.columns)
