"""Generators: reference sequences, haplotypes, paired reads. Statistics follow the stated rates; bytes are our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phredlens.functions.sequence import phred_character, reverse_complement

# Fixed values of the simulator: the planted variants (0-based position, reference, alternative, zygosity).
TRUTH = ((1000, "G", "T", "hom"), (2000, "G", "A", "het"), (3000, "GTC", "G", "hom"), (4000, "G", "GAC", "het"))
TRUTH_SCHEMA = "pos int, ref string, alt string, zygosity string"


def truth_variants(spark: SparkSession, rows=TRUTH) -> DataFrame:
    """Adds vcf_pos (1-based) and genotype (1/1 for hom, 0/1 for het)."""
    df = spark.createDataFrame(list(rows), TRUTH_SCHEMA)
    return df.select("*", (F.col("pos") + 1).alias("vcf_pos"), F.when(F.col("zygosity") == "hom", "1/1").otherwise("0/1").alias("genotype"))


def _drawn(seed: int, *what: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on nothing but its arguments."""
    return F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 40)) / float(1 << 40)


def random_reference(spark: SparkSession, length: int = 6000, seed: int = 67, chrom: str = "chr1", variants=TRUTH) -> DataFrame:
    """(chrom, seq): seeded bases with each variant's reference allele planted at its place."""
    bases = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.substr(F.lit("ACGT"), (_drawn(seed, p) * 4).cast("int") + 1, F.lit(1)))
    df = spark.range(1).select(F.lit(chrom).alias("chrom"), F.array_join(bases, "").alias("seq"))
    for pos, ref, _, _ in sorted(variants):
        if pos + len(ref) <= length:
            df = df.withColumn("seq", F.overlay("seq", F.lit(ref), F.lit(pos + 1), F.lit(len(ref))))
    return df


def haplotypes(reference: DataFrame, variants=TRUTH) -> DataFrame:
    """(chrom, haplotype, seq): A has the homozygous variants, B all. A reference allele that isn't there is an error."""
    out = None
    for name, kinds in (("A", ("hom",)), ("B", ("hom", "het"))):
        df = reference.select("chrom", F.lit(name).alias("haplotype"), "seq")
        # From the right, so that places to the left stay as they are.
        for pos, ref, alt, zygosity in sorted(variants, reverse=True):
            there = F.substr("seq", F.lit(pos + 1), F.lit(len(ref))) == ref
            if zygosity in kinds:
                df = df.withColumn("seq", F.when(there, F.overlay("seq", F.lit(alt), F.lit(pos + 1), F.lit(len(ref)))).otherwise(F.raise_error(F.lit(f"the reference lacks {ref} at {pos}"))))
        out = df if out is None else out.unionByName(df)
    return out


def haplotype_offsets(keys: DataFrame, starts: DataFrame) -> DataFrame:
    """(chrom, start, offset): length change by all variants of (chrom, pos 1-based, ...) that stand before ``start``.

    One window per contig over the merged places; a start comes before a variant at the same place."""
    events = keys.select("chrom", (F.col("pos") - 1).cast("long").alias("at"), F.lit(1).alias("late"), (F.length("alt") - F.length("ref_allele")).alias("change")).unionByName(starts.select("chrom", F.col("start").cast("long").alias("at"), F.lit(0).alias("late"), F.lit(0).alias("change")))
    so_far = F.expr("sum(change) over (partition by chrom order by at, late range between unbounded preceding and current row)")
    return events.withColumn("offset", so_far).where("late = 0").select("chrom", F.col("at").alias("start"), F.col("offset").cast("long").alias("offset")).distinct()


def paired_reads(haplotype_seqs: DataFrame, read_length: int = 150, depth: int = 60, fragment: int = 300, margin: int = 150, error_rate: float = 0.003, error_qual: int = 8, base_qual: int = 40, seed: int = 1) -> DataFrame:
    """(read_name, r1_seq, r1_qual, r2_seq, r2_qual): fragments from either haplotype, the second mate reversed.

    depth * (length - 2 * margin) // fragment pairs; each base is wrong with ``error_rate`` and then has quality
    ``error_qual``. Fragments that run past the haplotype's end are skipped.
    """
    pairs = haplotype_seqs.groupBy("chrom").agg(F.max_by("seq", F.col("haplotype") == "A").alias("a"), F.max_by("seq", F.col("haplotype") == "B").alias("b"))
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(depth * (F.length("a") - 2 * margin) / fragment) - 1)))
    pairs = pairs.withColumn("hap", F.when(_drawn(seed, "chrom", "i", F.lit("hap")) < 0.5, F.col("a")).otherwise(F.col("b")))
    start = (margin + _drawn(seed, "chrom", "i", F.lit("start")) * (F.length("a") - 2 * margin)).cast("int")
    frag = pairs.select(F.concat_ws("_", F.lit("pair"), "chrom", "i").alias("read_name"), F.substr("hap", start + 1, F.lit(fragment)).alias("f")).where(F.length("f") == fragment)
    for mate, seq in (("r1", F.substr("f", F.lit(1), F.lit(read_length))), ("r2", F.substr(reverse_complement("f"), F.lit(1), F.lit(read_length)))):
        frag = frag.withColumn(f"__{mate}", seq)
        frag = frag.withColumn(f"{mate}_seq", _edited(F.col(f"__{mate}"), mate, seed, error_rate)).withColumn(f"{mate}_qual", _qualities(F.col(f"__{mate}"), mate, seed, error_rate, error_qual, base_qual)).drop(f"__{mate}")
    return frag.drop("f")


def _is_wrong(p: Column, mate: str, seed: int, rate: float) -> Column:
    return _drawn(seed, F.col("read_name"), F.lit(mate), p) < rate


def _edited(seq: Column, mate: str, seed: int, rate: float) -> Column:
    def base(p):
        own = F.substr(seq, p + 1, F.lit(1))
        other = F.substr(F.lit("ACGT"), (F.instr(F.lit("ACGT"), own) + (_drawn(seed + 1, F.col("read_name"), F.lit(mate), p) * 3).cast("int")) % 4 + 1, F.lit(1))
        return F.when(_is_wrong(p, mate, seed, rate) & own.isin("A", "C", "G", "T"), other).otherwise(own)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(seq) - 1), base), "")


def _qualities(seq: Column, mate: str, seed: int, rate: float, low: int, high: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(seq) - 1), lambda p: phred_character(F.when(_is_wrong(p, mate, seed, rate), low).otherwise(high))), "")


def two_technology_reads(spark: SparkSession, length: int = 5000, pairs: int = 200, low: int = 3, high: int = 35, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(reference, reads): reads of technologies a and b with one or two substitutions each (2 to 1), whose quality is
    ``low`` in one technology and ``high`` in the other, all other bases 40."""
    ref = random_reference(spark, length, seed, "chr1", ())
    base = ref.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1)))).withColumn("technology", F.explode(F.array(F.lit("a"), F.lit("b"))))
    frag = base.withColumn("start", (_drawn(seed, "technology", "id", F.lit("at")) * (length - 300)).cast("int"))
    mates = frag.select("technology", "id", F.explode(F.array(F.lit(1), F.lit(2))).alias("mate"), F.substr("seq", F.col("start") + 1, F.lit(300)).alias("f"))
    seq = F.when(F.col("mate") == 1, F.substr("f", F.lit(1), F.lit(100))).otherwise(F.substr(reverse_complement("f"), F.lit(1), F.lit(100)))
    rows = mates.select("technology", "id", "mate", seq.alias("s"), F.when(_drawn(seed, "technology", "id", "mate", F.lit("n")) < 2 / 3, 1).otherwise(2).alias("n"), (_drawn(seed, "technology", "id", "mate", F.lit("p")) * 50).cast("int").alias("p"))
    hit = lambda p: (p == F.col("p")) | ((F.col("n") == 2) & (p == F.col("p") + 50))
    other = lambda p: F.substr(F.lit("ACGT"), F.instr(F.lit("ACGT"), F.substr("s", p + 1, F.lit(1))) % 4 + 1, F.lit(1))
    at = F.sequence(F.lit(0), F.lit(99))
    q = F.when(F.col("technology") == "a", low).otherwise(high)
    reads = rows.select(
        "technology",
        F.concat_ws("_", "technology", "id").alias("read_name"),
        "mate",
        F.col("n").alias("n_substitutions"),
        F.array_join(F.transform(at, lambda p: F.when(hit(p), other(p)).otherwise(F.substr("s", p + 1, F.lit(1)))), "").alias("seq"),
        F.array_join(F.transform(at, lambda p: phred_character(F.when(hit(p), q).otherwise(40))), "").alias("qual"),
    )
    return ref, reads
