"""Readers of text formats: FASTA, FASTQ, SAM, VCF, contig indexes, mismatch CSV files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phredlens.schemas import VARIANTS
from phredlens.sources import bcf
from phredlens.sources.blocked_text import read_lines

_FASTQ_NAMES = ["file", "record", "line", "value", "l0", "l1", "l3"]
_FASTQ_TYPES = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4]

_SAM = "read_name string, flag int, chrom string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string"


def _in_file_order(spark: SparkSession, path: str, **options) -> DataFrame:
    """value, and place: where the record stands (file, first byte of its split, running number in the split)."""
    rows = spark.read.text(path, **options).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.select("value", F.struct("file", "block", F.monotonically_increasing_id().alias("n")).alias("place"))


def _ranked(rows: DataFrame, place: str = "place") -> DataFrame:
    """ord from 0 by place, as an int. One ordered task over names and numbers only; there are as many as contigs."""
    return rows.withColumn("ord", (F.row_number().over(Window.orderBy(place)) - 1).cast("int"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, seq): one row per contig, names up to the first blank, line breaks taken out.

    A record begins at ``>`` after a line break, so descriptions may hold that sign; a contig is one record of the scan
    (``fasta.read_tiles`` reads long contigs in tiles). ord is the place in the file (file, first byte of the split, number
    in the split), whatever splits the file is read in; ``contigs_of`` counts it from 0. An empty file gives no rows; a
    contig without a base has an empty sequence.
    """
    rows = _in_file_order(spark, path, lineSep="\n>").withColumn("value", F.regexp_replace("value", r"^\s*>", "")).where(F.length(F.trim("value")) > 0)
    head = F.split(F.regexp_extract("value", r"^([^\r\n]*)", 1), r"[ \t]")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    return rows.select(F.col("place").alias("ord"), head[0].alias("chrom"), body.alias("seq"))


def contigs_of(reference: DataFrame) -> DataFrame:
    """(ord, name, length) of a reference, ord from 0 in its order."""
    return _ranked(reference.select(F.col("ord").alias("place"), F.col("chrom").alias("name"), F.length("seq").cast("long").alias("length"))).select("ord", "name", "length")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, length) of a contig index, in the file's order. Blank lines are no contigs."""
    f = F.split("value", "\t")
    return _ranked(_in_file_order(spark, path).where(F.trim("value") != "")).select("ord", f[0].alias("name"), f[1].cast("long").alias("length"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_name, seq, qual) of a FASTQ file, plain or gzip (blocked gzip in many splits). A record that isn't four lines is an error.

    A first pass counts the lines of each split, so every line's number in its file is known and four lines make a
    record, whatever they begin with. Records inside a split are put together where they are; only the lines of a
    record that two splits share are shuffled, three a side at most. An empty file, or blank lines at its end, give
    no rows.
    """
    lines = read_lines(spark, path).withColumn("split", F.xxhash64("file", "block"))
    first: dict[int, tuple[str, int]] = {}  # by split: its file and the number of its first line
    so_far: dict[str, int] = {}
    for r in sorted(lines.groupBy("file", "block", "split").agg(F.count(F.lit(1)).alias("n")).collect()):
        if r.split in first:
            raise ValueError("two splits have one hash")
        first[r.split] = r.file, so_far.get(r.file, 0)
        so_far[r.file] = first[r.split][1] + r.n
    shipped = spark.sparkContext.broadcast(first)
    empty = lambda n: [pa.nulls(n, t) for t in _FASTQ_TYPES]

    def parts(split, number, values):
        """Lines of a record that isn't whole here, with their numbers from ``number`` on."""
        at = range(number, number + len(values))
        out = [pa.array([shipped.value[split][0]] * len(values), pa.string()), pa.array([n // 4 for n in at], pa.int64()), pa.array([n % 4 for n in at], pa.int32()), values]
        return pa.RecordBatch.from_arrays(out + empty(len(values))[4:], _FASTQ_NAMES)

    def run(batches):
        split, number, held = None, 0, pa.array([], pa.string())  # held: the last lines before line ``number``, of a record that isn't whole yet
        for b in batches:
            values, splits = b.column(0).cast(pa.string()), np.asarray(b.column(1))
            ends = [*(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)] if len(splits) else []
            for a, z in zip([0, *ends], ends, strict=False):
                if splits[a] != split:
                    if len(held):
                        yield parts(split, number - len(held), held)
                    split, held = int(splits[a]), held[:0]
                    number = shipped.value[split][1]
                known = pa.concat_arrays([held, values[a:z]])
                begin = number - len(held)
                lead, number = min(-begin % 4, len(known)), number + z - a
                if lead:
                    yield parts(split, begin, known[:lead])
                n = (len(known) - lead) // 4
                held = known[lead + 4 * n :]
                l0, l1, l2, l3 = (known.take(pa.array(np.arange(lead + k, lead + 4 * n, 4))) for k in range(4))
                fine = pc.starts_with(l2, "+")
                if not pc.all(fine).as_py():
                    for i in np.flatnonzero(~np.asarray(fine)).tolist():
                        yield parts(split, begin + lead + 4 * i, known[lead + 4 * i : lead + 4 * i + 4])
                    l0, l1, l3 = (x.filter(fine) for x in (l0, l1, l3))
                yield pa.RecordBatch.from_arrays([*empty(len(l0))[:4], l0, l1, l3], _FASTQ_NAMES)
        if len(held):
            yield parts(split, number - len(held), held)

    rows = lines.select("value", "split").mapInArrow(run, "file string, record long, line int, value string, l0 string, l1 string, l3 string")
    line = lambda k: F.max(F.when(F.col("line") == k, F.col("value")))
    shared = rows.where("record is not null").groupBy("file", "record").agg(*(line(k).alias(f"l{k}") for k in range(4)))
    shared = shared.where(F.length(F.concat_ws("", "l0", "l1", "l2", "l3")) > 0)
    whole = rows.where("record is null").select("l0", "l1", F.lit("+").alias("l2"), "l3").unionByName(shared.select("l0", "l1", "l2", "l3"))
    end = lambda c: F.when(F.endswith(F.col(c), F.lit("\r")), F.regexp_replace(c, r"\r$", "")).otherwise(F.col(c))
    fine = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length(end("l1")) == F.length(end("l3")))
    name = F.when(F.coalesce(fine, F.lit(False)), F.substring_index(F.substring_index(F.substr(end("l0"), F.lit(2)), " ", 1), "\t", 1)).otherwise(F.raise_error(F.lit("not a FASTQ record of four lines")))
    return whole.select(name.alias("read_name"), end("l1").alias("seq"), end("l3").alias("qual"))


def read_sam(spark: SparkSession, path: str, technology: str) -> DataFrame:
    """Alignments of a SAM text file; * becomes null, positions become 0-based, MD comes from the tags."""
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    f = F.split("value", "\t")
    some = lambda c: F.when(c != "*", c)
    md = F.regexp_extract("value", r"\tMD:Z:([0-9A-Za-z^]+)", 1)
    return rows.select(
        f[0].alias("read_name"),
        f[1].cast("int").alias("flag"),
        some(f[2]).alias("chrom"),
        (f[3].cast("int") - 1).alias("ref_start"),
        f[4].cast("int").alias("mapq"),
        some(f[5]).alias("cigar"),
        some(f[9]).alias("seq"),
        some(f[10]).alias("qual"),
        F.when(md != "", md).alias("md"),
        "ord",
        F.lit(technology).alias("technology"),
    )


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a variant file: VCF text, plain or gzip, or binary (``.bcf``); blocked gzip in many splits. A missing quality is null."""
    if path.endswith(".bcf"):
        bcf.register(spark)
        return spark.read.format("bcf").option("split", bcf.SPLIT).load(path)
    rows = read_lines(spark, path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    f = F.split("value", "\t")
    columns = {"chrom": f[0], "pos": f[1].cast("int"), "id": f[2], "ref_allele": f[3], "alt": f[4], "qual": F.when(f[5] != ".", f[5].cast("double")), "filter": f[6]}
    return rows.select(*[columns[c.split()[0]].alias(c.split()[0]) for c in VARIANTS.split(", ")])


def read_error_qualities(spark: SparkSession, path: str, technology: str) -> DataFrame:
    """Histogram of column base_qual of a mismatch CSV file, found by its name in the header. Only it is parsed."""
    rows = spark.read.csv(path, header=True)
    if "base_qual" not in rows.columns:
        raise ValueError(f"{path} has no column base_qual")
    return rows.groupBy(F.col("base_qual").cast("int").alias("base_qual")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(technology).alias("technology"), "base_qual", "count")
