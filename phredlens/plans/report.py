"""Whole workflows: extract one technology, compare two, compare before and after recalibration, the full report."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phredlens import external
from phredlens.operators import alignments as al
from phredlens.operators import calibration as cal
from phredlens.operators import planning, recalibration, statistics
from phredlens.operators import variants as var
from phredlens.sources import bam, fasta, sinks, text
from phredlens.sources.staging import stage, unstage


@dataclass
class Extraction:
    """What one technology's reads give. The mismatches and the calibration counts are staged tables, so whatever is
    derived from them scans no read again."""

    label: str
    errors: DataFrame
    variants: DataFrame
    counts: DataFrame
    histogram: DataFrame
    distribution: DataFrame
    calibration: DataFrame


def open_alignments(spark: SparkSession, path: str, label: str) -> DataFrame:
    """BAM, SAM text or Parquet, by the path's ending."""
    if path.endswith(".bam"):
        bam.register(spark)
        return spark.read.format("bam").option("technology", label).load(path)
    if path.endswith(".sam"):
        return text.read_sam(spark, path, label)
    return spark.read.parquet(path).withColumn("technology", F.lit(label))


def open_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reference, contigs) of a FASTA file: as tiles by byte ranges if it has an index, else a row a contig."""
    if fasta.has_index(path):
        return fasta.read_tiles(spark, path), fasta.indexed_contigs(spark, path)
    whole = text.read_fasta(spark, path)
    return whole, text.contigs_of(whole)


def total_length(contigs: DataFrame) -> int:
    return contigs.agg(F.sum("length")).first()[0] or 0


def extract(reads: DataFrame, label: str, reference: DataFrame | None = None, keys: DataFrame | None = None, sites: DataFrame | None = None, min_mapq: int = 1, min_base_qual: int = 0, reference_chars: int | None = None) -> Extraction:
    """Errors, variants, counts, histogram, distribution and calibration of one technology's reads.

    The source is scanned and decoded once: usable reads are staged, narrowed to what bases need. Two scans of that
    table give the classified mismatches and the calibration counts, which are staged too; all else derives from these.
    Variants are matched by exact allele; sites only take bases out of the calibration."""
    spark = reads.sparkSession
    keys = spark.createDataFrame([], "chrom string, pos int, ref_allele string, alt string") if keys is None else keys
    columns = [c for c in ("read_name", "technology", "chrom", "ref_start", "flag", "mapq", "cigar", "seq", "qual", "md", "ord") if c in reads.columns and (c != "md" or reference is None)]
    usable = stage(al.usable_reads(reads, min_mapq).select(*columns))
    if reference is not None and reference_chars is None:
        reference_chars = al.reference_length(reference)
    pieces = al.aligned_pieces(usable, reference, reference_chars=reference_chars, sites=sites)
    both = stage(var.classified(al.mismatches_of(pieces, min_base_qual), keys))
    counts = stage(cal.calibration_counts(pieces, min_base_qual))
    unstage(usable)
    errors = both.where("not is_variant").drop("is_variant")
    histogram = statistics.error_histogram(errors)
    asked = spark.createDataFrame([(label,)], "technology string")
    return Extraction(label, errors, both.where("is_variant").drop("is_variant"), statistics.extraction_counts(both), histogram, statistics.quality_distribution(histogram, asked), counts)


# Fixed layouts of the two report tables: column of the frame, heading, width, number format.
DISTRIBUTION_LAYOUT = (("n", "n_errors", 10, ""), ("mean", "mean_Q", 10, ".2f"), ("median", "median_Q", 10, ".2f"), ("stdev", "stdev_Q", 10, ".2f"))
CALIBRATION_LAYOUT = (("n_bases", "n_bases", 10, ""), ("n_errors", "n_errors", 10, ""), ("observed", "observed_error_rate", 20, ".6f"), ("expected", "expected_error_rate", 20, ".6f"), ("ratio", "observed/expected", 16, ".6f"))


def text_table(rows: DataFrame, labels: list[str], layout) -> str:
    """One line per label, also for labels without a row. ``rows`` has one row per technology. Numbers are formatted
    here because Python rounds the exact binary value, and the engine's own formatting rounds halves up."""
    by = {r["technology"]: r for r in rows.collect()}
    lines = ["technology".ljust(12) + "".join(head.rjust(width) for _, head, width, _ in layout)]
    for x in labels:
        cells = [format(by[x][c] if x in by else 0, form).rjust(width) for c, _, width, form in layout]
        lines.append(x.ljust(12) + "".join(cells))
    return "\n".join(lines)


def distribution_text(distributions: DataFrame, labels: list[str]) -> str:
    return text_table(distributions, labels, DISTRIBUTION_LAYOUT)


def calibration_text(counts: DataFrame, labels: list[str]) -> str:
    return text_table(cal.calibration_summary(counts), labels, CALIBRATION_LAYOUT)


def write_extraction(x: Extraction, contigs: DataFrame, out_dir: str, parts: bool = False) -> None:
    """errors.csv, variants.csv (with ``parts`` folders of ordered files) and calibration.csv in ``out_dir``."""
    folder = Path(out_dir)
    folder.mkdir(parents=True, exist_ok=True)
    sinks.write_mismatches(x.errors, contigs, folder / "errors.csv", parts)
    sinks.write_mismatches(x.variants, contigs, folder / "variants.csv", parts)
    sinks.write_calibration(cal.calibration_rows(x.calibration), folder / "calibration.csv")


def compare_files(spark: SparkSession, errors: dict[str, str], out: str | None = None) -> str:
    """Distributions of two or more mismatch CSV files by label; with ``out``, also histograms and the text as files."""
    histograms = None
    for label, path in errors.items():
        h = text.read_error_qualities(spark, path, label)
        histograms = h if histograms is None else histograms.unionByName(h)
        if out:
            sinks.write_histogram(h, Path(out).parent / f"{label}_qual_histogram.csv")
    asked = spark.createDataFrame([(x,) for x in errors], "technology string")
    told = distribution_text(statistics.quality_distribution(histograms, asked), list(errors))
    if out:
        Path(out).write_text(told + "\n", encoding="utf-8")
    return told


def compare_recalibration(before: DataFrame, after: DataFrame, out: str, reference: DataFrame | None = None, keys: DataFrame | None = None, min_mapq: int = 1) -> str:
    """Deltas of errors before and after recalibration as a CSV file, and a line on what was found. The base quality
    threshold is always 0 here; dropped rows are counted, not written."""
    sides = [al.mismatches(x, reference, min_mapq) for x in (before, after)]
    if keys is not None and not keys.isEmpty():
        sides = [var.errors_and_variants(x, keys)[0] for x in sides]
    ordered = [x if "ord" in x.columns else x.withColumn("ord", F.monotonically_increasing_id()) for x in sides]
    deltas = recalibration.quality_deltas(*ordered)
    sinks.write_deltas(deltas, out)
    found = recalibration.mean_delta(deltas).first()
    lost = recalibration.dropped_after(*ordered).count()
    mean = f", mean delta {found['mean_delta']:+.3f}" if found["n"] else ""
    return f"{found['n']} matched, {lost} dropped{mean}"


def check_inputs(bam_path: str | None, reads: tuple[str | None, str | None], label: str) -> None:
    if bam_path and any(reads):
        raise ValueError(f"{label}: give alignments or reads, not both")
    if not bam_path and not all(reads):
        raise ValueError(f"{label}: give alignments, or both mates of the reads")


def run_all(
    spark: SparkSession,
    out_dir: str,
    reference: str | None = None,
    bam_a: str | None = None,
    bam_b: str | None = None,
    reads_a: tuple[str | None, str | None] = (None, None),
    reads_b: tuple[str | None, str | None] = (None, None),
    label_a: str = "illumina",
    label_b: str = "bgi",
    vcf: str | None = None,
    vcf_a: str | None = None,
    vcf_b: str | None = None,
    call: bool = False,
    with_consensus: bool = True,
    min_mapq: int = 1,
    min_base_qual: int = 0,
    threads: int = 4,
    chunk: int = 25_000_000,
    java_options: str | None = None,
    preset: str = "sr",
    csv_parts: bool = False,
) -> dict[str, Extraction]:
    """The two-technology report: files per technology, comparison_summary.txt and calibration.png in ``out_dir``.

    Variants come from a file per technology, one file for both, or the caller (``call``); keys are per technology,
    sites are of both together. A consensus of two files is only written, never used. Labels must differ.
    """
    if label_a == label_b:
        raise ValueError("labels must differ: results are filed by label")
    external.check_mapping(preset, threads)
    if bool(vcf_a) != bool(vcf_b):
        raise ValueError("give a variant file for each technology, or one for both")
    if vcf and vcf_a:
        raise ValueError("give one variant file, or one for each technology, not both")
    for bam_path, reads, label in ((bam_a, reads_a, label_a), (bam_b, reads_b, label_b)):
        check_inputs(bam_path, reads, label)
    if reference is None and (call or any(reads_a) or any(reads_b)):
        raise ValueError("mapping and calling need a reference")
    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    paths = [b or external.map_pairs(r, reference, str(out / f"{x}.bam"), external.Mapping(x, threads, preset)) for b, r, x in ((bam_a, reads_a, label_a), (bam_b, reads_b, label_b))]
    ref, contigs = open_reference(spark, reference) if reference else (None, bam.bam_contigs(spark, paths[0]))
    contigs = contigs.cache()
    length = total_length(contigs) if ref is not None else None
    files = [vcf_a or vcf, vcf_b or vcf]
    if call and not any(files):
        tasks = [list(r["intervals"]) for r in planning.interval_tasks(contigs, chunk).orderBy("task").collect()]
        files = [external.call_variants(p, reference, str(out / f"{x}.vcf"), tasks, threads, java_options) for p, x in zip(paths, (label_a, label_b), strict=True)]
    records = [text.read_vcf(spark, f) if f else None for f in files]
    keys = [stage(var.variant_keys(r)) if r is not None else None for r in records]
    sites = var.variant_sites(*keys) if all(k is not None for k in keys) else None
    if with_consensus and files[0] and files[1] and files[0] != files[1]:
        sinks.write_vcf(var.consensus(*records), [(r["name"], r["length"]) for r in contigs.orderBy("ord").collect()], out / "consensus.vcf")
    found = {}
    for path, label, k in zip(paths, (label_a, label_b), keys, strict=True):
        x = extract(open_alignments(spark, path, label), label, ref, k, sites, min_mapq, min_base_qual, length)
        write_extraction(x, contigs, str(out / label), csv_parts)
        sinks.write_histogram(x.histogram, out / label / "error_qual_histogram.csv")
        found[label] = x
    a, b = found[label_a], found[label_b]
    labels, counts = [label_a, label_b], a.calibration.unionByName(b.calibration)
    told = distribution_text(a.distribution.unionByName(b.distribution), labels) + "\n\n" + calibration_text(counts, labels) + "\n"
    (out / "comparison_summary.txt").write_text(told, encoding="utf-8")
    sinks.write_calibration_chart(cal.calibration_plot_points(counts), out / "calibration.png")
    return found
