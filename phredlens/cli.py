"""Command line: ``python -m phredlens.cli run_all | map | extract | compare | bqsr``."""

from __future__ import annotations

import argparse

from phredlens import external


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="phredlens")
    commands = p.add_subparsers(dest="command", required=True)

    a = commands.add_parser("run_all", help="the two-technology report")
    for side, label in (("a", "illumina"), ("b", "bgi")):
        a.add_argument(f"--reads-{side}1")
        a.add_argument(f"--reads-{side}2")
        a.add_argument(f"--bam-{side}")
        a.add_argument(f"--label-{side}", default=label)
        a.add_argument(f"--vcf-{side}")
    a.add_argument("--vcf")
    a.add_argument("--reference")
    a.add_argument("--consensus", action=argparse.BooleanOptionalAction, default=True)
    a.add_argument("--out-dir", required=True)
    a.add_argument("--auto-gatk", action="store_true")
    a.add_argument("--hc-chunk-mb", type=float, default=25)
    a.add_argument("--gatk-java-options")

    m = commands.add_parser("map", help="map read pairs with an external program")
    for name in ("reads1", "reads2", "reference", "out", "technology"):
        m.add_argument(f"--{name}", required=True)

    e = commands.add_parser("extract", help="errors, variants and calibration of one file of alignments")
    for name in ("bam", "technology", "out-dir"):
        e.add_argument(f"--{name}", required=True)

    c = commands.add_parser("compare", help="compare error files of two technologies")
    for side in ("a", "b"):
        c.add_argument(f"--errors-{side}", required=True)
        c.add_argument(f"--label-{side}", default=side.upper())
    c.add_argument("--out")
    c.add_argument("--threads", type=int, default=2)

    b = commands.add_parser("bqsr", help="compare qualities before and after recalibration")
    for name in ("bam-before", "bam-after", "technology", "out"):
        b.add_argument(f"--{name}", required=True)

    for x in (e, b):
        x.add_argument("--reference")
        x.add_argument("--vcf")
    for x in (a, e, b):
        x.add_argument("--min-mapq", type=int, default=1)
    for x in (a, e):
        x.add_argument("--min-base-qual", type=int, default=0)
    for x in (a, m):
        x.add_argument("--preset", default="sr")
    for x in (a, m, e, b):
        x.add_argument("--threads", type=int, default=4)
    for x in (a, e):
        x.add_argument("--csv-parts", action="store_true", help="write mismatches as folders of ordered files, by the executors")
    a.add_argument("--extract-window-mb", type=float, default=5, help="accepted; the engine plans its own splits")
    e.add_argument("--window-mb", type=float, default=5, help="accepted; the engine plans its own splits")
    return p


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    if o.command == "map":
        print(external.map_pairs((o.reads1, o.reads2), o.reference, o.out, external.Mapping(o.technology, o.threads, o.preset)))
        return 0
    from pyspark.sql import SparkSession

    from phredlens.operators import variants as var
    from phredlens.plans import report
    from phredlens.sources import bam, text

    spark = SparkSession.builder.appName("phredlens").getOrCreate()
    if o.command == "run_all":
        report.run_all(
            spark, o.out_dir, o.reference, o.bam_a, o.bam_b, (o.reads_a1, o.reads_a2), (o.reads_b1, o.reads_b2), o.label_a, o.label_b, o.vcf, o.vcf_a, o.vcf_b, o.auto_gatk,
            o.consensus, o.min_mapq, o.min_base_qual, o.threads, int(o.hc_chunk_mb * 1_000_000), o.gatk_java_options, o.preset, o.csv_parts,
        )
        print(open(f"{o.out_dir}/comparison_summary.txt", encoding="utf-8").read(), end="")
        return 0
    if o.command == "compare":
        print(report.compare_files(spark, {o.label_a: o.errors_a, o.label_b: o.errors_b}, o.out))
        return 0
    ref = text.read_fasta(spark, o.reference) if o.reference else None
    keys = var.variant_keys(text.read_vcf(spark, o.vcf)) if o.vcf else None
    if o.command == "bqsr":
        before, after = (report.open_alignments(spark, p, o.technology) for p in (o.bam_before, o.bam_after))
        print(report.compare_recalibration(before, after, o.out, ref, keys, o.min_mapq))
        return 0
    sites = var.variant_sites(keys) if keys is not None else None
    contigs = (text.contigs_of(ref) if ref is not None else bam.bam_contigs(spark, o.bam)).cache()
    x = report.extract(report.open_alignments(spark, o.bam, o.technology), o.technology, ref, keys, sites, o.min_mapq, o.min_base_qual, report.total_length(contigs) if o.reference else None)
    report.write_extraction(x, contigs, o.out_dir, o.csv_parts)
    for r in x.counts.collect():
        print(f"{r['technology']}: {r['n_mismatches']} mismatches, {r['n_errors']} errors, {r['n_variants']} variants")
    print(report.calibration_text(x.calibration, [o.technology]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
