"""Writers: CSV files, FASTA, FASTQ and VCF text, alignments by place, charts."""

from __future__ import annotations

import csv
import io
import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phredlens.operators.alignments import coordinate_order
from phredlens.schemas import MISMATCH_COLS
from phredlens.sources.joined import write_joined

# Fixed header lines of a variant file.
VCF_FORMAT = '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'
VCF_COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"
TRUTH_INFO = ("SYNTH", '##INFO=<ID=SYNTH,Number=0,Type=Flag,Description="Planted synthetic truth variant">')


def _csv_line(values) -> list:
    return ["" if v is None else v for v in values]


def write_csv_file(rows: DataFrame, path: str | Path) -> None:
    """One CSV file with header, also for no rows, through the driver: for short tables. Rows come one partition at a time,
    in the frame's order; booleans, numbers and line ends are written as Python's csv module does."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for r in rows.toLocalIterator(prefetchPartitions=True):
            out.writerow(_csv_line(r))


def write_csv_joined(rows: DataFrame, path: str | Path) -> None:
    """The bytes of ``write_csv_file``, written by the executors: see ``joined``."""

    def encode(batches):
        for b in batches:
            text = io.StringIO()
            csv.writer(text).writerows(map(_csv_line, zip(*(c.to_pylist() for c in b.columns), strict=True)))
            yield text.getvalue().encode()

    head = io.StringIO()
    csv.writer(head).writerow(rows.columns)
    write_joined(rows, str(path), encode, head.getvalue().encode())


def write_csv_parts(rows: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, written by the executors; fields and line ends are those of ``write_csv_file``."""

    @F.pandas_udf("string")
    def told(values: pd.Series) -> pd.Series:
        return values.map(repr, na_action="ignore").astype(object)

    kinds = {"boolean": lambda c: F.when(F.col(c), "True").when(~F.col(c), "False"), "double": told, "float": told}
    fields = rows.select(*[kinds.get(t, F.col)(c).alias(c) for c, t in rows.dtypes])
    fields.write.mode("overwrite").options(header=True, lineSep="\r\n", escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_mismatches(rows: DataFrame, contigs: DataFrame, path: str | Path, parts: bool = False) -> None:
    """Mismatches by contig order, then as the reads stand in a sorted file, then by place; without the reads' order
    (ord), by place and name. One file, or with ``parts`` a folder of ordered files; the executors write both."""
    order = ("ord", "ref_pos") if "ord" in rows.columns else ("ref_pos", "read_name")
    ordered = coordinate_order(rows, contigs, *order).select(*MISMATCH_COLS)
    if parts:
        write_csv_parts(ordered, str(path))
    else:
        write_csv_joined(ordered, path)


def write_histogram(histogram: DataFrame, path: str | Path) -> None:
    write_csv_file(histogram.select("technology", "base_qual", "count").orderBy("technology", "base_qual"), path)


def write_calibration(rows: DataFrame, path: str | Path) -> None:
    write_csv_file(rows.select("technology", "base_qual", "n_bases", "n_errors", "error_rate", "empirical_q").orderBy("technology", "base_qual"), path)


def write_deltas(deltas: DataFrame, path: str | Path) -> None:
    ordered = deltas.orderBy("first_ord", "ref_pos") if "first_ord" in deltas.columns else deltas
    write_csv_joined(ordered.drop("first_ord"), path)


def write_fasta(reference: DataFrame, path: str) -> None:
    """A folder of FASTA text, one contig a record."""
    reference.select(F.concat(F.lit(">"), "chrom", F.lit("\n"), "seq")).write.mode("overwrite").text(path)


def write_fasta_file(reference: DataFrame, path: str | Path) -> None:
    """One FASTA file, a line for each sequence, in the reference's order, and its index (``.fai``) beside it."""
    rows = reference.orderBy("ord") if "ord" in reference.columns else reference
    at = 0
    with open(path, "w", encoding="ascii", newline="\n") as out, open(f"{path}.fai", "w", encoding="ascii", newline="\n") as index:
        for r in rows.select("chrom", "seq").toLocalIterator():
            at += out.write(f">{r.chrom}\n")
            index.write(f"{r.chrom}\t{len(r.seq)}\t{at}\t{len(r.seq)}\t{len(r.seq) + 1}\n")
            at += out.write(f"{r.seq}\n")


def write_fastq(reads: DataFrame, path: str, seq: str = "seq", qual: str = "qual") -> None:
    """A folder of FASTQ text, four lines a record."""
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "read_name"), seq, F.lit("+"), qual)).write.mode("overwrite").text(path)


def vcf_lines(records: DataFrame, info: str = ".") -> DataFrame:
    """(line) of each record, in no order; records need chrom, pos, ref_allele, alt and may have id, qual, filter,
    genotype. A null in one of these is written as the format has it."""
    have = set(records.columns)
    field = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in have else F.lit(other)
    return records.select(F.concat_ws("\t", "chrom", "pos", field("id", "."), "ref_allele", "alt", field("qual", "."), field("filter", "PASS"), F.lit(info), F.lit("GT"), field("genotype", "0/1")).alias("line"))


def write_vcf(records: DataFrame, contigs: list[tuple[str, int]], path: str | Path, info: tuple[str, str] | None = None) -> None:
    """One VCF file, sorted by place. info: a flag that all records carry, and its header line."""
    with open(path, "w", encoding="utf-8") as f:
        head = ["##fileformat=VCFv4.2", *(f"##contig=<ID={n},length={size}>" for n, size in contigs), *([info[1]] if info else []), VCF_FORMAT, VCF_COLUMNS]
        f.write("\n".join(head) + "\n")
        for r in vcf_lines(records.orderBy("chrom", "pos"), info[0] if info else ".").toLocalIterator():
            f.write(r.line + "\n")


def write_alignments(reads: DataFrame, contigs: DataFrame, path: str) -> None:
    """Parquet by place: ranges of contig order and start, sorted inside each file."""
    order = contigs.select(F.col("name").alias("chrom"), F.col("ord").alias("contig_ord"))
    placed = reads.join(F.broadcast(order), "chrom", "left")
    placed.repartitionByRange("contig_ord", "ref_start").sortWithinPartitions("contig_ord", "ref_start", "ord").write.mode("overwrite").parquet(path)


#: Colours of the technologies in a chart, by their sorted names.
COLOURS = ("#1b6ca8", "#c8553d", "#3a7d44", "#7d4e9f")


def write_calibration_chart(points: DataFrame, path: str | Path, size: int = 480) -> None:
    """A chart of observed against declared quality with the line of equality, as PNG or SVG by the path's ending; points
    as calibration_plot_points. Technologies times qualities at most come to the driver."""
    rows = points.collect()
    lo, hi = (rows[0]["lo"], rows[0]["hi"]) if rows else (0.0, 40.0)
    names = sorted({r["technology"] for r in rows})
    dots = [(r["base_qual"], r["empirical_q"], COLOURS[names.index(r["technology"]) % len(COLOURS)]) for r in rows]
    if str(path).endswith(".png"):
        Path(path).write_bytes(_png(_raster(dots, lo, hi, size)))
    else:
        Path(path).write_text(_svg(dots, names, lo, hi, size), encoding="utf-8")


def _place(v: float, lo: float, hi: float, size: int) -> float:
    return 40 + (v - lo) / (hi - lo) * (size - 60)


def _svg(dots, names: list[str], lo: float, hi: float, size: int) -> str:
    at = lambda v: _place(v, lo, hi, size)
    marks = "".join(f'<circle cx="{at(x):.1f}" cy="{size - at(y):.1f}" r="3" fill="{c}"/>' for x, y, c in dots)
    labels = "".join(f'<text x="50" y="{30 + 16 * k}" fill="{COLOURS[k % len(COLOURS)]}" font-size="12">{n}</text>' for k, n in enumerate(names))
    line = f'<line x1="{at(lo):.1f}" y1="{size - at(lo):.1f}" x2="{at(hi):.1f}" y2="{size - at(hi):.1f}" stroke="#888" stroke-dasharray="4"/>'
    axes = f'<text x="{size / 2}" y="{size - 8}" font-size="12">declared quality</text><text x="12" y="{size / 2}" font-size="12" transform="rotate(-90 12 {size / 2})">observed quality</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}"><rect width="100%" height="100%" fill="white"/>{line}{marks}{labels}{axes}</svg>\n'


def _raster(dots, lo: float, hi: float, size: int) -> np.ndarray:
    """Pixels (rows from the top): axes with a tick every five qualities, the dashed line, and the dots."""
    image = np.full((size, size, 3), 255, np.uint8)
    at = lambda v: int(round(_place(v, lo, hi, size)))
    edge = at(lo)
    image[size - 1 - edge, edge : at(hi)] = image[size - 1 - at(hi) : size - 1 - edge, edge] = 60
    for v in range(int(-(-lo // 5)) * 5, int(hi) + 1, 5):
        image[size - 1 - edge : size + 5 - edge, at(v)] = image[size - 1 - at(v), edge - 6 : edge] = 60
    for k in range(edge, at(hi)):
        if k // 4 % 2:
            image[size - 1 - k, k] = 136
    y, x = np.mgrid[-3:4, -3:4]
    disc = x**2 + y**2 <= 10
    for a, b, colour in dots:
        image[size - 1 - at(b) + y[disc], at(a) + x[disc]] = [int(colour[k : k + 2], 16) for k in (1, 3, 5)]
    return image


def _png(image: np.ndarray) -> bytes:
    """The public lossless image format: header, one packed stream of unfiltered rows, end."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
