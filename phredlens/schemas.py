"""Column layouts of the tables that operators take and return."""

from __future__ import annotations

ALIGNMENTS = "read_name string, flag int, chrom string, ref_start int, mapq int, cigar string, seq string, qual string, md string, ord long, technology string"
MISMATCHES = "read_name string, technology string, chrom string, ref_pos int, ref_base string, read_base string, base_qual int, mapping_qual int, cigar string, is_read1 boolean, is_reverse boolean"
DELTAS = "read_name string, chrom string, ref_pos int, ref_base string, read_base string, qual_before int, qual_after int, delta int, mapq_before int, mapq_after int"
VARIANTS = "chrom string, pos int, id string, ref_allele string, alt string, qual double, filter string"
VARIANT_KEYS = "chrom string, pos int, ref_allele string, alt string"
CONTIGS = "ord int, name string, length long"
REFERENCE = "chrom string, seq string"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


MISMATCH_COLS = names(MISMATCHES)
DELTA_COLS = names(DELTAS)
