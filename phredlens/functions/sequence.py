"""Column functions on bases, qualities and read flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the alignment flag: bits that say what a read is.
UNMAPPED, READ1, REVERSE, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x4, 0x40, 0x10, 0x100, 0x400, 0x800
EXCLUDED = UNMAPPED | SECONDARY | DUPLICATE | SUPPLEMENTARY
BASES = ("A", "C", "G", "T")


def flag_has(flag: Column | str, bit: int) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.bitwiseAND(F.lit(bit)) != 0


def phred(character: Column | str) -> Column:
    """Quality of a Phred+33 character."""
    return F.ascii(character) - 33


def phred_character(quality: Column | str) -> Column:
    quality = F.col(quality) if isinstance(quality, str) else quality
    return F.char(quality + 33)


def reverse_complement(seq: Column | str) -> Column:
    """ACGTN in either case; other characters only change places."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def empirical_quality(errors: Column, bases: Column) -> Column:
    """-10 log10 of the error rate; null without an error."""
    return F.when(errors > 0, -10 * F.log10(errors / bases))


def error_probability(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / 10)
