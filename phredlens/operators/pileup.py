"""Single-base variants from a pileup of aligned pieces. A plain caller of its own: it doesn't equal external callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phredlens.functions.sequence import BASES
from phredlens.operators.alignments import TILE, _pieces, cigar_blocks


def depth_at(reads: DataFrame, places: DataFrame, tile: int = TILE) -> DataFrame:
    """(chrom, pos, depth) of the places (chrom, pos 1-based): how many reads have an aligned base there.

    Blocks are cut at tile borders, and each piece is a step up and a step down in its tile; steps are summed by place
    before they move, and their running sum along a tile is the depth. No base becomes a row. A place without a read has
    depth 0; a place that repeats has one row.
    """
    pieces = _pieces(cigar_blocks(reads.select("chrom", "ref_start", "cigar")), tile).select("chrom", "tile_id", F.col("r").alias("a"), (F.col("r") + F.col("n")).alias("z"))
    steps = pieces.select("chrom", "tile_id", F.inline(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("step")), F.struct(F.col("z").alias("at"), F.lit(-1).alias("step")))))
    asked = places.select("chrom", F.floor((F.col("pos") - 1) / tile).cast("int").alias("tile_id"), (F.col("pos") - 1).alias("at")).distinct()
    changes = steps.groupBy("chrom", "tile_id", "at").agg(F.sum("step").alias("step"), F.lit(False).alias("asked"))
    both = changes.unionByName(asked.select("*", F.lit(0).cast("long").alias("step"), F.lit(True).alias("asked")))
    along = Window.partitionBy("chrom", "tile_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("depth", F.sum("step").over(along)).where("asked").select("chrom", (F.col("at") + 1).alias("pos"), "depth")


def pileup_variants(reads: DataFrame, mismatches: DataFrame, min_alt: int = 2, min_share: float = 0.2, tile: int = TILE) -> DataFrame:
    """(chrom, pos, ref_allele, alt, n_alt, depth, genotype) of alternative bases that enough reads show.

    ``mismatches`` are those of ``reads``, which are usable ones; N is no allele. An allele needs ``min_alt`` reads and
    ``min_share`` of the depth; from four fifths on it is told as homozygous. Candidates come first, so depth is asked for
    at few places. With a filter column it feeds ``variant_keys``. No reads or no mismatches give no rows.
    """
    seen = mismatches.where(F.col("read_base").isin(*BASES)).groupBy("chrom", F.col("ref_pos").alias("pos"), F.col("ref_base").alias("ref_allele"), F.col("read_base").alias("alt")).agg(F.count(F.lit(1)).alias("n_alt"))
    enough = seen.where(F.col("n_alt") >= min_alt)
    found = enough.join(depth_at(reads, enough, tile), ["chrom", "pos"]).where(F.col("n_alt") >= F.col("depth") * min_share)
    return found.select("chrom", "pos", "ref_allele", "alt", "n_alt", "depth", F.when(F.col("n_alt") * 5 >= F.col("depth") * 4, "1/1").otherwise("0/1").alias("genotype"))
