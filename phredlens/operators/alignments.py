"""From aligned reads to observed bases: filters, the CIGAR walk, reference lookup, mismatches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from phredlens.functions.sequence import EXCLUDED, READ1, REVERSE, flag_has, phred
from phredlens.schemas import MISMATCH_COLS
from phredlens.sources.staging import stage, unstage

#: Bases of a reference tile; an alignment block is cut where tiles meet. A tile is copied with every block that meets
#: it, so it is small.
TILE = 1024
#: A reference up to this many characters is broadcast; a larger one is joined by tile.
BROADCAST_CHARS = 64_000_000


def usable_reads(reads: DataFrame, min_mapq: int = 1) -> DataFrame:
    """Primary, mapped, non-duplicate reads of enough mapping quality that have bases and qualities.

    Quality-control failures are kept, and reads need not be paired. Both predicates are on plain columns, so they
    reach the scan.
    """
    return reads.where((F.col("flag").bitwiseAND(F.lit(EXCLUDED)) == 0) & (F.col("mapq") >= min_mapq) & F.col("seq").isNotNull() & F.col("qual").isNotNull())


_ints = lambda *names: [StructField(c, IntegerType()) for c in names]
#: Types, not texts: a worker that imports this module has no session to read a text with.
_WALKED = StructType([StructField("blocks", ArrayType(StructType(_ints("q", "r", "m", "n")))), *_ints("stop")])
_UNLIKE = ArrayType(StructType([*_ints("at"), StructField("ref_base", StringType()), StructField("read_base", StringType()), *_ints("base_qual")]))
_OPERATION = re.compile(r"([0-9]+)([MIDNSHPX=])")


def _walk_one(cigar: str) -> tuple[list[tuple[int, int, int, int]], int]:
    q = r = m = 0
    blocks = []
    for count, op in _OPERATION.findall(cigar):
        n = int(count)
        if op in "M=X":
            if n:
                blocks.append((q, r, m, n))
            q, r, m = q + n, r + n, m + n
        elif op in "IS":
            q += n
        elif op in "DN":
            r += n
            m += n if op == "D" else 0
    return blocks, r


@F.arrow_udf(_WALKED)
def _walk(cigar: pa.Array, start: pa.Array) -> pa.Array:
    """Aligned blocks (query offset q, reference offset r, offset m in the MD sequence, size n) of a CIGAR, and where it
    ends on the reference.

    M, = and X advance both sides; I and S the query; D and N the reference, D the MD sequence too; others nothing. Equal
    CIGARs of a batch are walked once.
    """
    start = pc.cast(start, pa.int32())
    known = pc.if_else(start.is_valid(), cigar, None).dictionary_encode()
    walked = [_walk_one(c) for c in known.dictionary.to_pylist()]
    sizes = np.array([len(blocks) for blocks, _ in walked] + [0])
    flat = np.array([x for blocks, _ in walked for x in blocks], np.int64).reshape(-1, 4)
    of = np.asarray(known.indices.fill_null(len(walked)), np.int64)
    begins, each = np.concatenate([[0], np.cumsum(sizes[:-1])]), sizes[of]
    ends = np.cumsum(each)
    at = np.repeat(begins[of] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
    first = np.asarray(start.fill_null(0), np.int64)
    q, r, m, n = flat[at].T
    struct = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (q, r + np.repeat(first, each), m, n)], ["q", "r", "m", "n"])
    missing = np.asarray(known.indices.is_null())
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), struct, mask=pa.array(missing))
    stop = pa.array(first + np.array([stop for _, stop in walked] + [0])[of], pa.int32(), mask=missing)
    return pa.StructArray.from_arrays([lists, stop], ["blocks", "stop"])


#: Spark filters by what it explodes and would run a deterministic function a second time for that.
_walk = _walk.asNondeterministic()


def reference_end(cigar: Column, start: Column) -> Column:
    """Where a read ends on the reference (0-based, exclusive)."""
    return _walk(cigar, start)["stop"]


def with_blocks(reads: DataFrame) -> DataFrame:
    """Adds ``blocks`` and ``ref_end`` (0-based, exclusive) by a walk inside the row; no shuffle."""
    walked = reads.withColumn("__walk", _walk("cigar", "ref_start"))
    return walked.select(*reads.columns, F.col("__walk.blocks").alias("blocks"), F.col("__walk.stop").alias("ref_end"))


def cigar_blocks(reads: DataFrame) -> DataFrame:
    """One row per aligned block: the read's columns, block_idx, q, r, m, n. Columns of the reads that have one of these
    names are left out."""
    own = ("block_idx", "q", "r", "m", "n")
    keep = [c for c in reads.columns if c not in own]
    blocks = with_blocks(reads).select(*keep, F.posexplode("blocks").alias("__block_idx", "__b"))
    return blocks.select(*keep, F.col("__block_idx").alias("block_idx"), *(F.col(f"__b.{c}").alias(c) for c in own[1:]))


def reference_tiles(reference: DataFrame, tile: int = TILE, ahead: int = 0) -> DataFrame:
    """(chrom, tile_id, ref_tile): contig sequences in upper case, cut into tiles, each with ``ahead`` letters of the next;
    tiles of that width stay what they are.

    Sequences and tiles are binary: a slice of bytes is found at once, while a slice of a string is walked to.
    """
    if "ref_tile" in reference.columns:
        return reference.select("chrom", "tile_id", "ref_tile")
    at = F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("seq"), F.lit(1)) - 1) / tile).cast("int"))).alias("tile_id")
    tiles = reference.select("chrom", F.upper("seq").cast("binary").alias("seq"), at)
    return tiles.select("chrom", "tile_id", F.substr("seq", F.col("tile_id") * tile + 1, F.lit(tile + ahead)).alias("ref_tile"))


def reference_length(reference: DataFrame) -> int:
    return reference.agg(F.sum(F.octet_length("ref_tile" if "ref_tile" in reference.columns else "seq"))).first()[0] or 0


def sites_by_tile(sites: DataFrame, tile: int = TILE) -> DataFrame:
    """(chrom, tile_id, sites): 0-based places of variant sites (chrom, pos) inside each tile that has one."""
    at = F.col("pos") - 1
    placed = sites.where("pos > 0").select("chrom", F.floor(at / tile).cast("int").alias("tile_id"), (at % tile).cast("int").alias("at"))
    return placed.groupBy("chrom", "tile_id").agg(F.collect_set("at").alias("sites"))


@F.pandas_udf(BinaryType())
def _lower_at(bases: pd.Series, sites: pd.Series, shift: pd.Series) -> pd.Series:
    """Bases with the letters at ``sites`` (less ``shift``) in lower case."""
    out = []
    for letters, places, by in zip(bases, sites, shift, strict=True):
        if letters is not None and places is not None:
            held = np.frombuffer(letters, np.uint8).copy()
            at = np.asarray(places, np.int64) - by
            held[at[(at >= 0) & (at < len(held))]] |= 0x20
            letters = held.tobytes()
        out.append(letters)
    return pd.Series(out, dtype=object)


def _meet_tiles(pieces: DataFrame, tiles: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``pieces`` left-joined with ``tiles`` by shuffle (Spark knows a derived table's size by its file only and would
    broadcast large ones), a hot tile in several copies.

    Pieces are counted by tile first, or those of ``counted``, which may be some of them. A tile with more than a quarter of a partition's share, of which there are at most
    four times as many as partitions, gets a copy for each such part, and its pieces are dealt out over the copies."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stage((pieces if counted is None else counted).groupBy("chrom", "tile_id").agg(F.count(F.lit(1)).alias("n")))
    limit = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    hot = counts.where(F.col("n") > limit).select("chrom", "tile_id", F.ceil(F.col("n") / limit).cast("int").alias("__copies")).collect()
    unstage(counts)
    if not hot:
        return pieces.join(tiles.hint("merge"), ["chrom", "tile_id"], "left")
    known = F.broadcast(pieces.sparkSession.createDataFrame(hot, "chrom string, tile_id int, __copies int"))
    dealt = F.pmod(F.xxhash64(*(c for c in ("read_name", "flag", "ord", "q", "r") if c in pieces.columns)), F.coalesce("__copies", F.lit(1))).cast("int")
    left = pieces.join(known, ["chrom", "tile_id"], "left").withColumn("__copy", dealt).drop("__copies")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1)).alias("__copy")
    right = tiles.join(known, ["chrom", "tile_id"], "left").select(*tiles.columns, copies)
    return left.join(right.hint("merge"), ["chrom", "tile_id", "__copy"], "left").drop("__copy")


def _pieces(blocks: DataFrame, tile: int) -> DataFrame:
    """Blocks cut at tile borders: tile_id, q, r and n of each piece."""
    first, last = F.floor(F.col("r") / tile).cast("int"), F.floor((F.col("r") + F.col("n") - 1) / tile).cast("int")
    cut = blocks.withColumn("tile_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("r"), F.col("tile_id") * tile)
    stop = F.least(F.col("r") + F.col("n"), (F.col("tile_id") + 1) * tile)
    return cut.withColumns({"__begin": begin, "__stop": stop}).withColumns({"q": F.col("q") + F.col("__begin") - F.col("r"), "r": F.col("__begin"), "n": F.col("__stop") - F.col("__begin")}).drop("__begin", "__stop")


def aligned_pieces(reads: DataFrame, reference: DataFrame | None = None, tile: int = TILE, broadcast_chars: int = BROADCAST_CHARS, reference_chars: int | None = None, sites: DataFrame | None = None) -> DataFrame:
    """Reads' aligned pieces with both sequences: the read's columns, q, r, n, ref_seq, read_seq, qual_seq.

    With a reference (chrom, seq; or its tiles), pieces meet its tiles in an equi-join, by broadcast if the whole reference
    has at most ``broadcast_chars`` characters; ``reference_chars`` says how many it has, else a job counts them. Without a
    reference, the aligned reference is rebuilt from the MD string. A read that runs past its contig's end, a contig
    that isn't there, or a missing MD string is an error. At variant ``sites`` (chrom, pos) the letters of ref_seq are in
    lower case, elsewhere in upper case; the marks come with the tiles, so sites of any number cost no join of bases.
    """
    keep = [c for c in reads.columns if c not in ("seq", "qual", "md", "q", "r", "n", "m")]
    marks = None if sites is None else sites_by_tile(sites, tile)
    if reference is None:
        rebuilt = with_blocks(reads).withColumn("__ref", md_reference("seq", "blocks", "md"))
        rows = rebuilt.select(*keep, "seq", "qual", "__ref", F.inline("blocks"))
        if marks is not None:
            rows = rows.withColumn("m", F.col("m") - F.col("r"))
            rows = _pieces(rows, tile).withColumn("m", F.col("m") + F.col("r"))
            rows = rows.join(marks, ["chrom", "tile_id"], "left")
        ref, problem = F.upper(F.substr("__ref", F.col("m") + 1, F.col("n")).cast("string")).cast("binary"), "a read has neither a reference (FASTA) nor a usable MD tag"
        if marks is not None:
            rows = rows.withColumn("__part", ref).withColumn("__part", _lower_at("__part", "sites", F.col("r") - F.col("tile_id") * tile))
            ref = F.col("__part")
    else:
        if reference_chars is None:
            reference_chars = reference_length(reference)
        tiles = reference_tiles(reference, tile)
        if marks is not None:
            tiles = tiles.join(marks, ["chrom", "tile_id"], "left").select("chrom", "tile_id", _lower_at("ref_tile", "sites", F.lit(0)).alias("ref_tile"))
        pieces = _pieces(cigar_blocks(reads), tile)
        rows = pieces.join(F.broadcast(tiles), ["chrom", "tile_id"], "left") if reference_chars <= broadcast_chars else _meet_tiles(pieces, tiles)
        ref, problem = F.substr("ref_tile", F.col("r") - F.col("tile_id") * tile + 1, F.col("n")), "a read runs past the end of its contig, or the reference lacks it"
    checked = F.when(F.octet_length(ref) == F.col("n"), ref).otherwise(F.raise_error(F.lit(problem)).cast("binary"))
    part = lambda c: F.substr(F.col(c).cast("binary"), F.col("q") + 1, F.col("n")).cast("string")
    return rows.select(*keep, "q", "r", "n", checked.cast("string").alias("ref_seq"), F.upper(part("seq")).alias("read_seq"), part("qual").alias("qual_seq"))


_MD = re.compile(r"[0-9]+|\^[A-Za-z]+|[A-Za-z]")


def _md_one(query: bytes, md: str) -> bytes:
    at, out = 0, []
    for t in _MD.findall(md):
        if t[0] == "^":
            out.append(t[1:].encode())
        elif t.isdigit():
            out.append(query[at : at + int(t)])
            at += int(t)
        else:
            out.append(t.encode())
            at += 1
    return b"".join(out)


@F.arrow_udf(BinaryType())
def md_reference(seq: pa.Array, blocks: pa.Array, md: pa.Array) -> pa.Array:
    """The reference under a read, deletions included and skips left out, from its MD string.

    A number copies bases of the aligned query, a letter replaces one, and ^letters are bases the query lacks.
    """
    parts = blocks.flatten()
    q, n = (np.asarray(parts.field(c)).tolist() for c in ("q", "n"))
    out, at = [], 0
    for letters, size, text in zip(pc.cast(seq, pa.binary()).to_pylist(), pc.list_value_length(blocks).fill_null(0).to_pylist(), md.to_pylist(), strict=True):
        if letters is None or text is None:
            out.append(None)
        else:
            out.append(_md_one(b"".join([letters[q[i] : q[i] + n[i]] for i in range(at, at + size)]), text))
        at += size
    return pa.array(out, pa.binary())


def observed_bases(pieces: DataFrame) -> DataFrame:
    """One row per aligned base: ref_base, read_base, base_qual, ref_pos (1-based) and the piece's other columns."""
    keep = [c for c in pieces.columns if c not in ("q", "r", "n", "ref_seq", "read_seq", "qual_seq")]
    letters = lambda c: F.split(c, "")
    zipped = F.arrays_zip(letters(F.upper("ref_seq")).alias("ref_base"), letters("read_seq").alias("read_base"), letters("qual_seq").alias("qual_char"), F.sequence(F.col("r") + 1, F.col("r") + F.col("n")).alias("ref_pos"))
    rows = pieces.select(*keep, F.inline(zipped))
    return rows.select(*keep, "ref_base", "read_base", phred("qual_char").alias("base_qual"), "ref_pos")


def characters(column: pa.Array) -> np.ndarray:
    """All bytes of a string column without a null, straight from its buffers."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32 if column.type in (pa.string(), pa.binary()) else np.int64, len(column) + 1 + column.offset)[column.offset :]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def _letters(values: np.ndarray) -> pa.Array:
    """Strings of one byte each; 0 is an empty one."""
    ends = np.concatenate([[0], np.cumsum(values > 0)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(ends.tobytes()), pa.py_buffer(values[values > 0].astype(np.uint8).tobytes()))


@F.arrow_udf(_UNLIKE)
def _unlike(ref: pa.Array, read: pa.Array, qual: pa.Array) -> pa.Array:
    """Unlike bases of pieces, compared where they lie in a batch's buffers: at (from 1), both bases, quality. Only A, C, G
    and T of the reference count; a read or qualities that end before have an empty base, quality -33."""
    columns = [c.fill_null("") for c in (ref, read, qual)]
    sizes = [np.asarray(pc.binary_length(c), np.int64) for c in columns]
    held = [characters(c) for c in columns]
    ends = np.cumsum(sizes[0])
    row = np.repeat(np.arange(len(ref)), sizes[0])
    at = np.arange(len(held[0])) - np.repeat(ends - sizes[0], sizes[0])
    for k in (1, 2):
        if (sizes[k] != sizes[0]).any():
            inside = at < sizes[k][row]
            spread = np.zeros(len(row), np.uint8)
            spread[inside] = held[k][((np.cumsum(sizes[k]) - sizes[k])[row] + at)[inside]]
            held[k] = spread
    acgt = np.zeros(256, bool)
    acgt[list(b"ACGT")] = True
    found = np.flatnonzero((held[0] != held[1]) & acgt[held[0]])
    each = pa.StructArray.from_arrays([pa.array(at[found] + 1, pa.int32()), _letters(held[0][found]), _letters(held[1][found]), pa.array(held[2][found].astype(np.int32) - 33)], ["at", "ref_base", "read_base", "base_qual"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[found], np.arange(len(ref) + 1)), pa.int32()), each)


_unlike = _unlike.asNondeterministic()


def mismatches_of(pieces: DataFrame, min_base_qual: int = 0) -> DataFrame:
    """Mismatch rows: the bases differ, the reference base is A, C, G or T, and the quality is enough.

    Pieces that equal the reference are dropped at once, and of the others only the unlike bases become rows; a read
    base N is a mismatch.
    """
    unlike = pieces.withColumn("ref_seq", F.upper("ref_seq")).where(F.col("ref_seq") != F.col("read_seq")).withColumn("__unlike", _unlike("ref_seq", "read_seq", "qual_seq"))
    keep = [c for c in pieces.columns if c not in ("ref_base", "read_base", "base_qual", "at")]
    found = unlike.select(*keep, F.inline("__unlike")).withColumn("ref_pos", F.col("r") + F.col("at")).where(F.col("base_qual") >= min_base_qual)
    found = found.withColumns({"mapping_qual": F.col("mapq"), "is_read1": flag_has("flag", READ1), "is_reverse": flag_has("flag", REVERSE)})
    return found.select(*MISMATCH_COLS, *(c for c in ("ord", "region_ord") if c in found.columns))


def mismatches(reads: DataFrame, reference: DataFrame | None = None, min_mapq: int = 1, min_base_qual: int = 0, tile: int = TILE, broadcast_chars: int = BROADCAST_CHARS, reference_chars: int | None = None) -> DataFrame:
    """Mismatches of usable reads with a reference, or with their MD strings if there is none."""
    return mismatches_of(aligned_pieces(usable_reads(reads, min_mapq), reference, tile, broadcast_chars, reference_chars), min_base_qual)


def reads_in_regions(reads: DataFrame, regions: DataFrame, bin_size: int = 16_384) -> DataFrame:
    """Reads that overlap regions (region_ord, chrom, start, stop; 0-based, half-open), once per region they overlap.

    Both sides are laid out over bins of the reference and joined on (chrom, bin); the pair counts only in the first
    bin that both touch. Bases outside the region are kept.
    """
    over = lambda a, z: F.explode(F.sequence(F.floor(a / bin_size).cast("int"), F.floor((F.greatest(z, a + 1) - 1) / bin_size).cast("int")))
    left = reads.withColumn("__end", reference_end(F.col("cigar"), F.col("ref_start"))).withColumn("__bin", over(F.col("ref_start"), F.col("__end")))
    right = regions.where("stop > start").select(F.col("region_ord").alias("__region"), F.col("chrom").alias("__chrom"), F.col("start").alias("__start"), F.col("stop").alias("__stop")).withColumn("__rbin", over(F.col("__start"), F.col("__stop")))
    hit = left.join(right, (F.col("chrom") == F.col("__chrom")) & (F.col("__bin") == F.col("__rbin")) & (F.col("ref_start") < F.col("__stop")) & (F.col("__end") > F.col("__start")))
    first = F.greatest(F.floor(F.col("ref_start") / bin_size), F.floor(F.col("__start") / bin_size))
    return hit.where(F.col("__bin") == first).select(*(c for c in reads.columns if c != "region_ord"), F.col("__region").alias("region_ord"))


def owned_by_window(reads: DataFrame, window: int) -> DataFrame:
    """Adds window_id: the window of the contig in which the read starts, so each read has exactly one."""
    return reads.withColumn("window_id", F.floor(F.col("ref_start") / window))


def coordinate_order(rows: DataFrame, contigs: DataFrame, *then: str) -> DataFrame:
    """Sorted by the contigs' own order (not by name), then by the given columns."""
    order = contigs.select(F.col("name").alias("chrom"), F.col("ord").alias("__contig"))
    return rows.join(F.broadcast(order), "chrom", "left").orderBy("__contig", *then).select(*rows.columns)
