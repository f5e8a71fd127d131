"""A Python data source for BAM files: blocked gzip and the public record layout, no native library.

Records become Arrow batches with NumPy, many at a time. A file is read in byte ranges; a range finds its first block by
block headers and its first record by what a record must look like, so no index is needed. With an index beside the file
(``.bai`` or ``.csi``), predicates on chrom and ref_start, or the option ``regions``, choose the file chunks that are read.
Files are opened by path, so they must stand where every executor can open them (a shared mount). ``register(spark)`` makes
``spark.read.format("bam")`` available.
"""

from __future__ import annotations

import glob
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from phredlens.operators.statistics import mapped_counts
from phredlens.schemas import ALIGNMENTS
from phredlens.sources.bam_index import index_of, read_index
from phredlens.sources.blocked import Blocks, splits

# Fixed values of the record layout: letters of bases and operations, operations that move along the reference, and sizes
# of tag values by their type.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
ALONG = (0, 2, 3, 7, 8)
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
#: Bytes of a split and of data decoded at once; records in a row that prove a start that was searched for.
SPLIT, DECODED, PROOF = 64 << 20, 4 << 20, 4
_MOST = 1 << 29  # bytes of a record that is believed when a start is searched for

_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_TAG_SIZES = np.zeros(256, np.int64)
for _kind, _size in SIZES.items():
    _TAG_SIZES[ord(_kind)] = _size


def header(blocks: Blocks) -> tuple[list[tuple[str, int]], int]:
    """(contigs, bytes of the header) at the start of a file."""

    def number(at):
        if not blocks.need(at + 4):
            raise ValueError("not a BAM file")
        return struct.unpack_from("<i", blocks.data, at)[0]

    if not blocks.need(8) or bytes(blocks.data[:4]) != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + number(4)
    n, at, out = number(at), at + 4, []
    for _ in range(n):
        size = number(at)
        blocks.need(at + 8 + size)
        out.append((bytes(blocks.data[at + 4 : at + 3 + size]).decode(), number(at + 4 + size)))
        at += 8 + size
    return out, at


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indexes of the ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _text(data: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string column from its characters and the length of each value."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(sizes), [mask, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _cigars(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(CIGAR strings, bases along the reference, bases along the read) of operations at ``starts``."""
    ops = data[ranges(starts, 4 * counts)].view("<u4")
    n, op = (ops >> 4).astype(np.int64), (ops & 15).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    sums = lambda kinds: np.bincount(owner, np.where(np.isin(op, kinds), n, 0), len(counts)).astype(np.int64)
    digits = np.ones(len(n), np.int64)
    for k in range(1, 9):
        digits += n >= 10**k
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - 1] = np.frombuffer(OPS.encode() + b"?" * 7, np.uint8)[op]
    for k in range(int(digits.max()) if len(digits) else 0):
        has = digits > k
        out[ends[has] - 2 - k] = n[has] // 10**k % 10 + 48
    sizes = np.bincount(owner, digits + 1, len(counts)).astype(np.int64)
    return _text(out, sizes, counts > 0), sums(ALONG), sums((0, 1, 4, 7, 8))


def _tags(data: np.ndarray, at: np.ndarray, stop: np.ndarray, wanted: tuple[str, ...]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each wanted tag: (start of its value or -1, its size) by record. All records move a tag at a time."""
    found = {t: (np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)) for t in wanted}
    zeros = np.flatnonzero(data == 0)
    live, at = np.flatnonzero(at + 3 <= stop), at.copy()
    while len(live):
        p = at[live]
        first, second, kind = data[p], data[p + 1], data[p + 2]
        value, size = p + 3, _TAG_SIZES[kind]
        text = (kind == ord("Z")) | (kind == ord("H"))
        if text.any():
            ends = zeros[np.minimum(np.searchsorted(zeros, value[text]), len(zeros) - 1)]
            size = size.copy()
            size[text] = ends - value[text] + 1
        many = kind == ord("B")
        if many.any():
            v = value[many]
            counts = data[ranges(v + 1, np.full(len(v), 4))].view("<i4").astype(np.int64)
            size = size.copy()
            size[many] = 5 + counts * _TAG_SIZES[data[v]]
        if not size.all():
            raise ValueError("a tag of unknown type")
        for t, (starts, sizes) in found.items():
            here = (first == ord(t[0])) & (second == ord(t[1])) & (starts[live] < 0)
            starts[live[here]], sizes[live[here]] = value[here], size[here]
        at[live] = value + size
        live = live[at[live] + 3 <= stop[live]]
    return found


def decode(data: np.ndarray, at: np.ndarray, names: pa.Array, order: np.ndarray, technology: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """(ALIGNMENTS rows, reference ends) of the records that start at ``at`` in ``data``.

    A read of more operations than its count can tell keeps them in tag CG, behind a placeholder over the whole read."""
    fixed = data[ranges(at, np.full(len(at), FIXED.itemsize))].view(FIXED)
    wide = {k: fixed[k].astype(np.int64) for k in ("size", "ref", "pos", "n_name", "n_cigar", "n_seq")}
    name = at + FIXED.itemsize
    cigar, count = name + wide["n_name"], wide["n_cigar"]
    seq = cigar + 4 * count
    packed = (wide["n_seq"] + 1) // 2
    qual = seq + packed
    tags = _tags(data, qual + wide["n_seq"], at + 4 + wide["size"], ("MD", "CG"))
    md, md_size = tags["MD"]
    more, more_size = tags["CG"]
    # The placeholder: two operations, the first of them clips the whole read.
    held = np.flatnonzero((count == 2) & (more >= 0))
    held = held[data[ranges(cigar[held], np.full(len(held), 4))].view("<u4") == (wide["n_seq"][held] << 4 | 4)]
    cigar, count = cigar.copy(), count.copy()
    cigar[held], count[held] = more[held] + 5, (more_size[held] - 5) // 4
    cigars, along, _ = _cigars(data, cigar, count)
    pairs = data[ranges(seq, packed)]
    letters = np.stack([_LETTERS[pairs >> 4], _LETTERS[pairs & 15]], axis=1).ravel()
    starts = 2 * (np.cumsum(packed) - packed)
    bases = wide["n_seq"] > 0
    known = bases & (data[np.minimum(qual, len(data) - 1)] != 255)
    quality_sizes = np.where(known, wide["n_seq"], 0)
    md_sizes = np.where(md >= 0, md_size - 1, 0)
    columns = [
        _text(data[ranges(name, wide["n_name"] - 1)], wide["n_name"] - 1),
        pa.array(fixed["flag"].astype(np.int32)),
        names.take(pa.array(wide["ref"], mask=wide["ref"] < 0)),
        pa.array(fixed["pos"].astype(np.int32)),
        pa.array(fixed["mapq"].astype(np.int32)),
        cigars,
        _text(letters[ranges(starts, wide["n_seq"])], wide["n_seq"], bases),
        _text(data[ranges(qual, quality_sizes)] + np.uint8(33), quality_sizes, known),
        _text(data[ranges(md, md_sizes)], md_sizes, md >= 0),
        pa.array(order),
        pa.array([technology] * len(at), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNMENTS.split(", ")]), wide["pos"] + np.maximum(along, 1)


def _candidates(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of ``data`` whose fixed fields may be those of a record."""
    n = len(data) - FIXED.itemsize + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = lambda at: np.sum([data[at + k : at + k + n].astype(np.uint32) << np.uint32(8 * k) for k in range(4)], axis=0, dtype=np.uint32).view(np.int32).astype(np.int64)
    size, ref, pos, n_seq, next_ref, next_pos = (whole(FIXED.fields[k][1]) for k in ("size", "ref", "pos", "n_seq", "next_ref", "next_pos"))
    at = FIXED.fields["n_cigar"][1]
    n_name, n_cigar = data[FIXED.fields["n_name"][1] :][:n].astype(np.int64), data[at : at + n].astype(np.int64) | data[at + 1 : at + 1 + n].astype(np.int64) << 8
    most = np.append(lengths, 1 << 31)  # by contig; the last is for none
    inside = lambda r, p: (r >= -1) & (r < len(lengths)) & (p >= -1) & (p <= most[np.clip(r, -1, len(lengths) - 1)])
    return np.flatnonzero((size > 32) & (size < _MOST) & (n_name > 0) & (n_seq >= 0) & (32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq <= size) & inside(ref, pos) & inside(next_ref, next_pos))


def _proven(blocks: Blocks, at: int, lengths: np.ndarray) -> bool:
    """Whether ``PROOF`` records in a row stand at ``at``, or fewer up to the end of the file: fields, printable names, and
    operations that add up to the bases."""
    for proven in range(PROOF):
        if not blocks.need(at + FIXED.itemsize):
            return proven > 0 and at == len(blocks.data)
        head = np.frombuffer(bytes(blocks.data[at : at + FIXED.itemsize]), np.uint8)
        if not len(_candidates(head, lengths)):
            return False
        f = head.view(FIXED)[0]
        start, n_name, n_cigar = at + FIXED.itemsize, int(f["n_name"]), int(f["n_cigar"])
        if not blocks.need(start + n_name + 4 * n_cigar):
            return False
        name = bytes(blocks.data[start : start + n_name])
        ops = np.frombuffer(bytes(blocks.data[start + n_name : start + n_name + 4 * n_cigar]), "<u4")
        if name[-1] or not all(33 <= c <= 126 for c in name[:-1]) or ((ops & 15) >= len(OPS)).any():
            return False
        if n_cigar and f["n_seq"] and int((ops >> 4)[np.isin(ops & 15, (0, 1, 4, 7, 8))].sum()) != f["n_seq"]:
            return False
        at += 4 + int(f["size"])
        if not blocks.need(at):
            return False
    return True


def first_record(blocks: Blocks, lengths: np.ndarray, stop: int) -> int | None:
    """Place in the buffer of the first record that starts in a block before ``stop``; None if there is none."""
    searched = 0
    while True:
        while len(blocks.data) - searched < FIXED.itemsize:
            if not blocks.grow():
                return None
        if blocks.place(searched) >> 16 >= stop:
            return None
        data = np.frombuffer(bytes(blocks.data[searched:]), np.uint8)
        for k in _candidates(data, lengths).tolist():
            if blocks.place(searched + k) >> 16 >= stop:
                return None
            if _proven(blocks, searched + k, lengths):
                return searched + k
        searched += len(data) - FIXED.itemsize + 1


class Part(InputPartition):
    """A byte range of a file (records are searched for), or chunks of virtual offsets (records start there)."""

    def __init__(self, path: str, start: int = 0, stop: int = 0, chunks: list[tuple[int, int]] | None = None, regions=None):
        self.path, self.start, self.stop, self.chunks, self.regions = path, start, stop, chunks, regions


def records(part: Part, technology: str = "", counted: list[int] | None = None):
    """Record batches of a part. ``counted`` receives the bytes that were read from the file."""
    blocks = Blocks(part.path)
    contigs, head = header(blocks)
    names, lengths = pa.array([n for n, _ in contigs], pa.string()), np.array([n for _, n in contigs], np.int64)
    regions = None if part.regions is None else [(k, a, z) for name, a, z in part.regions for k, (n, _) in enumerate(contigs) if n == name]
    if part.chunks is not None:
        spans = [(a >> 16, a & 0xFFFF, z) for a, z in part.chunks]
    elif part.start == 0:
        spans = [(None, head, part.stop << 16)]
    else:
        begin = blocks.seek_block(part.start, part.stop)
        if begin is None:
            spans = []
        else:
            blocks.jump(begin)
            at = first_record(blocks, lengths, part.stop)
            spans = [] if at is None else [(None, at, part.stop << 16)]
    for jump, at, stop in spans:
        if jump is not None:
            blocks.jump(jump)
        done = False
        while not done:
            starts, sizes = [], blocks.data
            while len(starts) == 0 or at - starts[0] < DECODED:
                if not blocks.need(at + 4):
                    done = True
                    break
                if blocks.place(at) >= stop:
                    done = True
                    break
                size = struct.unpack_from("<i", blocks.data, at)[0]
                if not blocks.need(at + 4 + size):
                    raise ValueError("a BAM file ends inside a record")
                starts.append(at)
                at += 4 + size
            if starts:
                found = np.array(starts, np.int64)
                ends = np.array([0, *blocks.ends])
                k = np.searchsorted(ends, found, "right") - 1
                order = (np.array(blocks.starts, np.int64)[k] << 16) | (found - ends[k])
                batch, stops = decode(np.frombuffer(bytes(sizes), np.uint8), found, names, order, technology)
                if regions is not None:
                    ref = batch.column("chrom")
                    pos = np.asarray(batch.column("ref_start"))
                    hit = np.zeros(len(pos), bool)
                    for k, a, z in regions:
                        same = np.asarray(pc.fill_null(pc.equal(ref, names[k]), False))
                        hit |= same & (pos < z) & (stops > a)
                    batch = batch.filter(pa.array(hit))
                yield batch
            blocks.cut(at)
            at -= blocks.gone
    if counted is not None:
        counted.append(blocks.bytes_read)


def _windows(filters) -> tuple[list[str] | None, int, int]:
    """(contigs or None for all, least and largest ref_start) that the predicates allow."""
    chroms, low, high = None, -1, 1 << 31
    for f in filters:
        column = getattr(f, "attribute", None)
        if column == ("chrom",) and isinstance(f, EqualTo | In):
            given = [f.value] if isinstance(f, EqualTo) else list(f.value)
            chroms = given if chroms is None else [c for c in chroms if c in given]
        elif column == ("ref_start",):
            if isinstance(f, EqualTo):
                low, high = max(low, f.value), min(high, f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                low = max(low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                high = min(high, f.value - isinstance(f, LessThan))
    return chroms, low, high


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.technology = options["path"].removeprefix("file://"), options.get("technology", "")
        self.width = int(options.get("split", SPLIT))
        self.regions = [_region(x) for x in options["regions"].split(",")] if options.get("regions") else None
        self.window = None, -1, 1 << 31

    def pushFilters(self, filters):
        """Predicates on chrom and ref_start choose file chunks where there is an index. All are still to be applied."""
        self.window = _windows(filters)
        return filters

    def partitions(self):
        out = []
        for path in sorted(glob.glob(self.path)) or [self.path]:
            index = index_of(path)
            chroms, low, high = self.window
            regions = self.regions
            if regions is None and chroms is not None:
                regions = [(c, max(low, 0), high + 1) for c in chroms]
            if index and regions is not None:
                blocks = Blocks(path)
                numbers = {n: k for k, (n, _) in enumerate(header(blocks)[0])}
                chunks, held = [], read_index(index)
                for name, a, z in regions:
                    chunks += held.chunks(numbers[name], a, z) if name in numbers else []
                out += [Part(path, chunks=c, regions=self.regions) for c in _grouped(chunks, self.width)]
            else:
                with open(path, "rb") as f:
                    size = f.seek(0, 2)
                out += [Part(path, a, z, regions=self.regions) for a, z in splits(size, self.width)]
        return out or [Part("", chunks=[])]

    def read(self, partition):
        return records(partition, self.technology) if partition.path else iter(())


def _grouped(chunks: list[tuple[int, int]], width: int) -> list[list[tuple[int, int]]]:
    """Chunks without overlap, in groups of about ``width`` compressed bytes."""
    merged: list[tuple[int, int]] = []
    for a, z in sorted(chunks):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(z, merged[-1][1])
        else:
            merged.append((a, z))
    out, held = [], 0
    for a, z in merged:
        if not out or held >= width:
            out.append([])
            held = 0
        out[-1].append((a, z))
        held += (z >> 16) - (a >> 16) + 1
    return out


def _region(text: str) -> tuple[str, int, int]:
    """(contig, start, stop) of ``name``, or ``name:start-stop`` with 1-based places, both ends included."""
    name, _, span = text.rpartition(":")
    if not name:
        return text, 0, 1 << 31
    a, z = span.split("-")
    return name, int(a) - 1, int(z)


class BamSource(DataSource):
    """Alignments; ord is the record's virtual offset, so it rises along the file. Options: technology (a label), split
    (bytes of a partition), regions (``name`` or ``name:start-stop``, 1-based, comma between them: reads that overlap one)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return ALIGNMENTS

    def reader(self, schema):
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)


def contig_rows(path: str) -> list[tuple[int, str, int]]:
    contigs, _ = header(Blocks(path.removeprefix("file://")))
    return [(k, n, size) for k, (n, size) in enumerate(contigs)]


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, length) of a BAM file's header."""
    return spark.createDataFrame(contig_rows(path), "ord int, name string, length long")


def reads_of_regions(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], technology: str = "") -> DataFrame:
    """Reads that overlap a region (contig, start, stop; 0-based, half-open), each once. With an index only its chunks are
    read, else the file is."""
    register(spark)
    told = ",".join(f"{c}:{a + 1}-{z}" for c, a, z in regions)
    return spark.read.format("bam").option("technology", technology).option("regions", told).load(path)


def indexed_counts(spark: SparkSession, path: str) -> DataFrame:
    """``mapped_counts`` of a BAM file from the counts in its index, without reading a record; from the records where there
    is no index, or one without counts."""
    index = index_of(path.removeprefix("file://"))
    rows = contig_rows(path)
    held = read_index(index).contigs if index else []
    if index and len(held) == len(rows) and all(c.mapped is not None or not c.chunks for c in held):
        return spark.createDataFrame([(*r, c.mapped or 0) for r, c in zip(rows, held, strict=True)], "ord int, name string, length long, n_mapped long")
    register(spark)
    return mapped_counts(spark.read.format("bam").load(path).select("flag", "chrom"), spark.createDataFrame(rows, "ord int, name string, length long")).orderBy(F.col("ord"))
