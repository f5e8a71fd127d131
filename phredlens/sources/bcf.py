"""A Python data source for binary variant files: blocked gzip and the public record layout, read in byte ranges of the
compressed file.

A range owns the records that start in its blocks. Its first one is searched for: its fixed fields, name, alleles and
filters must be sound, and so must those of the records that follow it. Files are opened by path (a shared mount).
"""

from __future__ import annotations

import glob
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phredlens.schemas import VARIANTS, names
from phredlens.sources.blocked import Blocks, splits
from phredlens.sources.joined import local

# Fixed values of the record layout: format and missing value of each type of integer, and the missing float.
_INTEGERS = {1: ("b", -128), 2: ("h", -32768), 3: ("i", -2147483648)}
_NO_QUALITY = 0x7F800001
#: Bytes of a record's two lengths and fixed fields.
_HEAD = 32
_TYPES = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
#: Compressed bytes of a split, bytes of data decoded at once, and records in a row that prove a start.
SPLIT, DECODED, PROOF = 64 << 20, 4 << 20, 4


def _typed(raw: bytes, at: int) -> tuple[object, int]:
    """(value, next place) of a typed value: a string, or a list of integers without missing ones."""
    size, kind = raw[at] >> 4, raw[at] & 15
    at += 1
    if size == 15:
        (size,), at = _typed(raw, at)
    if kind == 7:
        return raw[at : at + size].rstrip(b"\0").decode(), at + size
    if kind == 0:
        return [], at
    form, missing = _INTEGERS[kind]
    values = struct.unpack_from(f"<{size}{form}", raw, at)
    return [v for v in values if v > missing + 7], at + size * struct.calcsize(form)


def _dictionaries(header: str) -> tuple[dict[int, str], dict[int, str]]:
    """(filters and the like, contigs) by number: by IDX where it is given, else by order; PASS is number 0."""
    strings, contigs = {0: "PASS"}, {}
    for kind, fields in re.findall(r"^##(contig|FILTER|INFO|FORMAT)=<(.*)>", header, re.M):
        name = re.search(r"(?:^|,)ID=([^,>]+)", fields)[1]
        given = re.search(r"(?:^|,)IDX=(\d+)", fields)
        table = contigs if kind == "contig" else strings
        if given:
            table[int(given[1])] = name
        elif name not in table.values():
            table[len(table)] = name
    return strings, contigs


def _record(raw: bytes, strings: dict[int, str], contigs: dict[int, str]) -> tuple:
    chrom, pos, _, quality, n_info, n_allele = struct.unpack_from("<iiiIHH", raw)
    name, at = _typed(raw, 24)
    alleles = []
    for _ in range(n_allele):
        allele, at = _typed(raw, at)
        alleles.append(allele)
    filters, _ = _typed(raw, at)
    number = None if quality == _NO_QUALITY else struct.unpack("<f", struct.pack("<I", quality))[0]
    return contigs[chrom], pos + 1, name or ".", alleles[0], ",".join(alleles[1:]) or ".", number, ";".join(strings[f] for f in filters) or "."


def _header(blocks: Blocks) -> tuple[dict[int, str], dict[int, str], int, int]:
    """(filters and the like, contigs, number of samples, place of the first record)."""
    if not blocks.need(9) or bytes(blocks.data[:5]) != b"BCF\2\2":
        raise ValueError("not a binary variant file of version 2.2")
    stop = 9 + struct.unpack_from("<i", blocks.data, 5)[0]
    if not blocks.need(stop):
        raise ValueError("a binary variant file ends inside its header")
    text = bytes(blocks.data[9:stop]).rstrip(b"\0").decode()
    columns = re.search(r"^#CHROM.*", text, re.M)
    samples = max(0, len(columns[0].split("\t")) - 9) if columns else 0
    return *_dictionaries(text), samples, stop


def _candidates(data: np.ndarray, contigs: dict[int, str], samples: int) -> np.ndarray:
    """Places of ``data`` whose fixed fields may be those of a record."""
    n = len(data) - _HEAD + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def number(at: int, size: int = 4) -> np.ndarray:
        return sum(data[at + k : at + k + n].astype(np.int64) << (8 * k) for k in range(size))

    shared, chrom, pos, rlen = number(0), number(8), number(12), number(16)
    sound = (shared >= _HEAD - 8) & (chrom <= max(contigs, default=-1)) & ((pos < 1 << 31) | (pos == (1 << 32) - 1)) & (rlen < 1 << 31)
    return np.flatnonzero(sound & (number(26, 2) > 0) & (number(28, 3) == samples))


def _proven(blocks: Blocks, at: int, strings: dict[int, str], contigs: dict[int, str], samples: int) -> bool:
    """Whether ``PROOF`` records in a row stand at ``at``, or fewer up to the end of the file."""
    for proven in range(PROOF):
        if not blocks.need(at + _HEAD):
            return proven > 0 and at == len(blocks.data)
        head = np.frombuffer(bytes(blocks.data[at : at + _HEAD]), np.uint8)
        if not len(_candidates(head, contigs, samples)):
            return False
        shared, single = struct.unpack_from("<II", blocks.data, at)
        if not blocks.need(at + 8 + shared):
            return False
        try:
            _record(bytes(blocks.data[at + 8 : at + 8 + shared]), strings, contigs)
        except (KeyError, IndexError, TypeError, ValueError, struct.error):  # a name, number or length that no record has
            return False
        at += 8 + shared + single
        if not blocks.need(at):
            return False
    return True


def _first_record(blocks: Blocks, stop: int, *known) -> int | None:
    """Place in the buffer of the first record that starts in a block before ``stop``; None if there is none."""
    searched = 0
    while blocks.need(searched + _HEAD):
        data = np.frombuffer(bytes(blocks.data[searched:]), np.uint8)
        for k in _candidates(data, *known[1:]).tolist():
            if blocks.place(searched + k) >> 16 >= stop:
                return None
            if _proven(blocks, searched + k, *known):
                return searched + k
        searched += len(data) - _HEAD + 1
        if blocks.place(searched) >> 16 >= stop:
            return None
    return None


class Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def records(part: Part):
    """Lists of the records of a part, as tuples of ``VARIANTS``."""
    blocks = Blocks(part.path)
    strings, contigs, samples, at = _header(blocks)
    first, stop = blocks.place(at) >> 16, part.stop << 16
    if part.start > first:
        begin = blocks.seek_block(part.start, part.stop)
        if begin is None:
            return
        blocks.jump(begin)
        at = _first_record(blocks, part.stop, strings, contigs, samples)
        if at is None:
            return
    elif part.stop <= first:
        return
    found, held = [], 0
    while blocks.need(at + 8) and blocks.place(at) < stop:
        shared, single = struct.unpack_from("<II", blocks.data, at)
        if not blocks.need(at + 8 + shared + single):
            raise ValueError("a binary variant file ends inside a record")
        found.append(_record(bytes(blocks.data[at + 8 : at + 8 + shared]), strings, contigs))
        at += 8 + shared + single
        held += 8 + shared + single
        if held > DECODED:
            yield found
            found, held = [], 0
            blocks.cut(at)
            at -= blocks.gone
    if found:
        yield found


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = local(options["path"]), int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path in sorted(glob.glob(self.path)) or [self.path]:
            with open(path, "rb") as f:
                out += [Part(path, a, z) for a, z in splits(f.seek(0, 2), self.width)] or [Part(path, 0, 1)]
        return out

    def read(self, partition):
        for rows in records(partition):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names(VARIANTS))


class BcfSource(DataSource):
    """Option: split (compressed bytes of a partition)."""

    @classmethod
    def name(cls):
        return "bcf"

    def schema(self):
        return VARIANTS

    def reader(self, schema):
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BcfSource)
