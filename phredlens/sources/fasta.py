"""A Python data source that reads a FASTA file as reference tiles, by the byte ranges that its index (``.fai``) gives.

A contig of any length is read by as many tasks as its bytes ask for, and no row is longer than a tile. Files are opened by
path, so they must stand where every executor can open them (a shared mount).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phredlens.operators.alignments import TILE
from phredlens.sources.joined import local

TILES = "chrom string, tile_id int, ref_tile binary"
#: Bases that a task reads, and bases of a batch.
SPLIT, BATCH = 32 << 20, 4 << 20


@dataclass
class Entry:
    """A line of the index: where a contig's bases begin, bases of a line, and bytes of a line with its end."""

    name: str
    length: int
    offset: int
    bases: int
    width: int

    def byte(self, base: int) -> int:
        return self.offset + base // self.bases * self.width + base % self.bases


def read_entries(path: str) -> list[Entry]:
    with open(path, encoding="utf-8") as f:
        fields = [line.rstrip("\r\n").split("\t") for line in f if line.strip()]
    return [Entry(name, *map(int, more[:4])) for name, *more in fields]


class Part(InputPartition):
    def __init__(self, spans: list[tuple[Entry, int, int]]):
        self.spans = spans


def parts(entries: list[Entry], tile: int, width: int) -> list[Part]:
    """Spans of whole tiles, of about ``width`` bases a part; a long contig has many parts, a part many short contigs."""
    step, out, held = max(tile, width // tile * tile), [], None
    for e in entries:
        for start in range(0, e.length, step):
            stop = min(start + step, e.length)
            if held is None or held + stop - start > step:
                out.append([])
                held = 0
            out[-1].append((e, start, stop))
            held += stop - start
    return [Part(x) for x in out]


def bases_of(file, e: Entry, start: int, stop: int) -> bytes:
    """Bases [start, stop) of a contig in upper case."""
    file.seek(e.byte(start))
    got = file.read(e.byte(stop - 1) + 1 - e.byte(start)).translate(None, b"\r\n").upper()
    if len(got) != stop - start or b">" in got:
        raise ValueError(f"the index doesn't fit its file at {e.name}")
    return got


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tile = local(options["path"]), int(options.get("tile", TILE))
        self.width = int(options.get("split", SPLIT))

    def partitions(self):
        return parts(read_entries(f"{self.path}.fai"), self.tile, self.width) or [Part([])]

    def read(self, partition):
        step = max(self.tile, BATCH // self.tile * self.tile)
        with open(self.path, "rb") as file:
            for e, start, stop in partition.spans:
                for a in range(start, stop, step):
                    z = min(a + step, stop)
                    got = bases_of(file, e, a, z)
                    tiles = [got[k : k + self.tile] for k in range(0, len(got), self.tile)]
                    first = a // self.tile
                    yield pa.RecordBatch.from_pydict({"chrom": [e.name] * len(tiles), "tile_id": pa.array(range(first, first + len(tiles)), pa.int32()), "ref_tile": pa.array(tiles, pa.binary())})


class FastaTiles(DataSource):
    """Options: tile (bases of a tile), split (bases of a task)."""

    @classmethod
    def name(cls):
        return "fasta_tiles"

    def schema(self):
        return TILES

    def reader(self, schema):
        return Reader(self.options)


def read_tiles(spark: SparkSession, path: str, tile: int = TILE, split: int = SPLIT) -> DataFrame:
    """(chrom, tile_id, ref_tile) as ``reference_tiles`` has them, from a FASTA file with an index beside it. A contig
    without a base has no tile. Lines of a contig have one length, but for the last, as its index needs."""
    spark.dataSource.register(FastaTiles)
    return spark.read.format("fasta_tiles").option("tile", tile).option("split", split).load(path)


def has_index(path: str) -> bool:
    return os.path.exists(f"{local(path)}.fai")


def indexed_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, length) of the index beside a FASTA file."""
    rows = [(k, e.name, e.length) for k, e in enumerate(read_entries(f"{local(path)}.fai"))]
    return spark.createDataFrame(rows, "ord int, name string, length long").orderBy(F.col("ord"))
