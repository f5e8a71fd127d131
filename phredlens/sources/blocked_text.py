"""A Python data source for lines of blocked gzip text, read in byte ranges of the compressed file.

A range owns the lines that begin after its first block's first byte, up to and with the one that begins at the first byte of
the next range; so it skips what stands before its first line break, and reads on to the end of its last line. Files are
opened by path, so they must stand where every executor can open them (a shared mount).
"""

from __future__ import annotations

import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phredlens.sources.blocked import Blocks, block_size, splits
from phredlens.sources.joined import local

LINES = "value string, file string, block long"
#: Compressed bytes of a split, and bytes of data decoded at once.
SPLIT, DECODED = 64 << 20, 4 << 20


def is_blocked(path: str) -> bool:
    """Whether the (first) file at a path is blocked gzip; other gzip files, and what can't be opened by path, aren't."""
    found = sorted(glob.glob(local(path)))
    try:
        with open(found[0] if found else local(path), "rb") as f:
            return block_size(f.read(18)) > 0
    except OSError:
        return False


class Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def lines(part: Part):
    """Lists of lines of a part, without their line breaks."""
    blocks = Blocks(part.path)
    begin = blocks.seek_block(part.start, part.stop) if part.start else 0
    if begin is None:
        return
    blocks.jump(begin)
    at, over = 0, None  # over: the first byte after the range, once it is known
    if part.start:
        while (at := blocks.data.find(b"\n")) < 0:
            if blocks.next >= part.stop:
                over = len(blocks.data)
            if not blocks.grow():
                return
        at += 1
        if over is not None and at > over:
            return  # one line covers the range
    while True:
        while over is None and len(blocks.data) - at < DECODED:
            if blocks.next >= part.stop:
                over = len(blocks.data)
            elif not blocks.grow():
                over = len(blocks.data) + 1
        data = bytes(blocks.data)
        if over is None:
            stop = data.rfind(b"\n") + 1
            if stop > at:
                yield data[at : stop - 1].split(b"\n")
                blocks.cut(stop)
                at = stop - blocks.gone
            elif not blocks.grow():
                over = len(data) + 1
            continue
        # The last line begins at ``over`` at most; read on to its end.
        last = max(data.rfind(b"\n", 0, over) + 1, at)
        while (end := blocks.data.find(b"\n", last)) < 0 and blocks.grow():
            pass
        tail = bytes(blocks.data[at : end if end >= 0 else len(blocks.data)])
        if end >= 0 or tail:
            # At the end of the file a line break ends the last line.
            yield (tail.removesuffix(b"\n") if end < 0 else tail).split(b"\n")
        return


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = local(options["path"]), int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path in sorted(glob.glob(self.path)) or [self.path]:
            with open(path, "rb") as f:
                out += [Part(path, a, z) for a, z in splits(f.seek(0, 2), self.width)]
        return out or [Part("", 0, 0)]

    def read(self, partition):
        for found in lines(partition) if partition.path else ():
            yield pa.RecordBatch.from_pydict({"value": pa.array([x.decode() for x in found], pa.string()), "file": [partition.path] * len(found), "block": pa.array([partition.start] * len(found), pa.int64())})


class BlockedText(DataSource):
    """Option: split (compressed bytes of a partition). block is the first byte of the line's range."""

    @classmethod
    def name(cls):
        return "blocked_text"

    def schema(self):
        return LINES

    def reader(self, schema):
        return Reader(self.options)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block) of the lines of a text file, in their order inside a split: blocked gzip in many splits, plain
    text too, other gzip in one."""
    if is_blocked(path):
        spark.dataSource.register(BlockedText)
        return spark.read.format("blocked_text").option("split", SPLIT).load(path)
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
