"""One file from the partitions of a frame, in their order, without passing its bytes through the driver.

Tasks write their rows as pieces beside the file; the sizes of the pieces, a row a partition, tell where each goes; tasks
copy the pieces to their places. A task that runs again writes a piece of its own name or copies the same bytes to the same
place. The path must stand where every executor can write (a shared mount).
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Turns the batches of a partition into bytes; what it returns at its end is kept with the piece.
Encoder = Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]]


@dataclass
class Piece:
    part: int
    name: str
    size: int
    note: bytes
    start: int = 0


def local(path) -> str:
    return str(path).removeprefix("file://")


def write_joined(rows: DataFrame, path: str, encode: Encoder, head: bytes = b"", tail: bytes = b"") -> list[Piece]:
    """Write ``head``, the rows as ``encode`` gives them, and ``tail`` to ``path``; returns the pieces with their places.

    No rows leave head and tail. A file that stands there is replaced once the new one is whole."""
    path = local(path)
    folder, whole = f"{path}.pieces-{uuid.uuid4().hex}", f"{path}.new-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def pieces(batches):
        task = TaskContext.get()
        name, size, note = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, b""
        steps = encode(batches)
        with open(os.path.join(folder, name), "wb") as f:
            while True:
                try:
                    data = next(steps)
                except StopIteration as end:
                    note = end.value or b""
                    break
                size += f.write(data)
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "name": [name], "size": [size], "note": [note]})

    def copied(batches):
        for b in batches:
            for name, start, size in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                with open(os.path.join(folder, name), "rb") as source, open(whole, "r+b") as target:
                    target.seek(start)
                    shutil.copyfileobj(source, target, 1 << 20)
                if os.path.getsize(os.path.join(folder, name)) != size:
                    raise OSError(f"piece {name} of {path} has changed")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32())})

    try:
        found = rows.mapInArrow(pieces, "part int, name string, size long, note binary").collect()
        out = sorted((Piece(r.part, r.name, r.size, bytes(r.note)) for r in found), key=lambda p: p.part)
        at = len(head)
        for p in out:
            p.start = at
            at += p.size
        with open(whole, "wb") as f:
            f.write(head)
            f.seek(at)
            f.write(tail)
            f.truncate(at + len(tail))
        filled = [(p.name, p.start, p.size) for p in out if p.size]
        if filled:
            spark = rows.sparkSession
            spark.createDataFrame(filled, "name string, start long, size long").repartition(len(filled)).mapInArrow(copied, "n int").collect()
        os.replace(whole, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        if os.path.exists(whole):
            os.remove(whole)
    return out
