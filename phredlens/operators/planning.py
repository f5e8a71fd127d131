"""Scan windows and calling intervals from contig lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phredlens.operators.statistics import mapped_counts


def scan_windows(reads: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """(idx, chrom, start, stop): windows of ``size`` over contigs with mapped reads, the last one clipped.

    idx counts from 0 over all contigs in their order. Work is by contig, of which there are few."""
    if size < 1:
        raise ValueError("a window has one base at least")
    live = mapped_counts(reads, contigs).where("n_mapped > 0 and length > 0")
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    numbered = live.withColumn("first", F.coalesce(F.sum(F.ceil(F.col("length") / size)).over(before), F.lit(0)))
    tiles = numbered.select("name", "length", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    return tiles.select((F.col("first") + F.floor(F.col("start") / size)).cast("long").alias("idx"), F.col("name").alias("chrom"), "start", F.least(F.col("start") + size, F.col("length")).alias("stop"))


def interval_tasks(contigs: DataFrame, chunk: int) -> DataFrame:
    """(task, intervals): groups of whole contigs of about ``chunk`` bases; longer contigs alone, in 1-based pieces.

    A group closes as soon as it holds ``chunk`` bases or a long contig follows. The fold resets its state, so it walks
    along the one sorted list of contigs, a batch at a time, with a sum and a number in hand: time by the number of contigs. A
    null length counts as 0."""
    if chunk < 1:
        raise ValueError("a chunk has one base at least")

    def run(batches):
        task = size = place = 0
        held = False
        for b in batches:
            tasks = []
            for n in b.column(1).to_pylist():
                if n > chunk:
                    task += held
                    tasks.append(task)
                    task, size, held = task - (-n // chunk), 0, False
                else:
                    tasks.append(task)
                    size, held = size + n, True
                    if size >= chunk:
                        task, size, held = task + 1, 0, False
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tasks, pa.int64()), pa.array(range(place, place + len(tasks)), pa.int64())], names=["name", "length", "task", "place"])
            place += len(tasks)

    listed = contigs.select("ord", "name", F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length")).repartition(1).sortWithinPartitions("ord", "name", "length")
    placed = listed.select("name", "length").mapInArrow(run, "name string, length long, task long, place long")
    first = F.explode(F.when(F.col("length") > chunk, F.sequence(F.lit(1).cast("long"), F.col("length"), F.lit(chunk).cast("long"))).otherwise(F.array(F.lit(1).cast("long"))))
    parts = placed.select("*", first.alias("a"))
    piece = F.concat("name", F.lit(":"), F.col("a").cast("string"), F.lit("-"), F.least(F.col("a") + (chunk - 1), F.col("length")).cast("string"))
    spelt = F.when(F.col("length") > chunk, piece).otherwise(F.col("name"))
    tasks = parts.select((F.col("task") + F.floor((F.col("a") - 1) / chunk)).cast("int").alias("task"), F.struct("place", spelt.alias("name")).alias("x"))
    return tasks.groupBy("task").agg(F.array_sort(F.collect_list("x")).alias("x")).select("task", F.col("x.name").alias("intervals"))
