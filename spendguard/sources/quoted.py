"""Delimited files whose quoted fields hold line breaks, read in splits.

Whether a line starts inside a quoted field depends on all lines before it. A split is therefore read under both
assumptions at once: one pass leaves a row per split that says how it ends and how many records it starts under each,
a window over these few rows finds out which assumption holds, and a second pass cuts the lines into records. Lines
that are records of their own stay where they were read; only the lines of longer records meet, by the place where
their record starts. No file has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendguard.scratch import materialise


def inside_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Does a line end inside a quoted field, if it starts inside one or at the start of a record?

    A quote opens a field only where the field starts; a doubled quote inside is text; what follows the closing quote
    belongs to the field up to the next separator.
    """
    at = 0
    while True:
        if not inside:
            if not line.startswith(b'"', at):
                at = line.find(sep + b'"', at)
                if at < 0:
                    return False
                at += len(sep)
            at += 1
        at = line.find(b'"', at)
        while at >= 0 and line.startswith(b'""', at):
            at = line.find(b'"', at + 2)
        if at < 0:
            return True
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        at, inside = at + len(sep), False


class _Split:
    """Lines of a split in order, under both assumptions about its start."""

    def __init__(self, sep: bytes):
        self.sep, self.inside, self.starts, self.lines = sep, [False, True], [0, 0], 0

    def take(self, line: bytes) -> tuple:
        """Number of the line, then for both assumptions: did it start inside, number of its record, does it end inside."""
        before = tuple(self.inside)
        for i, inside in enumerate(before):
            self.starts[i] += not inside
            if b'"' in line:
                self.inside[i] = inside_after(line, inside, self.sep)
        self.lines += 1
        return (self.lines - 1, *before, *self.starts, *self.inside)


def _splits(sep: bytes, batches: Iterator[pa.RecordBatch]):
    """(file, block, state, lines) for the stretches of one split in each batch."""
    key, state = None, None
    for batch in batches:
        files, blocks, lines = (c.to_pylist() for c in batch.columns)
        start = 0
        for i in range(len(lines)):
            if (files[i], blocks[i]) != key:
                if i > start:
                    yield *key, state, lines[start:i]
                key, state, start = (files[i], blocks[i]), _Split(sep), i
        if len(lines) > start:
            yield *key, state, lines[start:]


def read_records(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """`_file`, `_record` (text, line breaks as line feeds) of every record but the first one of each file, its header.

    Empty lines outside quotes are no records. A quote that is never closed makes one record of the rest of its file.
    """
    mark = sep.encode(encoding)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").cast("binary").alias("_line")
    )

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for file, block, state, part in _splits(mark, batches):
            if last is not None and last[2] is not state:
                yield summary(*last)
            for line in part:
                state.take(line)
            last = (file, block, state)
        if last is not None:
            yield summary(*last)

    def summary(file, block, state) -> pa.RecordBatch:
        row = {"_file": file, "_block": block, "_out0": state.inside[0], "_out1": state.inside[1], "_starts0": state.starts[0], "_starts1": state.starts[1]}
        return pa.RecordBatch.from_pylist([row])

    table = materialise(
        lines.mapInArrow(ends, "_file string, _block bigint, _out0 boolean, _out1 boolean, _starts0 bigint, _starts1 bigint"), "split_ends"
    )
    # One row per split: the state after the last split that does not depend on its start, turned by those that turn it.
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.expr("int(_out0 and not _out1)")).over(earlier), F.lit(0))
    fixed = table.withColumn("_turns", turns).withColumn(
        "_known", F.last(F.expr("if(_out0 = _out1, struct(_out0 as state, _turns as turns), null)"), ignorenulls=True).over(earlier)
    )
    inside = F.expr("int(coalesce(_known.state, false)) + _turns - coalesce(_known.turns, 0L)") % 2 == 1
    known = fixed.withColumn("_inside", inside).withColumn("_starts", F.when(F.col("_inside"), F.col("_starts1")).otherwise(F.col("_starts0")))
    carried = F.last(F.expr("if(_starts > 0, struct(_block as block, _starts as number), null)"), ignorenulls=True).over(earlier)
    states = materialise(known.withColumn("_carried", carried).select("_file", "_block", "_inside", "_carried"), "split_states")

    names = ["_file", "_block", "_line", "_no", "_before0", "_before1", "_number0", "_number1", "_after0", "_after1"]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, state, part in _splits(mark, batches):
            taken = zip(*map(state.take, part))
            columns = [pa.array([file] * len(part)), pa.array([block] * len(part), pa.int64()), pa.array(part, pa.binary()), *map(pa.array, taken)]
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = lines.mapInArrow(
        places,
        "_file string, _block bigint, _line binary, _no bigint, _before0 boolean, _before1 boolean, _number0 bigint, _number1 bigint, "
        "_after0 boolean, _after1 boolean",
    ).join(states, ["_file", "_block"])
    true_one = {c: F.when(F.col("_inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")) for c in ("_before", "_number", "_after")}
    placed = placed.withColumns(true_one)
    alone = placed.where("not _before and not _after and not (_block = 0 and _number = 1) and octet_length(_line) > 0")
    start = F.when(F.col("_number") > 0, F.struct(F.col("_block").alias("block"), F.col("_number").alias("number"))).otherwise(F.col("_carried"))
    longer = (
        placed.where("_before or _after").withColumn("_start", start).groupBy("_file", "_start")
        .agg(F.array_sort(F.collect_list(F.struct("_block", "_no", "_line"))).alias("_parts"))
        .where("not (_start.block = 0 and _start.number = 1)")
    )
    text = lambda c: F.decode(c, encoding)
    return alone.select("_file", text("_line").alias("_record")).unionByName(
        longer.select("_file", F.array_join(F.transform("_parts._line", text), "\n").alias("_record"))
    )
