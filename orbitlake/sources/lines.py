"""Lines of text files, read in splits: a file of any size is many tasks.

Spark's text scan cuts files into blocks at line ends. Lines are numbered by their place in the block and the sizes of
the blocks before; only the block sizes of one file ever meet in one task, and the lines that a block needs from the
next one travel to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.workspace import write_through

BYTE_ORDER_MARK = "﻿"


def _together(ends: bytes, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of a block's consecutive lines, as the scan gives them, joined by ``ends``."""
    names, mark = ["path", "modified", "size", "block", "run", "lines", "bytes", "text"], BYTE_ORDER_MARK.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, length, number = None, [], 0, 0
        made: list[tuple] = []

        def finish() -> None:
            nonlocal lines, length, number
            if lines:
                made.append((*key, number, len(lines), sum(map(len, lines)), ends.join(lines)))
                lines, length, number = [], 0, number + 1

        def written(like: pa.Schema) -> pa.RecordBatch:
            kinds = [like.field(n).type for n in names[:4]] + [pa.int64()] * 3 + [pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        schema = None
        for batch in batches:
            schema, values = batch.schema, batch["line"].to_pylist()
            block = batch["block"].to_numpy(zero_copy_only=False)
            paths = batch["path"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((block[1:] != block[:-1]) | (paths[1:] != paths[:-1])) + 1
            for low, high in pairwise([0, *changes.tolist(), len(values)]):
                if low == high:
                    continue
                own = tuple(batch[n][low].as_py() for n in names[:4])
                if own != key:
                    finish()
                    key, number = own, 0
                    if own[3] == 0:
                        values[low] = values[low].removeprefix(mark)
                for value in values[low:high]:
                    lines.append(value)
                    length += len(value) + 1
                    if length >= size:
                        finish()
            if made:
                yield written(schema)
        finish()
        if made:
            yield written(schema)

    return run


def read_lines(spark: SparkSession, paths: str | list[str], ends: str | None = None, run_bytes: int | None = None) -> DataFrame:
    """(path, modified, block, line_no, line): every line with its number in its file, from 0. A line ends at a line
    feed, a carriage return or both, or at ``ends`` only. An empty file has no lines. Written once, as the order within
    a block is the scan's.

    With ``run_bytes``, (path, modified, size, block, run, lines, bytes, text): the lines in runs of about that size, which
    no block's end crosses, numbered from 0 in each block; the file's size, how many lines, how many bytes without their
    ends, and the lines joined by ``ends``, as bytes.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    scan = (reader.option("lineSep", ends) if ends else reader).text(paths)
    path = F.col("_metadata.file_path").alias("path")
    modified = F.col("_metadata.file_modification_time").alias("modified")
    block = F.col("_metadata.file_block_start").alias("block")
    if run_bytes:
        size = F.col("_metadata.file_size").alias("size")
        found = scan.select(path, modified, size, block, F.col("value").cast("binary").alias("line"))
        schema = "path string, modified timestamp, size long, block long, run long, lines long, bytes long, text binary"
        return write_through(found.mapInArrow(_together(ends.encode(), run_bytes), schema), "runs")
    scanned = scan.select(path, modified, block, F.monotonically_increasing_id().alias("_order"), F.col("value").alias("line"))
    lines = write_through(scanned, "lines")
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("_size"), F.min("_order").alias("_first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    # the scan numbers a block's lines one after the other
    numbered = lines.join(blocks.select("path", "block", "_first", "_before"), ["path", "block"])
    line_no = F.col("_before") + F.col("_order") - F.col("_first")
    bare = F.when(line_no == 0, F.regexp_replace("line", f"^{BYTE_ORDER_MARK}", "")).otherwise(F.col("line"))
    return numbered.select("path", "modified", "block", line_no.alias("line_no"), bare.alias("line"))


def with_next(lines: DataFrame, count: int) -> DataFrame:
    """``lines`` with the columns ``next_1`` … ``next_{count}``, NULL beyond the end of the file.

    A block's own lines meet in one task; of later blocks it gets the first ``count`` lines it is short of.
    """
    ends = lines.groupBy("path", "block").agg(F.min("line_no").alias("_from"), (F.max("line_no") + 1).alias("_end"))
    heads = lines.join(ends.select("path", "block", "_from"), ["path", "block"]).where(F.col("line_no") < F.col("_from") + count)
    wanted = heads.select("path", "modified", "line_no", "line", F.explode(F.sequence(F.col("line_no") - count + 1, "line_no")).alias("_end"))
    lent = wanted.join(ends.select("path", "block", "_end"), ["path", "_end"]).select(*lines.columns, F.lit(True).alias("_lent"))
    within = Window.partitionBy("path", "block").orderBy("line_no")
    both = lines.withColumn("_lent", F.lit(False)).unionByName(lent)
    ahead = both.withColumns({f"next_{i}": F.lead("line", i).over(within) for i in range(1, count + 1)})
    return ahead.where(~F.col("_lent")).drop("_lent")


def alternate(rows: DataFrame, step: int) -> DataFrame:
    """Of rows that stand ``step`` lines apart, every other one: the first of each chain, the third, and so on.

    ``rows`` has path, block and line_no. Chains are counted within their block first; only the pieces that touch an
    edge of their block, two a block and residue, are then strung together over the file.
    """
    residue = F.col("line_no") % step
    in_block = Window.partitionBy("path", "block", "_residue").orderBy("line_no")
    chained = rows.withColumn("_residue", residue)
    # constant along a chain, different for the next one
    chained = chained.withColumn("_chain", F.floor(F.col("line_no") / step) - F.row_number().over(in_block))
    piece = ["path", "block", "_residue", "_chain"]
    chained = chained.withColumn("_nth", F.row_number().over(Window.partitionBy(*piece).orderBy("line_no")) - 1)
    chained = write_through(chained, "chains")
    pieces = chained.groupBy(*piece).agg(F.min("line_no").alias("_low"), F.max("line_no").alias("_high"), F.count("*").alias("_size"))
    bounds = pieces.groupBy("path", "block", "_residue").agg(F.min("_low").alias("_lowest"), F.max("_high").alias("_highest"))
    outer = pieces.join(bounds, ["path", "block", "_residue"]).where((F.col("_low") == F.col("_lowest")) | (F.col("_high") == F.col("_highest")))
    along = Window.partitionBy("path", "_residue").orderBy("_low")
    starts = F.when(F.col("_low") - step == F.lag("_high").over(along), 0).otherwise(1)
    strung = outer.withColumn("_starts", starts).withColumn("_string", F.sum("_starts").over(along))
    earlier = Window.partitionBy("path", "_residue", "_string").orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    shifts = strung.select(*piece, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift")).where("_shift % 2 = 1")
    moved = chained.join(shifts, piece, "left")
    taken = (F.col("_nth") + F.coalesce("_shift", F.lit(0))) % 2 == 0
    return moved.where(taken).select(*rows.columns)


def states(lines: DataFrame, of_outside: str, of_inside: str) -> DataFrame:
    """``lines`` with ``inside_before`` and ``inside_after`` (0 or 1), the state of a two-state automaton around each line.

    The columns ``of_outside`` and ``of_inside`` say where a line leads from either state. Such a function is constant,
    leaves the state alone or swaps it, so the state is the last constant plus the swaps since, modulo two. Blocks are
    composed the same way: only one function a block meets those of its file's other blocks.
    """
    swaps = (F.col(of_outside) == 1) & (F.col(of_inside) == 0)
    constant = F.col(of_outside) == F.col(of_inside)
    within = Window.partitionBy("path", "block").orderBy("line_no")
    sofar = within.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_swaps", F.sum(F.when(swaps, 1).otherwise(0)).over(sofar))
    lines = lines.withColumn("_anchor", F.last(F.when(constant, F.col(of_outside) + F.col("_swaps")), ignorenulls=True).over(sofar))
    blocks = lines.groupBy("path", "block").agg(F.max_by(F.struct("_swaps", "_anchor"), "line_no").alias("_all"))
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_total", F.sum("_all._swaps").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    anchored = F.when(F.col("_all._anchor").isNotNull(), F.col("_all._anchor") + F.col("_all._swaps") + F.col("_total"))
    blocks = blocks.withColumn("_block_anchor", anchored)
    before = F.coalesce(F.last("_block_anchor", ignorenulls=True).over(upto), F.lit(0)) + F.coalesce(F.sum("_all._swaps").over(upto), F.lit(0))
    blocks = blocks.select("path", "block", (before % 2).cast("int").alias("_enters"))
    lines = lines.join(blocks, ["path", "block"])
    after = ((F.coalesce("_anchor", "_enters") + F.col("_swaps")) % 2).cast("int")
    lines = lines.withColumn("inside_after", after)
    lines = lines.withColumn("inside_before", F.coalesce(F.lag("inside_after").over(within), F.col("_enters")))
    return lines.drop("_swaps", "_anchor", "_enters")


def running_sum(lines: DataFrame, column: str, into: str) -> DataFrame:
    """``lines`` with ``into``, the sum of ``column`` over the lines of the file before each line, summed per block first."""
    within = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.sum(column).alias("_sum"))
    blocks = blocks.select("path", "block", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_earlier"))
    summed = lines.withColumn(into, F.coalesce(F.sum(column).over(within), F.lit(0)))
    return summed.join(blocks, ["path", "block"]).withColumn(into, F.col(into) + F.col("_earlier")).drop("_earlier")


def chunks(lines: DataFrame, starts: str, joiner: str = "\n", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, line_no, text): lines joined from each one that ``starts`` a chunk up to the next such line of the file.

    Only chunks of several lines are gathered; ``alone`` says which lines are chunks by themselves. ``keep``: columns that
    are the same in all lines of a file, to be kept.
    """
    within = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_chunk", F.last(F.when(F.col(starts), F.col("line_no")), ignorenulls=True).over(within))
    lasts = marked.groupBy("path", "block").agg(F.max("_chunk").alias("_last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("path", "block", F.coalesce(F.max("_last").over(earlier), F.lit(0)).alias("_open"))
    marked = marked.join(lasts, ["path", "block"]).withColumn("_chunk", F.coalesce("_chunk", "_open"))
    alone = marked.where("alone").select("path", *keep, "line_no", F.col("line").alias("text"))
    parts = marked.where("NOT alone").groupBy("path", *keep, "_chunk").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_parts"))
    joined = parts.select("path", *keep, F.col("_chunk").alias("line_no"), F.array_join(F.col("_parts.line"), joiner).alias("text"))
    return alone.unionByName(joined)
