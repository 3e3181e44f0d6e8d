"""JSON files in splits: a file that is one large array becomes many small arrays, in many tasks.

Files are cut at closing braces, wherever blocks end, and a block's pieces gathered in runs of bounded size. Whether a
run begins within a string is a two-state automaton over the runs, how deep it lies a running sum of brackets outside
strings; both are composed per block, then over the blocks of a file, from a row of counts a run. A brace that closes at the depth of the array's own elements ends a chunk, and the chunk in brackets
of its own is a document for the whole-file readers. A file is broken exactly if one of its chunks is.

Strings in single quotes, which the readers tolerate, may hold no brackets and no double quotes here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake import schemas
from orbitlake.session import ship_package
from orbitlake.sources import gp_json, landing, launches
from orbitlake.sources import lines as L
from orbitlake.sources.rows import split
from orbitlake.workspace import write_through

CLOSE = "}"
BROKEN = b"["  # no document: what a chunk becomes that no comma parts from the one before
OPENS = re.compile(rb"\s*([\[{])")
END, COMMA = re.compile(rb"[ \t\r\n]*\]"), re.compile(rb"[ \t\r\n]*,(?!\s*\])")
RUN_BYTES = 1 << 14  # of pieces that are scanned together
SUMMARY = ["begins", "odd", "change_0", "low_0", "change_1", "low_1"]
STEP = np.zeros(256, np.int8)  # what a byte adds to the depth
STEP[[ord("["), ord("{")]], STEP[[ord("]"), ord("}")]] = 1, -1
MARK_BYTES = 3  # of a byte-order mark, which the scan leaves out


def _marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte, whether it is a quote and what it adds to the depth; escaped ones count for nothing. No escape
    reaches over a closing brace, as pieces end there."""
    quotes, step = text == ord('"'), STEP[text]
    slashes = np.flatnonzero(text == ord("\\"))
    if len(slashes):
        ends = np.flatnonzero(np.diff(slashes, append=len(text) + 1) != 1)
        odd = np.diff(ends, prepend=-1) % 2 == 1
        escaped = slashes[ends[odd]] + 1
        escaped = escaped[escaped < len(text)]
        escaped = escaped[text[escaped] != ord(CLOSE)]
        quotes[escaped], step[escaped] = False, 0
    return quotes, step


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run: the bracket it begins with, the parity of its quotes, and per state before it what its brackets add to
    the depth and the least sum on the way, all without its last brace."""
    for batch in batches:
        rows = []
        for content in batch["text"].to_pylist():
            quotes, step = _marks(np.frombuffer(content, np.uint8))
            inside = np.cumsum(quotes) % 2
            begins = OPENS.match(content)
            row = {"begins": begins[1].decode() if begins else "", "odd": int(inside[-1]) if len(inside) else 0}
            for state in (0, 1):
                sums = np.cumsum(step[(step != 0) & (inside == state)], dtype=np.int64)
                row[f"change_{state}"] = int(sums[-1]) if len(sums) else 0
                row[f"low_{state}"] = int(sums.min()) if len(sums) else None
            rows.append(row)
        columns = {n: batch[n] for n in ("path", "size", "block", "run", "lines", "bytes")}
        told = [pa.array([r[n] for r in rows], pa.string() if n == "begins" else pa.int64()) for n in SUMMARY]
        yield pa.RecordBatch.from_arrays([*columns.values(), *told], [*columns, *SUMMARY])


def _cut(content: bytes, inside: int, depth: int, first: bool, closed: bool, last: bool, ending: bool) -> tuple[list[bytes], bytes | None, bytes | None]:
    """A run of an array's pieces as chunks: those that lie in it, what ends a chunk begun before, and what begins one
    that goes on. ``ending``: the array closes in it."""
    content += CLOSE.encode() * closed
    text = np.frombuffer(content, np.uint8)
    quotes, step = _marks(text)
    state = (np.cumsum(quotes) + inside) % 2
    step[state == 1] = 0
    depths = depth + np.cumsum(step, dtype=np.int64)
    braces = np.flatnonzero(text == ord(CLOSE))
    if ending:
        piece = np.searchsorted(braces, np.flatnonzero((step != 0) & (depths <= 0))[0])
        braces = braces[: piece + 1]
        content = content[: braces[-1] + 1] if piece < len(braces) else content
    # an element ends at a brace that leaves the depth of the array's own elements
    element = (depths[braces] == 1) & (state[braces] == 0)
    starts = braces[element] + 1
    ended = bool(len(starts)) and int(starts[-1]) == len(content) and not ending
    starts = starts[starts < len(content)].tolist()
    begins = first or (depth == 1 and inside == 0)
    bounds = [0, *starts, len(content)]
    whole: list[bytes] = []
    head = tail = None
    for i, (low, high) in enumerate(pairwise(bounds)):
        part, opens, more = content[low:high], i > 0 or begins, high < len(content)
        if opens and not (first and i == 0):
            comma = COMMA.match(part)
            if END.match(part):
                part = b"[" + part
            elif comma:
                part = b"[" + part[comma.end() :]
            else:
                brace = part.find(CLOSE.encode())
                part = BROKEN + (part[brace:] if brace >= 0 else b"")
        if more or (ended and not last):
            part += b"]"
        if not opens:
            head = part
        elif more or ended or ending or last:
            whole.append(part)
        else:
            tail = part
    return whole, head, tail


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[tuple] = []
        states = [batch[n].to_pylist() for n in ("text", "opens", "inside_before", "depth", "first", "closed", "last", "ending", "all")]
        for content, opens, inside, depth, first, closed, last, ending, wanted in zip(*states):
            if opens == "[":
                made.append(_cut(content, inside, depth, first, closed, last, ending))
                continue
            braced = content + CLOSE.encode() * closed
            if not wanted:  # the first piece alone
                made.append(([braced[: braced.find(CLOSE.encode()) + 1] or braced], None, None))
                continue
            if ending:
                quotes, step = _marks(np.frombuffer(braced, np.uint8))
                step[(np.cumsum(quotes) + inside) % 2 == 1] = 0
                closing = np.flatnonzero((step != 0) & (depth + np.cumsum(step, dtype=np.int64) <= 0))[0]
                braced = braced[: braced.find(CLOSE.encode(), closing) + 1] or braced
            done = ending or last
            made.append(([braced], None, None) if first and done else ([], None, braced) if first else ([], braced, None))
        whole, head, tail = zip(*made) if made else ([], [], [])
        columns = [*(batch[n] for n in ("path", "modified", "block", "nth")), pa.array(whole, pa.list_(pa.binary())), pa.array(head, pa.binary()), pa.array(tail, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["path", "modified", "block", "nth", "whole", "head", "tail"])


def _states(runs: DataFrame) -> DataFrame:
    """Per run of ``runs``, without its text: the state and depth it begins in, its number in the file, the bracket the
    file begins with (``opens``), whether it is the file's first or last, whether a brace ends it (``closed``), and
    whether the file's root closes in it (``ending``); none of the runs after that."""
    schema = "path string, size long, block long, run long, lines long, bytes long, begins string, odd long, change_0 long, low_0 long, change_1 long, low_1 long"
    summed = runs.select("path", "size", "block", "run", "lines", "bytes", "text").mapInArrow(_summed, schema)
    summed = write_through(summed.withColumnRenamed("run", "line_no"), "json-runs")
    place = F.struct("block", "line_no")
    facts = summed.groupBy("path").agg(
        F.min_by("begins", place).alias("opens"), F.min(place).alias("_from"), F.max(place).alias("_to"),
        F.sum("bytes").alias("_bytes"), F.sum("lines").alias("_pieces"), F.max("size").alias("_size"),
    )
    beyond = F.col("_size") - F.col("_bytes") - F.col("_pieces")
    facts = facts.withColumn("_ends_closed", beyond.isin(0, MARK_BYTES))
    known = summed.join(facts.select("path", "opens", "_from", "_to", "_ends_closed"), "path")
    known = known.withColumns({"first": place == F.col("_from"), "last": place == F.col("_to")})
    known = known.withColumns({"closed": ~F.col("last") | F.col("_ends_closed"), "_outside": F.col("odd"), "_inside": 1 - F.col("odd"), "_one": F.lit(1)})
    stated = L.states(known, "_outside", "_inside")
    told = lambda name: F.when(F.col("inside_before") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))
    brace = F.col("closed") & (F.col("inside_after") == 0)
    stated = stated.withColumn("_change", told("change") - F.when(brace, 1).otherwise(0))
    stated = stated.withColumn("low", F.least(told("low"), F.when(brace, F.col("_change"))))
    summed = L.running_sum(L.running_sum(stated, "_change", "depth"), "_one", "nth")
    summed = write_through(summed.withColumn("_low", F.col("depth") + F.col("low")), "json-states")
    ends = summed.where("_low <= 0").groupBy("path").agg(F.min("nth").alias("_end"))
    kept = summed.join(ends, "path", "left").where("_end is null or nth <= _end")
    kept = kept.withColumn("ending", F.coalesce(F.col("nth") == F.col("_end"), F.lit(False)))
    return kept.select("path", "block", F.col("line_no").alias("run"), "nth", "opens", "inside_before", "depth", "first", "closed", "last", "ending")


def read_json_chunks(spark: SparkSession, paths: str | list[str], objects: bool) -> DataFrame:
    """Snapshots (path, source_name, downloaded_at, content) of JSON files: of an array as many as it has objects, each an
    array of its own; of an object one with all of it if ``objects`` is set. Of other files there is only the beginning,
    up to the first closing brace. Spark's scans skip files of no bytes. What follows the array is left out, as the
    readers do.
    """
    ship_package(spark)
    runs = L.read_lines(spark, paths, CLOSE, RUN_BYTES)
    whole = (F.col("opens") == "{") & F.lit(objects)
    states = _states(runs).where((F.col("opens") == "[") | F.col("first") | whole).withColumn("all", whole)
    # only here do texts travel, to their states; of the cut runs only what goes on in another one. A row a run with the
    # file's path is small on disk, where paths repeat, and many times that in a broadcast, hence the merge
    places = write_through(states, "json-places").hint("merge")
    placed = runs.select("path", "modified", "block", "run", "text").join(places, ["path", "block", "run"])
    schema = "path string, modified timestamp, block long, nth long, whole array<binary>, head binary, tail binary"
    cut = write_through(placed.mapInArrow(_chunked, schema), "json-cut")
    alone = cut.select("path", "modified", F.explode("whole").alias("text"))
    ends = F.array(
        F.struct((2 * F.col("nth")).alias("line_no"), F.col("head").alias("line"), F.lit(False).alias("starts")),
        F.struct((2 * F.col("nth") + 1).alias("line_no"), F.col("tail").alias("line"), F.lit(True).alias("starts")),
    )
    open_ends = cut.where("head is not null or tail is not null").select("path", "modified", "block", F.inline(ends)).where("line is not null")
    texts = open_ends.withColumns({"line": F.col("line").cast("string"), "alone": F.lit(False)})
    joined = L.chunks(write_through(texts, "json-ends"), "starts", joiner="", keep=("modified",))
    chunks = alone.withColumn("text", F.col("text").cast("string")).unionByName(joined.select("path", "modified", "text"))
    return chunks.select(
        "path",
        landing.source_of(F.col("path")).alias("source_name"),
        landing.downloaded_at(F.col("path"), F.col("modified")).alias("downloaded_at"),
        F.col("text").alias("content"),
    )


def _by_file(rows: DataFrame, refused: list[str]) -> DataFrame:
    """``rows`` of chunks as rows of files: a file with a refused chunk is one reject and nothing else. Its ``detail`` is
    NULL, as it may not fit a row; ``path`` says where it is."""
    rows = write_through(rows, "json-rows")
    bad = rows.where(F.col("reason").isin(refused)).groupBy("path", "source_name").agg(F.max("reason").alias("reason"))
    bad = write_through(bad, "json-refused")
    return rows.join(bad, "path", "left_anti").unionByName(bad, allowMissingColumns=True)


def parse_gp_json_files(spark: SparkSession, paths: str | list[str], feeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``gp_json.parse_gp_json`` of JSON files, read in splits: a large array is many tasks."""
    chunks = read_json_chunks(spark, paths, objects=False)
    named = chunks.join(landing.feed_table(spark) if feeds is None else feeds, "source_name", "left")
    rows = gp_json.read_gp_json(named)
    return split(_by_file(rows, ["malformed json", "not json", "not an array"]), schemas.STG_GP)


def parse_launch_files(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``launches.parse_launches`` of JSON files, arrays read in splits; a page (an object) is parsed by one task."""
    rows = launches.read_launches(read_json_chunks(spark, paths, objects=True))
    return split(_by_file(rows, ["malformed json", "no launch array"]), schemas.STG_LAUNCH)
