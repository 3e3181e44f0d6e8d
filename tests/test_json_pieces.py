"""JSON files read in splits against the whole-file readers, over blocks of a few bytes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orbitlake.session import configure
from orbitlake.sources import gp_json, json_pieces, landing, launches
from orbitlake.sources import lines as lines_of
from orbitlake.workspace import write_through


@pytest.fixture
def small_blocks(spark, monkeypatch):
    own = lines_of.read_lines

    def cut(size):
        def read_lines(*args):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            try:
                return own(*args)
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")

        monkeypatch.setattr(lines_of, "read_lines", read_lines)

    return cut


NAMES = ["ISS", "A}B", "{[", 'say "x}"', "back\\", "\\\"}", "O'Neil", "", "Ünï }", "a\nb"]


def element(draw):
    made = {"OBJECT_NAME": draw.choice(NAMES), "NORAD_CAT_ID": draw.randrange(99), "EPOCH": "2024-01-01T12:00:00", "INCLINATION": 1.5, "ECCENTRICITY": "0.1", "MEAN_MOTION": 15}
    if draw.random() < 0.3:
        made["more"] = draw.choice([{"a": {"b": [{}, {"c": "]}"}]}}, [[{}]], {}, [], "}"])
    if draw.random() < 0.1:
        del made["EPOCH"]
    return made


def array(draw):
    items = [draw.choice([element(draw), element(draw), element(draw), None]) for _ in range(draw.randrange(0, 12))]
    return json.dumps(items, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1]))


A = '{"OBJECT_NAME":"a","NORAD_CAT_ID":1,"EPOCH":"2024-01-01T00:00:00","INCLINATION":1,"ECCENTRICITY":0,"MEAN_MOTION":1}'
ODD = [
    "", " \n", "[]", "[ ] ", "[{}]", "{}", '{"a":[{}]}', "text", "}", "[", "]", "[{", f"[{A}", f"[{A},", f"[{A},]", f"[{A}{A}]", f"[{A},,{A}]", f"[,{A}]", f"[{A},{A}",
    f"[{A}] more", f"[{A}][{A}]", f"[{A}]}}", f"[{A}]{A}", f"[1,{A}]", f"[{A},1]", f"[{A},[{A}]]", f"[[{A}],{A}]", f"[{A},null]", f"[null,{A}]", f'[{A},"}}"]', f"[{A}}}]",
    f"[{A},{A[:-1]}]", f"[{A},{A[:-9]}", f'[{A},{{"OBJECT_NAME":"x}}]', f'[{A},{{"OBJECT_NAME"}}]', f"﻿[{A},{A}]", f"﻿[{A},{A}", f"[{A}\n,\t{A}\r\n]\n", f"[{A}]\n[", '["}"]', "[{}}]", "[{]}",
    f'[{A},{{"a":"\\}}"}}]', f"[{A}; {A}]",
]


def cases(seed):
    """Whole arrays, and arrays with a character taken out, doubled or cut off."""
    draw = random.Random(seed)
    texts = [array(draw) for _ in range(15)]
    for _ in range(25):
        text = array(draw)
        at = draw.randrange(len(text))
        texts.append(draw.choice([text[:at], text[:at] + text[at + 1 :], text[:at] + draw.choice('{}[],"\\') + text[at:]]))
    return ODD + texts


def landed(folder, texts):
    for i, text in enumerate(texts):
        (folder / f"20240102T000000000Z_celestrak-f{i}.json").write_bytes(text.encode())
    return str(folder)


def told(frames, *columns):
    good, bad = frames
    refused = F.when(~F.col("reason").isin("missing required field", "not an object"), None).otherwise(F.col("detail"))
    reasons = bad.select("source_name", "reason", refused.alias("detail"))
    return [sorted(map(repr, good.select(*columns).collect())), sorted(map(repr, reasons.collect()))]


@pytest.mark.parametrize("block", [40, 300, 10_000])
def test_element_sets_equal_whole_file_reading(spark, tmp_path, small_blocks, block):
    folder = landed(tmp_path, cases(block))
    whole = landing.read_snapshots(spark, folder).withColumn("content", F.col("content").cast("string"))
    expected = told(gp_json.parse_gp_json(whole), "*")
    small_blocks(block)
    assert told(json_pieces.parse_gp_json_files(spark, folder), "*") == expected
    assert len(expected[0]) > 80 and len(expected[1]) > 40


def launch(draw):
    made = {"id": str(draw.randrange(10**6)), "name": draw.choice(NAMES), "net": "2024-01-01T00:00:00Z", "pad": {"location": {"country_code": "FRA"}}}
    made["rocket"] = {"configuration": {"name": "R{1}"}, "spacecraft_stage": {"payloads": [{}] * draw.randrange(3)}}
    return made


def test_launches_equal_whole_file_reading(spark, tmp_path, small_blocks):
    draw = random.Random(3)
    lists = [[launch(draw) for _ in range(n)] for n in (0, 1, 5, 30)]
    texts = [json.dumps(x) for x in lists] + [json.dumps({"count": 2, "next": None, "results": x}, indent=2) for x in lists]
    texts += [text[:-1] for text in texts] + ["", "[null, 5]", "[5]", "{}", '{"results": 5}', '{"results": null}', "none"]
    folder = landed(tmp_path, texts)
    whole = landing.read_snapshots(spark, folder).withColumn("content", F.col("content").cast("string"))
    expected = told(launches.parse_launches(whole), "*")
    small_blocks(100)
    assert told(json_pieces.parse_launch_files(spark, folder), "*") == expected
    assert len(expected[0]) == 72


def test_a_large_array_is_many_tasks(spark, tmp_path, small_blocks):
    """One file without line ends: every block yields elements, and none is lost."""
    items = [A.replace('"a"', f'"n{i}"') for i in range(2000)]
    folder = landed(tmp_path, [f"[{','.join(items)}]"])
    small_blocks(20_000)
    pieces = lines_of.read_lines(spark, folder, json_pieces.CLOSE)
    assert pieces.select("block").distinct().count() > 8
    good, bad = json_pieces.parse_gp_json_files(spark, folder)
    assert sorted(r.object_name for r in good.collect()) == sorted(f"n{i}" for i in range(2000)) and bad.count() == 0


def test_nothing_to_read(spark, tmp_path):
    """Spark's scans skip files of no bytes, here as for whole files."""
    (tmp_path / "empty.json").write_text("")
    good, bad = json_pieces.parse_gp_json_files(spark, str(tmp_path))
    assert good.count() == 0 and bad.count() == 0


@pytest.mark.parametrize("size", [1, 60, 700])
def test_runs_of_pieces_equal_whole_file_reading(spark, tmp_path, small_blocks, monkeypatch, size):
    """Runs that end within elements, strings and escapes, several to a block."""
    folder = landed(tmp_path, cases(size))
    whole = landing.read_snapshots(spark, folder).withColumn("content", F.col("content").cast("string"))
    expected = told(gp_json.parse_gp_json(whole), "*")
    monkeypatch.setattr(json_pieces, "RUN_BYTES", size)
    small_blocks(1000)
    assert told(json_pieces.parse_gp_json_files(spark, folder), "*") == expected


def test_pieces_of_a_block_travel_together(spark, tmp_path):
    """What is shuffled per file is rows of runs, not of pieces."""
    items = [A.replace('"a"', f'"n{i}"') for i in range(2000)]
    folder = landed(tmp_path, [f"[{','.join(items)}]"])
    runs = lines_of.read_lines(spark, folder, json_pieces.CLOSE, json_pieces.RUN_BYTES).collect()
    assert sum(r.lines for r in runs) == 2001 and len(runs) <= sum(r.bytes for r in runs) / json_pieces.RUN_BYTES + 2
    told_bytes = [r.bytes + r.lines - 1 for r in sorted(runs, key=lambda r: (r.block, r.run))]
    assert told_bytes == [len(r.text) for r in sorted(runs, key=lambda r: (r.block, r.run))]


def test_small_files_share_tasks(spark, tmp_path):
    """What the driver keeps a task, and a file that a task writes, must not follow the number of landed files."""
    configure(spark)
    folder = landed(tmp_path, [f"[{A}]"] * 120)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        runs = lines_of.read_lines(spark, folder, json_pieces.CLOSE, json_pieces.RUN_BYTES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(runs.inputFiles()) <= 8 and {(r.size, r.n) for r in runs.groupBy("size").agg(F.count("*").alias("n")).collect()} == {(len(A) + 2, 120)}


def test_places_of_runs_are_not_broadcast(spark, tmp_path, monkeypatch):
    """They are small on disk, where the paths of files repeat, but a row a run."""
    plans = {}

    def written(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write_through(df, label)

    monkeypatch.setattr(json_pieces, "write_through", written)
    good, _ = json_pieces.parse_gp_json_files(spark, landed(tmp_path, [f"[{A}]"] * 3))
    assert good.count() == 3 and "BroadcastHashJoin" not in plans["json-cut"]
