"""Framing against a plain sequential scan, on random lines."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitlake import schemas
from orbitlake.functions import tle as T
from orbitlake.sources import lines as lines_of
from orbitlake.sources import tle

L1 = "1 {id}U 98067A   {yy}{day}  .00000023  00000-0"
L2 = "2 {id}  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157    1"


def line1(catalogue_id="25544", yy="24", day="001.50000000"):
    return L1.format(id=catalogue_id, yy=yy, day=day)


def line2(catalogue_id="25544"):
    return L2.format(id=catalogue_id)


def scan(lines, shortest):
    """The sequential reading: skip one line on a mismatch, three on a record."""
    found, i = [], 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        if i + 2 >= len(lines):
            break
        a, b = lines[i + 1].rstrip(), lines[i + 2].rstrip()
        if len(a) >= 32 and len(b) >= shortest and a[:2] == "1 " and b[:2] == "2 " and a[2:7] == b[2:7]:
            found.append((lines[i].strip(), a, b))
            i += 3
        else:
            i += 1
    return found


PIECES = ["", "   ", "NAME", " NAME B ", line1(), line2(), line1("00007"), line2("00007"), line1()[:20], line2()[:7], line2()[:30], "1 x", "2 25544  "]


def framed(spark, texts, pattern):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r.i: [tuple(x.split("\n")) for x in r.r] for r in df.select("i", T.records(F.col("t"), pattern).alias("r")).collect()}


def stripped(records):
    return [(n.strip(), a.rstrip(), b.rstrip()) for n, a, b in records]


def test_framing_equals_sequential_scan(spark):
    chance = random.Random(7)
    files = [[chance.choice(PIECES) for _ in range(chance.randrange(0, 14))] for _ in range(3000)]
    # long chains of overlapping candidates
    files += [["N"] + [line1(), line2()] * k for k in range(1, 9)]
    ends = ["\n", "\r\n"]
    texts = [ends[i % 2].join(f) + (ends[i % 2] if i % 3 else "") for i, f in enumerate(files)]
    for pattern, shortest in ((T.FULL_RECORD, 63), (T.CATALOGUE_RECORD, 7)):
        got = framed(spark, texts, pattern)
        for i, lines in enumerate(files):
            assert stripped(got[i]) == scan(lines, shortest), (i, lines)


@settings(max_examples=25, deadline=None)
@given(lines=st.lists(st.sampled_from(PIECES), max_size=30))
def test_framing_property(spark, lines):
    got = framed(spark, ["\n".join(lines)], T.FULL_RECORD)[0]
    assert stripped(got) == scan(lines, 63)


def snapshots(spark, text):
    row = ("f", text, "tle-a", "u", "tle", dt.datetime(2024, 1, 2))
    return spark.createDataFrame([row], schemas.RAW_SNAPSHOT)


def test_fields_and_epoch_centuries(spark):
    text = "\r\n".join(["ISS (ZARYA) ", line1(yy="56", day="366.25000000"), line2(), "OLD", line1("00005", "57"), line2("00005")])
    good, bad = tle.parse_tle(snapshots(spark, text))
    new, old = good.orderBy(F.desc("epoch")).collect()
    assert (new.object_name, new.norad_id, new.classification, new.international_designator) == ("ISS (ZARYA)", 25544, "U", "98067A")
    assert (new.epoch, old.epoch) == (dt.datetime(2056, 12, 31, 6), dt.datetime(1957, 1, 1, 12))
    assert (new.inclination_deg, new.eccentricity, new.mean_motion) == (34.2682, 0.1859667, 10.82419157)
    assert bad.count() == 0


def test_malformed_numbers_are_rejected(spark):
    text = "\n".join(["A", line1(yy="xx"), line2(), "B", line1(), line2()])
    good, bad = tle.parse_tle(snapshots(spark, text))
    assert [r.object_name for r in good.collect()] == ["B"]
    assert [r.reason for r in bad.collect()] == ["malformed number"]


def test_catalogue_parts(spark):
    good, _ = tle.parse_tle_catalogue(snapshots(spark, "\n".join(["A", line1(), "2 25544"])))
    row = good.first()
    assert (row.designator_year, row.designator_launch_number, row.designator_piece, row.epoch_day) == (98, 67, "A", 1.5)


def test_stage_columns(spark):
    good, _ = tle.parse_tle(snapshots(spark, "\n".join(["A", line1(), line2()])))
    stage = tle.tle_stage(good)
    assert stage.columns == schemas.STG_TLE.names
    assert stage.first().DOWNLOADED_AT_UTC == "2024-01-02T00:00:00.0000000Z"


def framed_files(spark, folder, pattern):
    rows = tle.framed_lines(spark, str(folder), pattern).select("path", "record_no", "name", "line1", "line2").collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.path, r.record_no)):
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.name, r.line1, r.line2))
    return found


@pytest.fixture
def small_blocks(spark, monkeypatch):
    """Text scans in blocks of a given number of bytes; the tables written after that are read as ever."""
    own = lines_of.read_lines

    def cut(size):
        def read_lines(session, paths):
            session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            session.conf.set("spark.sql.files.openCostInBytes", "0")
            try:
                return own(session, paths)
            finally:
                session.conf.unset("spark.sql.files.maxPartitionBytes")
                session.conf.unset("spark.sql.files.openCostInBytes")

        monkeypatch.setattr(lines_of, "read_lines", read_lines)

    return cut


@pytest.mark.parametrize("block", [150, 900])
def test_framing_in_splits_equals_sequential_scan(spark, tmp_path, small_blocks, block):
    """Blocks of two lines and of some fifteen; chains of overlapping records that run over many blocks."""
    chance = random.Random(block)
    files = {f"r{i}.txt": [chance.choice(PIECES) for _ in range(chance.randrange(0, 60))] for i in range(6)}
    files["chains.txt"] = [x for k in (1, 2, 7, 20) for x in ["N", *[line1(), line2()] * k, "", "M"]]
    files["odd.txt"] = ["N"] + [line1(), line2()] * 9 + [line1("00007"), line2("00007")] * 9
    files["empty.txt"] = []
    for i, (name, lines) in enumerate(files.items()):
        (tmp_path / name).write_bytes(("\r\n", "\n", "\r")[i % 3].join(lines).encode())
    (tmp_path / "marked.txt").write_text("\ufeffISS\n" + line1() + "\n" + line2())
    files["marked.txt"] = ["ISS", line1(), line2()]
    small_blocks(block)
    pattern, shortest = ((T.FULL_RECORD, 63), (T.CATALOGUE_RECORD, 7))[block == 900]
    got = framed_files(spark, tmp_path, pattern)
    for name, lines in files.items():
        assert got.get(name, []) == scan(lines, shortest), name


def test_lines_are_numbered_over_blocks(spark, tmp_path, small_blocks):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(500)))
    small_blocks(100)
    rows = lines_of.with_next(lines_of.read_lines(spark, str(tmp_path)), 2).collect()
    assert len({r.block for r in rows}) > 10
    assert sorted((r.line_no, int(r.line)) for r in rows) == [(i, i) for i in range(500)]
    number = lambda x: None if x is None else int(x)
    assert all(number(r.next_1) == (i if (i := r.line_no + 1) < 500 else None) for r in rows)
    assert all(number(r.next_2) == (i if (i := r.line_no + 2) < 500 else None) for r in rows)


def test_elements_of_files(spark, tmp_path):
    text = "\n".join(["A", line1(yy="xx"), line2(), "B", line1(), line2()])
    (tmp_path / "20240102T000000000Z_tle-a.txt").write_text(text)
    good, bad = tle.parse_tle_files(spark, str(tmp_path))
    same, wrong = tle.parse_tle(snapshots(spark, text))
    columns = [c for c in same.columns if c not in ("path", "record_no")]
    assert good.select(columns).collect() == same.select(columns).collect()
    assert bad.select("source_name", "reason", "detail").collect() == wrong.select("source_name", "reason", "detail").collect()
    rows = tle.parse_tle_catalogue_files(spark, str(tmp_path))[0].collect()
    assert [r.satellite_name for r in rows] == ["B"]
