import datetime as dt
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.sources import gp_json, landing, launches, registry, staging_csv
from orbitlake.workload import rawtext

AT = dt.datetime(2024, 1, 2, 3, 4, 5)


def snapshots(spark, *files, kind="gp_json"):
    made = [(f"f{i}", text, "celestrak-active", "https://x.example/?GROUP=active", kind, AT) for i, text in enumerate(files)]
    return spark.createDataFrame(made, schemas.RAW_SNAPSHOT)


GOOD = '{"OBJECT_NAME":"ISS","NORAD_CAT_ID":25544,"EPOCH":"2024-01-01T12:00:00.123456","INCLINATION":51.6,"ECCENTRICITY":0.0005,"MEAN_MOTION":15.5}'


def without(field):
    import json

    item = json.loads(GOOD)
    del item[field]
    return json.dumps(item)


def test_gp_values(spark):
    quoted = GOOD.replace("25544", '" 25544 "').replace("51.6", '"51.6"')
    good, bad = gp_json.parse_gp_json(snapshots(spark, f"[{GOOD}]", f"\n [{quoted}]"))
    assert {tuple(r)[:7] for r in good.collect()} == {
        ("ISS", 25544, dt.datetime(2024, 1, 1, 12, 0, 0, 123456), 51.6, 0.0005, 15.5, "active")
    }
    assert good.count() == 2 and bad.count() == 0
    assert good.schema.names == schemas.STG_GP.names


@pytest.mark.parametrize(
    "item",
    [
        *(without(f) for f in ("OBJECT_NAME", "NORAD_CAT_ID", "EPOCH", "INCLINATION", "ECCENTRICITY", "MEAN_MOTION")),
        GOOD.replace('"ISS"', '"  "'),
        GOOD.replace('"ISS"', "5"),
        GOOD.replace("25544", "25544.0"),
        GOOD.replace('"2024-01-01T12:00:00.123456"', "20240101"),
        GOOD.replace("51.6", '"steep"'),
        "null",
    ],
)
def test_gp_row_is_rejected_alone(spark, item):
    good, bad = gp_json.parse_gp_json(snapshots(spark, f"[{GOOD},{item}]"))
    assert good.count() == 1
    assert [r.reason for r in bad.collect()] == ["missing required field"]


@pytest.mark.parametrize(
    "text,reason",
    [
        (GOOD, "not an array"),
        ("<html><body>[]</body></html>", "not json"),
        ("", "not json"),
        (f"[{GOOD},", "malformed json"),
        (f"[{GOOD}, 7]", "malformed json"),
    ],
)
def test_gp_file_is_rejected(spark, text, reason):
    good, bad = gp_json.parse_gp_json(snapshots(spark, text, f"[{GOOD}]"))
    assert good.count() == 1
    assert [(r.path, r.reason) for r in bad.collect()] == [("f0", reason)]


def test_gp_empty_array_is_nothing(spark):
    good, bad = gp_json.parse_gp_json(snapshots(spark, "[]", " [ ] "))
    assert good.count() == 0 and bad.count() == 0


LAUNCH = """{"id":"abc","name":"Demo","net":"2024-01-01T00:00:00Z","launch_service_provider":{"name":"P"},
"rocket":{"configuration":{"full_name":"R Full","name":"R"},"spacecraft_stage":{"payloads":[{},{}]}},
"status":{"name":"Launch Successful"},"pad":{"location":{"country_code":"US"},"country_code":"XX"}}"""


def test_launch_fields(spark):
    good, bad = launches.parse_launches(snapshots(spark, f"[{LAUNCH}]", f'{{"count":1,"results":[{LAUNCH}]}}', kind="launches"))
    want = ("abc", "Demo", dt.datetime(2024, 1, 1), "P", "R Full", "US", "Launch Successful", 2, AT)
    assert [tuple(r) for r in good.collect()] == [want, want]
    assert bad.count() == 0


def test_launch_fallbacks(spark):
    text = """[{"id":7,"window_start":"2024-01-01T00:00:00Z","rocket":{"configuration":{"name":"R"},"spacecraft_stage":{"payloads":{}}},
    "pad":{"country_code":"XX"},"net":5},{"id":"b","rocket":"none","rocket.x":1,"status":null},
    {"id":"c","rocket":{"spacecraft_stage":{"payloads":[]}}}]"""
    good, _ = launches.parse_launches(snapshots(spark, text, kind="launches"))
    first, second, third = sorted(good.collect(), key=lambda r: (len(r.launch_id) == 1, r.launch_id))
    assert len(first.launch_id) == 64 and first.launch_id == first.launch_id.upper()
    assert (first.launch_name, first.launch_date, first.rocket_name, first.launch_country) == ("UNKNOWN", dt.datetime(2024, 1, 1), "R", "XX")
    assert first.payload_count is None
    assert (second.rocket_name, second.launch_status, second.launch_date, second.payload_count) == (None, None, None, None)
    assert third.payload_count == 0


@pytest.mark.parametrize("text,reason", [
        ('{"results":5}', "no launch array"),
        ('{"count":1}', "no launch array"),
        ('{"results":[', "malformed json"),
        ("oops", "malformed json"),
        ("[1]", "malformed json"),
        ("[null]", "not an object"),
        ('[{"id":', "malformed json"),
    ])
def test_launch_rejects(spark, text, reason):
    good, bad = launches.parse_launches(snapshots(spark, text, kind="launches"))
    assert good.count() == 0
    assert [r.reason for r in bad.collect()] == [reason]


def registry_of(spark, *texts):
    good, bad = registry.parse_registry(snapshots(spark, *texts, kind="registry"))
    return [r.asDict() for r in good.orderBy("norad_id", "satellite_name").collect()], bad.collect()


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_registry_separators_and_quotes(spark, sep):
    header = sep.join(["Name of Satellite", "NORAD Number", "Operator/Owner", "Users", "Purpose", "Class of Orbit", "Date of Launch"])
    row = sep.join([f' "A ""big"" one{sep} with\r\nline" ', "7", " Op ", "Civil", "", "LEO", "11/13/2019"])
    short = sep.join(["B", "abc"])
    rows, bad = registry_of(spark, "\r\n".join([header, row, "", short, ""]))
    assert not bad
    assert rows[1]["satellite_name"] == f'A "big" one{sep} with\r\nline'
    assert (rows[1]["norad_id"], rows[1]["operator_name"], rows[1]["country"], rows[1]["purpose"]) == (7, "Op", "Civil", None)
    assert (rows[1]["orbit_type"], rows[1]["launch_date"]) == ("LEO", dt.date(2019, 11, 13))
    assert (rows[0]["satellite_name"], rows[0]["norad_id"], rows[0]["operator_name"]) == ("B", None, None)


def test_registry_first_non_blank_of_duplicates_and_aliases(spark):
    text = (
        "Name,name,Satellite-Name,NORAD ID,norad_number,Country,Users\n"
        ",second,alias,5,6,,U\n"
        "first,second,,5,,C,U\n"
        "first,,winner,,9, ,\n"
    )
    rows, _ = registry_of(spark, text)
    by_name = {r["satellite_name"]: r for r in rows}
    # the alias listed first wins over later ones, within an alias the left-most non-blank column
    assert set(by_name) == {"alias", "first", "winner"}
    assert by_name["alias"]["norad_id"] == 6 and by_name["alias"]["country"] == "U"
    assert by_name["first"]["norad_id"] == 5 and by_name["first"]["country"] == "C"
    assert by_name["winner"]["norad_id"] == 9 and by_name["winner"]["country"] is None


def test_registry_gates_and_rejects(spark):
    rows, bad = registry_of(spark, "<!DOCTYPE HTML><p>", " \nName\nx", "PK\x03\x04rest", "﻿Name,Status\n,Active\nA,\n")
    assert [r["satellite_name"] for r in rows] == ["A"]
    assert sorted((r.path, r.reason) for r in bad) == [("f0", "html"), ("f1", "empty"), ("f2", "workbook"), ("f3", "no satellite name")]


def test_registry_quote_that_never_closes_costs_one_field(spark):
    rows, _ = registry_of(spark, 'Name,Status\n"A,Active\nB,Operational\n')
    assert [(r["satellite_name"], r["operational_status"]) for r in rows] == [('"A', "Active"), ("B", "Operational")]


@pytest.mark.parametrize("header,want", [("a\tb;c,d", "\t"), ("a;b,c", ";"), ("a;b,c,d", ","), ("a", "\t")])
def test_separator_ties(spark, header, want):
    df = spark.createDataFrame([(header,)], "v string")
    assert df.select(registry.separator(F.col("v")).alias("s")).first().s == want


def workbook(sheet, strings=None):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
        if strings:
            items = "".join(f"<si>{s}</si>" for s in strings)
            archive.writestr("xl/sharedStrings.xml", f"<sst {ns}>{items}</sst>")
    return packed.getvalue()


def test_workbooks(spark):
    strings = ["<t>Name of </t><r><t>Satellite</t></r>", "<t>Sat A</t>"]
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>NORAD Number</t></is></c>'
        '<c r="D1" t="inlineStr"><is><t>Date of Launch</t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>42</v></c><c r="C2"><v>9</v></c><c r="D2"><v>45000</v></c></row>'
        '<row r="3"></row><row r="4"><c r="B4"><v>43</v></c></row>'
    )
    books = spark.createDataFrame(
        [("b1", "s", AT, workbook(sheet, strings)), ("b2", "s", AT, workbook(""))],
        "path string, source_name string, downloaded_at timestamp, content binary",
    )
    good, bad = registry.parse_workbooks(books)
    assert [(r.norad_id, r.satellite_name, r.launch_date, r.imported_at) for r in good.collect()] == [(42, "Sat A", dt.date(2023, 3, 15), AT)]
    assert [r.reason for r in bad.collect()] == ["no satellite name"]


def test_a_workbook_that_cannot_be_read_is_one_reject(spark):
    row = '<row r="1"><c r="A1" t="inlineStr"><is><t>Name</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Sat</t></is></c></row>'
    whole = workbook(row)
    sheetless = io.BytesIO()
    with zipfile.ZipFile(sheetless, "w") as book:
        book.writestr("xl/workbook.xml", "<workbook/>")
    offered = {"cut": whole[: len(whole) // 2], "broken": workbook(row + "<row"), "sheetless": sheetless.getvalue(), "whole": whole}
    books = spark.createDataFrame(
        [(name, "s", AT, content) for name, content in offered.items()],
        "path string, source_name string, downloaded_at timestamp, content binary",
    )
    good, bad = registry.parse_workbooks(books)
    assert [r.satellite_name for r in good.collect()] == ["Sat"]
    assert sorted((r.path, r.reason) for r in bad.collect()) == [("broken", registry.MALFORMED), ("cut", registry.MALFORMED), ("sheetless", registry.NO_SHEET)]


def test_marks_and_leading_blanks_lose_nothing(spark):
    element = '[{"OBJECT_NAME":"A","NORAD_CAT_ID":1,"EPOCH":"2024-01-01T00:00:00","INCLINATION":1,"ECCENTRICITY":0.1,"MEAN_MOTION":15}]'
    launch = '{"results":[{"id":"L1","name":"N"}]}'
    for lead in ("\ufeff", "\n" * 600, "\ufeff" + " " * 600):
        assert gp_json.parse_gp_json(snapshots(spark, lead + element))[0].count() == 1
        assert launches.parse_launches(snapshots(spark, lead + launch))[0].count() == 1


def test_a_table_whose_header_begins_like_a_container(spark):
    good, bad = registry.parse_registry(snapshots(spark, "PK,Name,NORAD Number\n1,Sat,42\n"))
    assert [(r.satellite_name, r.norad_id) for r in good.collect()] == [("Sat", 42)] and bad.count() == 0


def test_refused_files_are_kept_whole(spark):
    text = "x" * 2000
    assert [r.detail for r in gp_json.parse_gp_json(snapshots(spark, text))[1].collect()] == [text]


def test_latest_snapshot_per_source(spark, tmp_path):
    import os

    made = [("20240101T000000000Z_celestrak-geo.json", "old", 100), ("20240102T000000000Z_celestrak-geo.json", "new", 300), ("20240103T000000000Z_celestrak-geo.json", "", 400), ("20240101T000000000Z_ucs.html", "x", 200), ("unrelated.txt", "y", 500)]
    for name, text, at in made:
        day = tmp_path / name[:8]
        day.mkdir(exist_ok=True)
        (day / name).write_text(text)
        os.utime(day / name, (at, at))
    latest = {r.source_name: r.path.rsplit("/", 1)[1] for r in landing.latest_snapshots(spark, str(tmp_path)).collect()}
    assert latest == {"celestrak-geo": made[1][0], "ucs": made[3][0]}


def test_feeds_attach_to_files(spark, tmp_path):
    (tmp_path / "20240101T010203004Z_celestrak-geo.json").write_text("[]")
    (tmp_path / "20240101T010203004Z_other.json").write_text("[]")
    got = {r.source_name: r for r in landing.read_snapshots(spark, str(tmp_path)).collect()}
    assert got["celestrak-geo"].kind == "gp_json" and "GROUP=geo" in got["celestrak-geo"].source_uri
    assert got["celestrak-geo"].downloaded_at == dt.datetime(2024, 1, 1, 1, 2, 3, 4000)
    assert got["other"].kind is None
    landing.write_archive(landing.read_snapshots(spark, str(tmp_path)), f"{tmp_path}-archive")
    archived = spark.read.parquet(f"{tmp_path}-archive")
    assert archived.count() == 2 and "ingest_date" in archived.columns
    landing.write_archive(landing.read_snapshots(spark, str(tmp_path)), f"{tmp_path}-archive")
    assert spark.read.parquet(f"{tmp_path}-archive").count() == 2


def test_staging_csv_round_trip(spark, tmp_path, rows):
    made = [("b", None, None, None, "P", 'q "x", y', None, 3, AT), ("a", "N", dt.datetime(2024, 1, 1, 0, 0, 0, 5), "L", None, " r ", "S", None, AT)]
    df = spark.createDataFrame([(m[0], m[1], m[2], m[4], m[5], m[3], m[6], m[7], m[8]) for m in made], schemas.STG_LAUNCH)
    path = staging_csv.write_staging(df, str(tmp_path), "stg_launch_events", dt.date(2024, 1, 5))
    assert path.endswith("/2024-01-05/stg_launch_events")
    text = "".join(p.read_text() for p in sorted((tmp_path / "2024-01-05" / "stg_launch_events").glob("*.csv")))
    assert text.splitlines()[0] == ",".join(schemas.STG_LAUNCH.names)
    assert "2024-01-01 00:00:00.000005" in text
    back = staging_csv.read_staging(spark, path, schemas.STG_LAUNCH)
    want = df.withColumn("rocket_name", F.trim("rocket_name"))
    assert rows(back) == rows(want)


def test_staging_csv_bad_value_fails_the_load(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.csv").write_text(",".join(schemas.STG_LAUNCH.names) + "\nid,n,yesterday,p,r,c,s,1,2024-01-01 00:00:00.000000\n")
    with pytest.raises(Exception):  # noqa: B017
        staging_csv.read_staging(spark, str(folder), schemas.STG_LAUNCH).collect()


def test_over_long_values_are_reported(spark):
    df = spark.createDataFrame([("x" * 129, "n"), ("ok", "n")], "launch_id string, launch_name string")
    assert [r.over_long for r in schemas.over_long(df).collect()] == [["launch_id"]]


@pytest.mark.parametrize("block", [90, 4000])
def test_delimited_files_in_splits_equal_whole_files(spark, tmp_path, monkeypatch, block):
    """Random quoting over many line ends, cut into blocks of a few lines; one quote in three files never closes."""
    draw, own = random.Random(block), registry.L.read_lines
    cells = ["A", "b c", '"q"', '"x,y;z"', '"two\nlines"', '"three\r\nof\n them"', '"say ""no"" twice"', ' "lead" tail', 'mid"quote', '""', '""""', "", "1", '"a,\n"",b"']
    texts = {}
    for i in range(9):
        sep, end = draw.choice([",", ";", "\t"]), draw.choice(["\n", "\r\n"])
        rows = [sep.join(draw.choice(cells) for _ in range(3)) for _ in range(draw.randrange(3, 40))]
        if i % 3 == 0:
            rows.insert(draw.randrange(1, len(rows)), f'B{sep}"never closed{sep}C')
        texts[f"20240331T04000{i}000Z_s{i}.csv"] = sep.join(["Name", "NORAD ID", "Status"]) + end + end.join(rows) + draw.choice(["", end])
    texts |= {"page.csv": "<html>\n<p>", "blank.csv": "\nName\nx", "mac.csv": "Name,Status\rA,Active\rB,x", "none.csv": "", "marked.csv": "\ufeffName\nA"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())

    def read_lines(session, paths, ends=None):
        session.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            return own(session, paths, ends)
        finally:
            session.conf.unset("spark.sql.files.maxPartitionBytes")
            session.conf.unset("spark.sql.files.openCostInBytes")

    monkeypatch.setattr(registry.L, "read_lines", read_lines)
    shown = lambda df: sorted((r.path.rsplit("/", 1)[-1], *map(str, r[1:])) for r in df.collect())
    columns = ["path", "source_name", "satellite_name", "norad_id", "operational_status", "reason", "detail"]
    got = shown(registry.read_registry_files(spark, str(tmp_path)).where("reason is null or reason <> ''").select(columns))
    frame = spark.createDataFrame([(n, t) for n, t in texts.items() if t], "path string, content string")
    frame = frame.withColumns({"source_name": landing.source_of(F.col("path")), "downloaded_at": F.lit(AT)})
    want = shown(registry.read_registry(frame).where("reason is null or reason <> ''").select(columns))
    assert [x for x in got if x not in want] == [x for x in want if x not in got] == []
    assert got == want and len(got) > 60


def test_landed_files_share_the_folder_of_their_source(spark, tmp_path):
    """One file a snapshot, whatever its path, and no folder but the sources'."""
    made = [(f"a/{i}", f"text\n{i}", f"source-{i % 2}", None, "k", AT) for i in range(40)] + [("a/0", "again", "source-0", None, "k", AT)]
    files = spark.createDataFrame(made, schemas.RAW_SNAPSHOT)
    rawtext.land(files.coalesce(1), str(tmp_path / "landing"))
    rawtext.land(files.where("path = 'a/1'"), str(tmp_path / "landing"))
    folders = {p.name for p in (tmp_path / "landing").rglob("*") if p.is_dir()}
    found = landing.read_snapshots(spark, str(tmp_path / "landing"))
    texts = [(r.source_name, bytes(r.content).decode()) for r in found.collect()]
    assert folders == {"source_name=source-0", "source_name=source-1"}
    assert sorted(texts) == sorted([(name, f"{text}\n") for _, text, name, *_ in made] + [("source-1", "text\n1\n")])


def test_a_listing_of_many_folders_shares_tasks(spark, tmp_path):
    paths = [tmp_path / f"d{i}" for i in range(100)]
    for path in paths:
        path.mkdir()
        (path / "20240102T000000000Z_celestrak-active.json").write_text("[]")
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        files = spark.read.format("binaryFile").load([str(p) for p in paths])
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert files.count() == 100 and sum(s.numTasks for s in stages) in range(1, 65)


def _files_read(frame) -> int:
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    seen, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan binaryFile"):
            seen += node.metrics().get("numFiles").get().value()
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return seen


def test_a_day_is_picked_from_one_listing(spark, tmp_path):
    """Of the files of the newest days no list goes through the driver, and no others are opened."""
    folder = tmp_path / "landing"
    stamped = ["20240130T040000000Z_celestrak-active.json", "20240131T040000000Z_celestrak-active.json", "20240131T050000000Z_celestrak-active.json"]
    odd = "spacedevs a+b%c é"
    for name in [*stamped, f"source_name={odd}/part 1+%41é.txt", f"source_name={odd}/part 2.txt", "source_name=celestrak-GEO/x"]:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(name)
    rows = [("celestrak-active", K.GP, "a"), ("celestrak-GEO", K.GP, "g"), (odd, K.LAUNCHES, "o")]
    feeds = spark.createDataFrame(rows, "source_name string, kind string, source_uri string")
    day = landing.read_day(spark, str(folder), dt.date(2024, 2, 1), feeds)
    got = {kind: sorted(bytes(r.content).decode() for r in frame.collect()) for kind, frame in day.items()}
    assert got == {
        K.GP: [*stamped[1:], "source_name=celestrak-GEO/x"],
        K.REGISTRY: [],
        K.LAUNCHES: [f"source_name={odd}/part 1+%41é.txt", f"source_name={odd}/part 2.txt"],
    }
    assert {kind: _files_read(frame) for kind, frame in day.items()} == {K.GP: 3, K.REGISTRY: 0, K.LAUNCHES: 2}
    for frame in day.values():
        listed = re.findall(r"\((\d+) paths\)", frame._jdf.queryExecution().simpleString())
        assert set(listed) <= {"1"}
