"""Whole runs over landing files, repeated and continued, and their incremental form."""

import datetime as dt
import json

import pytest
from pyspark.sql import DataFrameWriter

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.plans import analytics as A
from orbitlake.plans import pipeline
from orbitlake.plans.warehouse import CommitLog, Conflict, Warehouse
from orbitlake.sources import landing, staging_csv
from orbitlake.streaming import incremental
from tests.test_sources import workbook

AS_OF = dt.date(2024, 3, 31)


def element(catalogue_id, epoch, **changes):
    item = {"OBJECT_NAME": f"OBJ {catalogue_id}", "NORAD_CAT_ID": catalogue_id, "EPOCH": epoch, "INCLINATION": 51.0, "ECCENTRICITY": 0.01, "MEAN_MOTION": 15.0}
    return {**item, **changes}


def land(folder, source, content, stamp="20240331T040000000Z", extension="json"):
    path = folder / stamp[:8]
    path.mkdir(parents=True, exist_ok=True)
    data = content if isinstance(content, bytes) else (content if isinstance(content, str) else json.dumps(content)).encode()
    (path / f"{stamp}_{source}.{extension}").write_bytes(data)


@pytest.fixture
def landing_folder(tmp_path):
    folder = tmp_path / "raw"
    land(folder, "celestrak-active", [element(1, "2024-03-30T06:00:00"), element(2, "2024-03-30T06:00:00"), element(3, "2024-03-30T06:00:00", INCLINATION=None)])
    land(folder, "celestrak-iridium-33-debris", [element(4, "2024-03-29T06:00:00")])
    land(folder, "spacedevs-recent-launches", {"results": [{"id": "L1", "name": "N", "net": "2024-03-07T01:00:00Z", "status": {"name": "Success"}}]})
    land(folder, "ucs-satellite-database", "Name of Satellite,NORAD Number,Operator/Owner,Class of Orbit\nA,1,Op,LEO\n", extension="csv")
    book = workbook(
        '<row r="1"><c r="A1" t="inlineStr"><is><t>Name</t></is></c><c r="B1" t="inlineStr"><is><t>NORAD ID</t></is></c></row>'
        '<row r="2"><c r="A2" t="inlineStr"><is><t>B</t></is></c><c r="B2"><v>2</v></c></row>'
    )
    land(folder, "ucs-satellite-database", book, stamp="20240331T040001000Z", extension="html")
    land(folder, "somebody-else", "ignored", extension="txt")
    return folder


def state(warehouse):
    facts = sorted((tuple(r) for r in warehouse.observations().collect()), key=repr)
    return facts, sorted((tuple(r) for r in warehouse.launches().collect()), key=repr)


def test_run_repeat_and_next_day(spark, tmp_path, landing_folder):
    root = str(tmp_path / "warehouse")
    star = pipeline.run(spark, str(landing_folder), root, AS_OF, export_folder=str(tmp_path / "staging"))
    assert star.stg_gp.count() == 3 and star.stg_registry.count() == 2 and star.stg_launch.count() == 1
    warehouse = Warehouse(spark, root)
    assert [r.reason for r in warehouse.snapshot("rejects", schemas.table_schema("reason string")).collect()] == ["missing required field"]
    first = state(warehouse)
    assert warehouse.real_observations().count() == 3
    # three objects × 28 days, less the three object-days with a real row
    assert warehouse.observations().where("source_id = 900").count() == 81
    # 24 days back a real launch took place
    assert warehouse.launches().where("source_id = 900").count() == 3
    ids = [r.observation_id for r in warehouse.observations().collect()]
    assert sorted(ids) == list(range(1, 85))

    exported = staging_csv.read_staging_tables(spark, str(tmp_path / "staging"), AS_OF)
    assert sorted(map(tuple, exported["stg_celestrak_objects"].collect())) == sorted(map(tuple, star.stg_gp.collect()))

    # the same files on the same day change nothing
    pipeline.run(spark, str(landing_folder), root, AS_OF)
    assert state(warehouse) == first

    # the next day: one real row arrives for a day that had a derived one
    land(landing_folder, "celestrak-geo", [element(1, "2024-03-10T06:00:00")], stamp="20240401T040000000Z")
    pipeline.run(spark, str(landing_folder), root, AS_OF + dt.timedelta(days=1))
    assert warehouse.real_observations().count() == 4
    derived = warehouse.observations().where("source_id = 900")
    assert derived.where("object_id = 1 and to_date(observation_timestamp) = '2024-03-10'").count() == 0
    # 81, minus three objects' expired day, minus the replaced day, plus three objects' new day
    assert derived.count() == 80
    assert derived.agg({"observation_timestamp": "min"}).first()[0].date() == dt.date(2024, 3, 5)
    total = warehouse.observations()
    assert total.select("observation_id").distinct().count() == total.count()

    opened = pipeline.open_star(spark, root)
    assert A.dashboard_summary(opened).first().total_objects == 3
    days = [p.name for p in (tmp_path / "warehouse" / "fact_object_position_observation").glob("observation_date=*")]
    assert sorted(days) == ["observation_date=2024-03-10", "observation_date=2024-03-29", "observation_date=2024-03-30"]


def test_broken_file_stops_a_strict_run_before_anything_is_published(spark, tmp_path, landing_folder):
    root = str(tmp_path / "warehouse")
    pipeline.run(spark, str(landing_folder), root, AS_OF)
    before = state(Warehouse(spark, root))
    land(landing_folder, "celestrak-stations", '[{"OBJECT_NAME":')
    land(landing_folder, "celestrak-starlink", [element(8, "2024-03-30T06:00:00")])
    with pytest.raises(ValueError, match="celestrak-stations"):
        pipeline.run(spark, str(landing_folder), root, AS_OF)
    assert state(Warehouse(spark, root)) == before
    pipeline.run(spark, str(landing_folder), root, AS_OF, on_error="skip")
    assert Warehouse(spark, root).real_observations().count() == 4


def test_a_run_stages_the_newest_day_of_every_source(spark, tmp_path, landing_folder):
    root = str(tmp_path / "warehouse")
    pipeline.run(spark, str(landing_folder), root, AS_OF)
    land(landing_folder, "celestrak-active", [element(1, "2024-04-01T06:00:00")], stamp="20240401T040000000Z")
    land(landing_folder, "celestrak-active", [element(2, "2024-04-02T06:00:00")], stamp="20240402T040000000Z")
    star = pipeline.run(spark, str(landing_folder), root, AS_OF + dt.timedelta(days=1))
    # object 2 left its feed; the other feeds had no new file and keep their last one
    assert sorted(r.norad_id for r in star.stg_gp.collect()) == [1, 4]
    assert star.stg_registry.count() == 2 and star.stg_launch.count() == 1
    assert sorted(r.norad_id for r in star.objects.where("norad_id is not null").collect()) == [1, 4]


def test_a_run_is_published_whole_or_not_at_all(spark, tmp_path, landing_folder, monkeypatch):
    """Whatever write a run dies after: what readers saw before every single write is the warehouse of the last run."""
    root, seen = str(tmp_path / "warehouse"), []
    pipeline.run(spark, str(landing_folder), root, AS_OF)
    before, first = state(Warehouse(spark, root)), Warehouse(spark, root).manifest
    land(landing_folder, "celestrak-geo", [element(1, "2024-03-10T06:00:00")], stamp="20240401T040000000Z")
    write = DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        if str(path).startswith(root):
            seen.append(Warehouse(spark, root).manifest == first)
        return write(self, path, *args, **kwargs)

    def refused(self, manifest):
        raise OSError("killed before the commit")

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", watched)
        patch.setattr(CommitLog, "put", refused)
        with pytest.raises(OSError, match="killed"):
            pipeline.run(spark, str(landing_folder), root, AS_OF + dt.timedelta(days=1))
    # everything was written, and nothing of it is seen
    assert len(seen) >= 11 and all(seen) and state(Warehouse(spark, root)) == before
    assert pipeline.open_star(spark, root).stg_gp.count() == 3

    pipeline.run(spark, str(landing_folder), root, AS_OF + dt.timedelta(days=1))
    warehouse = Warehouse(spark, root)
    assert warehouse.manifest.number == first.number + 1 == 2 and warehouse.real_observations().count() == 4
    assert pipeline.open_star(spark, root).stg_gp.count() == 4
    old = pipeline.open_star(spark, root, commit=1)
    assert state(warehouse.at(1)) == before and old.stg_gp.count() == 3


def test_transactions(spark, tmp_path):
    warehouse, other = (Warehouse(spark, str(tmp_path / "warehouse")) for _ in range(2))
    rows = spark.range(3).withColumnRenamed("id", "n")
    assert warehouse.manifest.number == 0 and warehouse.snapshot("t", rows.schema).count() == 0
    with warehouse.transaction():
        assert warehouse.replace("t", rows).count() == 3
        with warehouse.transaction():
            warehouse.replace("u", rows)
        assert warehouse.snapshot("u", rows.schema).count() == 3
        assert other.snapshot("t", rows.schema).count() == 0
    assert other.snapshot("t", rows.schema).count() == 3 and other.manifest.number == 1
    with pytest.raises(Conflict):
        with warehouse.transaction():
            warehouse.replace("t", rows.limit(1))
            other.replace("t", rows.limit(2))
    assert warehouse.snapshot("t", rows.schema).count() == 2 and warehouse.log.numbers() == [1, 2]
    with pytest.raises(ZeroDivisionError):
        with warehouse.transaction():
            warehouse.replace("t", rows.limit(1))
            1 / 0
    assert warehouse.snapshot("t", rows.schema).count() == 2 and warehouse.manifest.number == 2
    with warehouse.transaction():
        pass
    assert warehouse.log.numbers() == [1, 2]
    with pytest.raises(RuntimeError, match="pinned"):
        warehouse.at(1).replace("t", rows)
    assert not [p.name for p in (tmp_path / "warehouse" / "_commits").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_run_archives_its_files(spark, tmp_path, landing_folder):
    archive = str(tmp_path / "archive")
    land(landing_folder, "celestrak-stations", "oops")
    for _ in range(2):
        pipeline.stage_only(spark, str(landing_folder), str(tmp_path / "out"), AS_OF, archive_folder=archive)
    kept = {r.source_name: r for r in spark.read.parquet(archive).collect()}
    assert len(kept) == 6 == len(spark.read.parquet(archive).select("path").collect()) - 1  # two registry files
    assert kept["somebody-else"].kind is None and bytes(kept["somebody-else"].content) == b"ignored"
    assert bytes(kept["celestrak-stations"].content) == b"oops"
    pipeline.run(spark, str(landing_folder), str(tmp_path / "warehouse"), AS_OF, on_error="skip", archive_folder=archive)
    assert spark.read.parquet(archive).count() == 7


def test_a_broken_workbook_stays_one_reject(spark, tmp_path, landing_folder):
    land(landing_folder, "ucs-satellite-database", b"PK\x03\x04 and nothing more", stamp="20240331T040002000Z", extension="xlsx")
    with pytest.raises(ValueError, match="ucs-satellite-database"):
        pipeline.run(spark, str(landing_folder), str(tmp_path / "strict"), AS_OF)
    star = pipeline.run(spark, str(landing_folder), str(tmp_path / "tolerant"), AS_OF, on_error="skip")
    assert star.stg_registry.count() == 2
    rejected = pipeline.stage_only(spark, str(landing_folder), str(tmp_path / "out"), AS_OF)
    assert sorted(r.reason for r in rejected.collect()) == ["malformed workbook", "missing required field"]


def test_streamed_staging_equals_the_run(spark, tmp_path, landing_folder):
    land(landing_folder, "ucs-satellite-database", b"PK\x03\x04 broken", stamp="20240331T040002000Z", extension="xlsx")
    batch, rejected = pipeline.parse_landing(landing.read_day(spark, str(landing_folder), AS_OF))
    bad = []
    for name, kind in pipeline.KINDS.items():
        staged = str(tmp_path / name)
        incremental.ingest_new_files(spark, str(landing_folder), kind, staged, f"{tmp_path}/progress-{name}").awaitTermination()
        streamed = spark.read.schema(schemas.TABLES[name]).parquet(f"{staged}/batch=0")
        assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch[name].collect())) and streamed.count()
        bad += [r.reason for r in spark.read.parquet(f"{staged}_rejects").collect()]
    assert sorted(bad) == sorted(r.reason for r in rejected.collect())


def test_staging_only_variant_goes_on(spark, tmp_path, landing_folder):
    land(landing_folder, "celestrak-stations", "oops")
    rejected = pipeline.stage_only(spark, str(landing_folder), str(tmp_path / "out"), AS_OF)
    assert sorted(r.reason for r in rejected.collect()) == ["missing required field", "not json"]
    tables = staging_csv.read_staging_tables(spark, str(tmp_path / "out"), AS_OF)
    assert {n: t.count() for n, t in tables.items()} == {"stg_celestrak_objects": 3, "stg_ucs_satellites": 2, "stg_launch_events": 1}


def test_incremental_ingest_and_append(spark, tmp_path, landing_folder):
    root, staged, progress = str(tmp_path / "warehouse"), str(tmp_path / "staged"), str(tmp_path / "progress")
    star = pipeline.run(spark, str(landing_folder), str(tmp_path / "first"), AS_OF)
    warehouse = Warehouse(spark, root)

    def advance():
        incremental.ingest_new_files(
            spark, str(landing_folder), K.GP, staged, f"{progress}/ingest", files_per_batch=1
        ).awaitTermination()
        incremental.append_new_observations(
            warehouse, staged, star.objects, star.sources, star.stg_registry, f"{progress}/append", files_per_batch=1
        ).awaitTermination()
        return sorted((r.object_id, r.source_id, r.observation_timestamp, r.observation_id) for r in warehouse.real_observations().collect())

    first = advance()
    assert [f[:2] for f in first] == [(1, 1), (2, 1), (4, 2)]
    assert sorted(f[3] for f in first) == [1, 2, 3]
    assert advance() == first
    # a late file: one known row again, one old epoch
    land(landing_folder, "celestrak-active", [element(1, "2024-03-30T06:00:00"), element(2, "2020-01-01T00:00:00")], stamp="20240402T040000000Z")
    second = advance()
    assert len(second) == 4 and set(first) <= set(second)
    assert (2, 1, dt.datetime(2020, 1, 1), 4) in second
    assert spark.read.parquet(f"{staged}_rejects").count() == 1
