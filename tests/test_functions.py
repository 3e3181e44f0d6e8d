import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from orbitlake.functions import classify as C
from orbitlake.functions.lenient import lenient_date, lenient_double, lenient_int, lenient_timestamp
from orbitlake.functions.naming import fallback_launch_id, normalised_header, source_group


def evaluate(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text,want",
    [("25544", 25544), (" -7 ", -7), ("+3", 3), ("25544.0", None), ("abc", None), ("", None), (None, None), ("99999999999", None)],
)
def test_lenient_int(spark, text, want):
    assert evaluate(spark, lenient_int, text) == want


@pytest.mark.parametrize(
    "text,want", [("1.5", 1.5), ("2.5e1", 25.0), (".5", 0.5), (" 7 ", 7.0), ("1.5d", None), ("0x1p3", None), ("x", None), ("", None)]
)
def test_lenient_double(spark, text, want):
    assert evaluate(spark, lenient_double, text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("45000", dt.date(2023, 3, 15)),
        ("45000.75", dt.date(2023, 3, 15)),
        ("1", None),
        ("11/13/2019", dt.date(2019, 11, 13)),
        ("2019-11-13", dt.date(2019, 11, 13)),
        ("2019-11-13T23:30:00", dt.date(2019, 11, 13)),
        ("2019-11-13T23:30:00-02:00", dt.date(2019, 11, 14)),
        ("13 Nov 2019", dt.date(2019, 11, 13)),
        ("November 13, 2019", dt.date(2019, 11, 13)),
        ("11/13/2019 4:05 PM", dt.date(2019, 11, 13)),
        ("11/13/2019 16:05:09", dt.date(2019, 11, 13)),
        ("13/13/2019", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_lenient_date(spark, text, want):
    assert evaluate(spark, lenient_date, text) == want


def test_lenient_timestamp_is_utc(spark):
    def seconds(text):
        return evaluate(spark, lambda v: F.unix_timestamp(lenient_timestamp(v)), text)

    assert seconds("2024-01-01T00:00:00") == 1704067200
    assert seconds("2024-01-01T02:00:00+02:00") == 1704067200
    assert seconds("nope") is None


@pytest.mark.parametrize(
    "uri,name,want",
    [
        ("https://x.example/gp.php?GROUP=fengyun-1c-debris&FORMAT=json", "n", "debris"),
        ("https://x.example/gp.php?FORMAT=json&group=GEO", "n", "geo"),
        ("https://x.example/gp.php?group=last%2D30%2Ddays", "n", "last-30-days"),
        ("https://x.example/gp.php?group=a+b", "n", "a+b"),
        ("https://x.example/gp.php?SUBGROUP=geo", "celestrak-stations-json", "stations"),
        ("https://x.example/gp.php", "CelesTrak-Active", "active"),
        ("https://x.example/gp.php?group=100%", "n", "100%"),
    ],
)
def test_source_group(spark, uri, name, want):
    df = spark.createDataFrame([(uri, name)], "u string, n string")
    assert df.select(source_group(F.col("u"), F.col("n")).alias("r")).first().r == want


def test_fallback_launch_id(spark):
    df = spark.sql("select 'Alpha|X' n, timestamp'2024-05-06 07:08:09.123456' t, cast(null as string) p")
    got = df.select(fallback_launch_id(F.col("n"), F.col("t"), F.col("p")).alias("r")).first().r
    assert got == hashlib.sha256(b"alpha|x|2024-05-06t07:08:09.1234560+00:00|").hexdigest().upper()
    bare = spark.sql("select 'A' n, cast(null as timestamp) t, 'P' p")
    got = bare.select(fallback_launch_id(F.col("n"), F.col("t"), F.col("p")).alias("r")).first().r
    assert got == hashlib.sha256(b"a||p").hexdigest().upper()


@pytest.mark.parametrize("text", ["Operator/Owner", "operator_owner", " OPERATOR - Owner ", "operator  owner"])
def test_headers(spark, text):
    assert evaluate(spark, normalised_header, text) == "operator owner"


@pytest.mark.parametrize(
    "debris,ecc,motion,want",
    [(True, 0.5, 20.0, 0.9), (False, 0.1, 20.0, 0.75), (False, 0.09, 12.0, 0.5), (False, 0.0, 11.9, 0.25), (False, None, None, 0.25)],
)
def test_risk(spark, debris, ecc, motion, want):
    df = spark.createDataFrame([(debris, ecc, motion)], "d boolean, e double, m double")
    assert df.select(C.risk_score(F.col("d"), F.col("e"), F.col("m")).alias("r")).first().r == want


@pytest.mark.parametrize(
    "status,active,strict",
    [("Active", True, True), ("INACTIVE", True, False), ("Non-Operational", True, False), ("operational", True, True), (None, False, False), ("Decayed", False, False)],
)
def test_active_quirk(spark, status, active, strict):
    assert evaluate(spark, C.is_active, status) is active
    assert evaluate(spark, lambda s: C.is_active(s, strict=True), status) is strict


@pytest.mark.parametrize("status,want", [("Launch Successful", 1), ("Partial Success", 1), ("Unsuccessful", 1), ("Failure", 0), (None, 0)])
def test_success_flag(spark, status, want):
    assert evaluate(spark, C.succeeded, status) == want


def test_only_exact_classes_are_bands(spark):
    assert [evaluate(spark, C.band_id, c) for c in ("LEO", "MEO", "GEO", "HEO", "leo", "Elliptical", None)] == [1, 2, 3, 4, None, None, None]
