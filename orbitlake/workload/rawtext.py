"""Raw snapshots written from the test tables, so that the parsers have files of every format to read.

Rows are packed into files of bounded size by ranges of their unique id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake.workload.analogue import Lake

ROWS_PER_FILE = 1000
ROWS_PER_FULL_FILE = 10_000  # shared by the statuses of a part; pages are parsed whole
DOWNLOADED = "2024-01-31 04:00:00"

# group the element sets of an event type arrive in
FEED_GROUP = {
    "view": "active",
    "click": "fengyun-1c-debris",
    "purchase": "GEO",
    "signup": "starlink",
    "error": "unlisted",
}


def chunk(key: str) -> Column:
    return F.floor(F.col(key) / ROWS_PER_FILE)


def json_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.collect_list(items), ",\n"), F.lit("]"))


def snapshot(df: DataFrame, kind: str) -> DataFrame:
    """Snapshots in the parsers' shape; parts of one source are downloaded a minute apart."""
    minutes = F.make_dt_interval(mins=F.col("part").cast("int")) if "part" in df.columns else None
    downloaded = F.lit(DOWNLOADED).cast("timestamp")
    return df.select(
        "path",
        "content",
        "source_name",
        "source_uri",
        F.lit(kind).alias("kind"),
        (downloaded if minutes is None else downloaded + minutes).alias("downloaded_at"),
    )


def land(snapshots: DataFrame, folder: str) -> None:
    """Write snapshots as files, one per row, under ``source_name=…`` folders. A source's files share its folder: one
    folder each would have to be made, renamed and listed, too."""
    parts = snapshots.select("source_name", "content")
    parts.write.mode("append").partitionBy("source_name").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder)


def feed_group(event_type: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in FEED_GROUP.items() for x in pair))[event_type]


def gp_files(lake: Lake, per_hour: bool = False) -> DataFrame:
    """Element sets as JSON arrays; debris numbers arrive as strings, rows of small value lack the id.

    ``per_hour`` cuts epochs to whole hours, for files to be landed: they get about ``ROWS_PER_FILE`` rows each, not a
    share of so many ids.
    """
    group = feed_group(F.col("event_type"))
    epoch = F.date_trunc("hour", "ts") if per_hour else F.col("ts")

    def number(value: Column) -> Column:
        quoted = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
        return F.when(F.col("event_type") == "click", quoted).otherwise(value.cast("string"))

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}": '), value)

    members = [
        member("OBJECT_NAME", F.concat(F.lit('"OBJ-'), F.col("user_id").cast("string"), F.lit('"'))),
        F.when(F.col("value") >= 0.5, member("NORAD_CAT_ID", number(F.col("user_id")))),
        member("EPOCH", F.concat(F.lit('"'), F.date_format(epoch, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"'))),
        member("INCLINATION", number(F.col("value"))),
        member("ECCENTRICITY", number(F.col("value") / 1000)),
        member("MEAN_MOTION", number(F.col("value") / 5)),
    ]
    item = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    # an id belongs to one type of event, so a range of ids is shared by the files of all types
    part = F.floor(chunk("event_id") / len(FEED_GROUP)) if per_hour else chunk("event_id")
    files = (
        lake.raw("events")
        .groupBy("event_type", part.alias("part"))
        .agg(json_array(item).alias("content"))
        .withColumns(
            {
                "source_name": F.concat(F.lit("celestrak-"), F.lower(group)),
                "source_uri": F.concat(F.lit("https://feeds.example/gp.php?group="), group, F.lit("&FORMAT=json")),
                "path": F.concat_ws("/", F.lit("gp"), F.col("event_type"), F.col("part").cast("string")),
            }
        )
    )
    return snapshot(files, K.GP)


def launch_files(lake: Lake, full: bool = False) -> DataFrame:
    """Launches as JSON: plain arrays, pages with ``results``, records without a text id.

    ``full``: files of some megabytes, to be landed and read in splits, by the number of rows and not by ranges of keys,
    which may have gaps.
    """
    orders = lake.raw("orders")
    parts = max(1, math.ceil(orders.count() / ROWS_PER_FULL_FILE)) if full else None
    part = F.pmod(F.xxhash64(*orders.columns), F.lit(parts)) if full else chunk("o_orderkey")
    status = F.col("o_orderstatus")
    key = F.col("o_orderkey").cast("string")
    payloads = F.array_repeat(F.struct(F.lit("sat").alias("kind")), F.floor(F.col("o_totalprice") / 100000).cast("int"))
    named = F.concat(F.lit("ROCKET-"), status)
    item = F.to_json(
        F.struct(
            F.when(status != "P", key).alias("id"),
            F.concat(F.lit("LAUNCH-"), key).alias("name"),
            F.when(status != "O", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("net"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("window_start"),
            F.struct(F.when(F.col("o_totalprice") < 480000, F.col("o_orderpriority")).alias("name")).alias(
                "launch_service_provider"
            ),
            F.struct(
                F.struct(
                    F.when(status == "F", named).alias("full_name"), F.when(status != "F", named).alias("name")
                ).alias("configuration"),
                F.struct(F.when(F.col("o_totalprice") >= 20000, payloads).alias("payloads")).alias("spacecraft_stage"),
            ).alias("rocket"),
            F.struct(
                F.when(status == "F", "Launch Successful").when(status == "O", "Launch Failure").otherwise("Partial Success").alias("name")
            ).alias("status"),
            F.struct(
                F.struct(F.when(status == "F", F.lit("N/A")).alias("country_code")).alias("location"),
                F.when(status != "F", F.lit("N/A")).alias("country_code"),
            ).alias("pad"),
        )
    )
    array = json_array(item)
    page = F.concat(F.lit('{"count": 1, "next": null, "results": '), array, F.lit("}"))
    files = (
        orders.groupBy("o_orderstatus", part.alias("part"))
        .agg(F.when(F.col("o_orderstatus") == "O", page).otherwise(array).alias("content"))
        .withColumns(
            {
                "source_name": F.lit("spacedevs-recent-launches"),
                "source_uri": F.lit("https://launches.example/previous/?limit=100"),
                "path": F.concat_ws("/", F.lit("launches"), F.col("o_orderstatus"), F.col("part").cast("string")),
            }
        )
    )
    return snapshot(files, K.LAUNCHES)


# header line and separator of the registry table of a segment
REGISTRY_LAYOUT = {
    "AUTOMOBILE": (",", "Name of Satellite,NORAD Number,Operator/Owner,Country/Org of UN Registry,Purpose,Class of Orbit,Status,Date of Launch"),
    "BUILDING": (";", "Current Official Name of Satellite;norad_id;operator_owner;Users;Purpose;Orbit-Class;Operational Status;Launch Date"),
    "FURNITURE": ("\t", "Satellite Name\tNORAD ID\tOperator\tCountry\tPurpose\tClass of Orbit\tStatus\tDate of Launch"),
    "HOUSEHOLD": (",", "Name,NORAD Number,Owner Operator,Country,PURPOSE,Class  of Orbit,operational_status,launch-date"),
    "MACHINERY": (",", "Name,NORAD Number,Operator,Country,Purpose,Class of Orbit,Status,Date of Launch"),
}


def registry_launch_date() -> Column:
    return F.date_add(F.lit("2000-01-01").cast("date"), F.floor(F.abs("c_acctbal")).cast("int"))


def registry_fields() -> list[Column]:
    """Cells of one registry row in the order of every layout, as text."""
    segment, date = F.col("c_mktsegment"), registry_launch_date()
    serial = F.date_diff(date, F.lit("1899-12-30").cast("date")).cast("string")
    written = (
        F.when(segment == "AUTOMOBILE", F.date_format(date, "M/d/yyyy"))
        .when(segment == "BUILDING", F.date_format(date, "yyyy-MM-dd"))
        .otherwise(serial)
    )
    name = F.concat(F.col("c_name"), F.lit(', "'), F.lower(segment), F.lit('";\n block'))
    return [
        F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')),
        F.when(F.col("c_acctbal") < -900, F.lit("n/a")).otherwise(F.col("c_custkey").cast("string")),
        F.when(F.col("c_acctbal") < 1000, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("n_name"), F.lit(" "))),
        F.col("n_name"),
        segment,
        F.when(segment == "BUILDING", "MEO").when(segment == "AUTOMOBILE", "LEO").otherwise("GEO"),
        F.when(F.col("c_acctbal") > 7000, "Operational").otherwise(""),
        written,
    ]


def registry_rows(lake: Lake) -> DataFrame:
    nations = lake.raw("nation").select("n_nationkey", "n_name")
    customers = lake.raw("customer")
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey)


def registry_files(lake: Lake) -> DataFrame:
    """Registry tables with different separators, header spellings, date spellings and quoting."""
    headers = F.create_map(*(F.lit(x) for s, (_, header) in REGISTRY_LAYOUT.items() for x in (s, header)))
    record = F.lit(None).cast("string")
    for segment, (sep, _) in REGISTRY_LAYOUT.items():
        record = F.when(F.col("c_mktsegment") == segment, F.concat_ws(sep, *registry_fields())).otherwise(record)
    files = (
        registry_rows(lake)
        .withColumns({"record": record, "header": headers[F.col("c_mktsegment")]})
        .groupBy("c_mktsegment", "header", chunk("c_custkey").alias("part"))
        .agg(F.array_join(F.collect_list("record"), "\r\n").alias("body"))
        .withColumns(
            {
                "content": F.concat("header", F.lit("\r\n"), "body", F.lit("\r\n")),
                "source_name": F.lit("ucs-satellite-database"),
                "source_uri": F.lit("https://registry.example/database"),
                "path": F.concat_ws("/", F.lit("registry"), F.col("c_mktsegment"), F.col("part").cast("string")),
            }
        )
    )
    return snapshot(files, K.REGISTRY)


_WORKBOOK_HEADER = ["Name of Satellite", "NORAD Number", "Operator/Owner", "Country", "Purpose", "Class of Orbit", "Status", "Date of Launch"]


def _write_workbooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One workbook per row of ``rows`` (array of arrays of cell text), with inline strings."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def sheet(rows: list[list[str | None]]) -> str:
        lines = []
        for number, row in enumerate(rows, start=1):
            cells = "".join(
                f'<c r="{chr(65 + i)}{number}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
                for i, v in enumerate(row)
                if v is not None
            )
            lines.append(f'<row r="{number}">{cells}</row>')
        return (
            '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
            + "".join(lines)
            + "</sheetData></worksheet>"
        )

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    for batch in batches:
        books = []
        for book in batch.to_pylist():
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("xl/worksheets/sheet1.xml", sheet([_WORKBOOK_HEADER, *book["rows"]]))
            books.append({"path": book["path"], "content": packed.getvalue()})
        if books:
            yield pa.RecordBatch.from_pylist(books, schema=schema)


def registry_workbooks(lake: Lake) -> DataFrame:
    """The registry as workbooks of bounded size."""
    fields = registry_fields()
    cells = F.array(F.col("c_name"), *fields[1:])
    rows = (
        registry_rows(lake)
        .groupBy("c_mktsegment", chunk("c_custkey").alias("part"))
        .agg(F.collect_list(cells).alias("rows"))
        .select(F.concat_ws("/", F.lit("books"), "c_mktsegment", F.col("part").cast("string")).alias("path"), "rows")
    )
    return rows.mapInArrow(_write_workbooks, "path string, content binary").select(
        "path",
        "content",
        F.lit("ucs-satellite-database").alias("source_name"),
        F.lit(DOWNLOADED).cast("timestamp").alias("downloaded_at"),
    )


def tle_files(lake: Lake) -> DataFrame:
    """Two-line element text per nation, with stray lines, blank lines and records whose ids disagree."""
    key = F.col("c_custkey")
    catalogue_id = F.lpad((key % 100000).cast("string"), 5, "0")
    other_id = F.when(F.col("c_acctbal") > 9000, F.lit("XXXXX")).otherwise(catalogue_id)
    year = F.lpad((F.col("c_nationkey") + 40).cast("string"), 2, "0")
    day = F.format_string("%012.8f", F.floor(F.abs("c_acctbal") / 30) + 1 + F.lit(0.5))
    line1 = F.concat(F.lit("1 "), catalogue_id, F.lit("U "), F.lit("98067A  "), F.lit(" "), year, day, F.lit("  .00000023  00000-0"))
    line2 = F.concat(
        F.lit("2 "), other_id, F.lit(" "), F.format_string("%8.4f", F.abs("c_acctbal") / 100), F.lit(" 348.7242 "),
        F.lpad(key.cast("string"), 7, "0"), F.lit(" 331.7664  19.3264 "), F.format_string("%11.8f", F.abs("c_acctbal") / 1000),
        F.lit("    1"),
    )
    stray = F.when(F.col("c_acctbal") < 0, F.lit("# stray line\n\n")).otherwise("")
    record = F.concat(stray, F.col("c_name"), F.lit("  \r\n"), line1, F.lit("\r\n"), line2, F.lit("\r\n"))
    files = (
        lake.raw("customer")
        .groupBy("c_nationkey", chunk("c_custkey").alias("part"))
        .agg(F.array_join(F.collect_list(record), "").alias("content"))
        .withColumns(
            {
                "source_name": F.concat(F.lit("tle-"), F.col("c_nationkey").cast("string")),
                "source_uri": F.lit("https://feeds.example/tle.txt"),
                "path": F.concat_ws("/", F.lit("tle"), F.col("c_nationkey").cast("string"), F.col("part").cast("string")),
            }
        )
    )
    return snapshot(files, K.TLE)


def page_snapshots(lake: Lake) -> DataFrame:
    """Web pages where a table or JSON was expected."""
    pages = lake.raw("pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"),
        F.col("html").alias("content"),
        F.lit("celestrak-stations-json").alias("source_name"),
        F.col("url").alias("source_uri"),
    )
    return snapshot(pages, K.GP)


def document_snapshots(lake: Lake) -> DataFrame:
    """Plain texts where JSON was expected."""
    documents = lake.raw("documents").select(
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("content"),
        F.concat(F.lit("celestrak-"), F.col("source"), F.lit("-json")).alias("source_name"),
        F.concat(F.lit("https://feeds.example/gp.php?FORMAT=json&Group=%20"), F.col("lang"), F.lit("-DEBRIS+x#top")).alias("source_uri"),
    )
    return snapshot(documents, K.GP)
