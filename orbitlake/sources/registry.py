"""Satellite registry tables: delimited text with varying headers, and workbooks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitlake import constants as K
from orbitlake import schemas
from orbitlake.functions.lenient import WHITE_SPACE, is_blank, lenient_date, lenient_int, trimmed, without_mark
from orbitlake.functions.naming import normalised_header
from orbitlake.sources import landing
from orbitlake.sources import lines as L
from orbitlake.sources.rows import NOTHING, computed_once, split
from orbitlake.workspace import write_through

# Separators in order of preference when equally frequent
SEPARATORS = ["\t", ";", ","]


def first_line(content: Column) -> Column:
    return F.substring_index(F.substring_index(content, "\n", 1), "\r", 1)


def container(line: Column) -> Column:
    """What a file is, judged by its first line: empty, workbook, html or table."""
    lowered = F.lower(line)
    return (
        F.when(is_blank(line), F.lit("empty"))
        .when(line.startswith("PK\x03\x04"), F.lit("workbook"))
        .when(lowered.contains("<html") | lowered.contains("<!doctype"), F.lit("html"))
        .otherwise(F.lit("table"))
    )


def separator(line: Column) -> Column:
    """The most frequent candidate in the first line."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(s))) for s in SEPARATORS]
    most = F.greatest(*counts)
    choice = F.lit(SEPARATORS[-1])
    for candidate, count in reversed(list(zip(SEPARATORS, counts))):
        choice = F.when(count == most, F.lit(candidate)).otherwise(choice)
    return choice


def _field_pattern(sep: str) -> str:
    """One field: quoted text (with doubled quotes, separators and line ends inside), else plain text.

    A quote that never closes is plain text. The possessive loops keep the match linear.
    """
    return rf'(?: *+"[^"]*+(?:""[^"]*+)*+"[^{sep}\r\n]*+|[^{sep}\r\n]*+)'


def _by_separator(sep: Column, make) -> Column:
    """``make(separator)`` for the separator of the row; the patterns are constants, compiled once."""
    chosen = F.lit(None)
    for candidate in SEPARATORS:
        chosen = F.when(sep == candidate, make(candidate)).otherwise(chosen)
    return chosen


def split_records(content: Column, sep: Column) -> Column:
    """Records of a delimited text: line ends inside quotes do not end a record."""

    def records(s: str) -> Column:
        field = _field_pattern(s)
        return F.regexp_extract_all(content, F.lit(rf"(?:^|(?<=[\r\n])){field}(?:{s}{field})*+"), F.lit(0))

    return F.filter(_by_separator(sep, records), lambda r: ~is_blank(r))


def split_fields(record: Column, sep: Column) -> Column:
    """Trimmed, unquoted fields of one record."""

    def fields(s: str) -> Column:
        return F.regexp_extract_all(record, F.lit(rf"(?:^|(?<={s})){_field_pattern(s)}"), F.lit(0))

    def clean(raw: Column) -> Column:
        bare = F.trim(raw, F.lit(WHITE_SPACE))
        quoted = bare.startswith('"') & bare.endswith('"') & (F.length(bare) >= 2)
        inside = F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
        return F.when(quoted, inside).otherwise(bare)

    return F.transform(_by_separator(sep, fields), clean)


def header_positions(headers: Column, aliases: list[str]) -> Column:
    """Positions of the columns that may hold a field: alias by alias in order of preference, and left to right
    where several columns carry the same header.
    """
    positions = F.sequence(F.lit(0), F.size(headers) - 1)

    def carrying(alias: str) -> Column:
        return F.filter(positions, lambda i: F.get(headers, i) == alias)

    return F.flatten(F.array(*(carrying(a) for a in aliases)))


def first_value(values: Column, positions: Column) -> Column:
    """The first non-blank value at the given positions."""
    return F.get(F.filter(F.transform(positions, lambda i: trimmed(F.get(values, i))), lambda v: v.isNotNull()), 0)


def _resolve(rows: DataFrame) -> DataFrame:
    """Rows of ``headers`` positions and ``values`` to staging rows; a row without a name is a reject."""
    found = {c: first_value(F.col("values"), F.col(f"_at_{c}")) for c in K.REGISTRY_HEADERS}
    found["norad_id"] = lenient_int(found["norad_id"]).cast("bigint")
    found["launch_date"] = lenient_date(found["launch_date"])
    fields = computed_once(
        rows, ["path", "source_name", "values", "_problem", "_preview", F.col("downloaded_at").alias("imported_at")], found
    )
    reason = F.coalesce("_problem", F.when(F.col("satellite_name").isNull(), F.lit("no satellite name")))
    return computed_once(
        fields,
        ["path", "source_name", *schemas.STG_REGISTRY.names],
        {"reason": reason, "detail": F.when(reason.isNotNull(), F.coalesce("_preview", F.to_json("values")))},
    )


def _positions(headers: Column) -> dict[str, Column]:
    """Column positions per field, worked out once per file."""
    return {f"_at_{c}": header_positions(headers, aliases) for c, aliases in K.REGISTRY_HEADERS.items()}


_AT = [f"_at_{c}" for c in K.REGISTRY_HEADERS]


def read_registry(snapshots: DataFrame) -> DataFrame:
    """One row per registry row or problem; every file has its own separator and header line."""
    content = F.col("content")
    keep = ["path", "source_name", "downloaded_at"]
    texts = computed_once(snapshots, keep, {"content": without_mark(content)})
    kinds = computed_once(
        texts,
        [*keep, "content"],
        {"_kind": container(first_line(content)), "sep": separator(first_line(content)), "_preview": first_line(content)},
    )
    is_table = F.col("_kind") == "table"
    files = computed_once(
        kinds, [*keep, "sep", "_kind", "_preview"], {"_records": F.when(is_table, split_records(content, F.col("sep")))}
    )
    header = F.transform(split_fields(F.get("_records", F.lit(0)), F.col("sep")), normalised_header)
    headed = computed_once(files, files.columns, {"headers": header})
    placed = computed_once(headed, headed.columns, _positions(F.col("headers")))
    problem = F.when(~is_table, F.col("_kind"))
    exploded = placed.select(
        *keep, "sep", *_AT, problem.alias("_file_problem"), F.when(~is_table, F.col("_preview")).alias("_preview"),
        F.posexplode_outer("_records").alias("record_no", "_record"),
    )
    return _rows(exploded)


def _rows(exploded: DataFrame) -> DataFrame:
    """Staging rows and problems of records; record 0 of a file is its header."""
    keep = ["path", "source_name", "downloaded_at"]
    is_header = F.coalesce(F.col("record_no") == 0, F.lit(False))
    rows = computed_once(
        exploded,
        [*keep, *_AT, "_preview"],
        {
            "values": split_fields(F.col("_record"), F.col("sep")),
            "_problem": F.coalesce("_file_problem", F.when(is_header, F.lit(NOTHING))),
        },
    )
    return _resolve(rows)


def _quote_states(line: Column, sep: Column) -> dict[str, Column]:
    """Where a line leads: 1 if it ends within quotes, when it begins outside of them and when it begins within."""
    text, whole = r'[^"]*+(?:""[^"]*+)*+', {}

    def ends_inside(s: str) -> str:
        plain = rf"[^{s}\r\n]*+"
        field = rf'(?: *+"{text}"{plain}|(?! *"){plain})'
        return rf'(?:{field}[{s}\r])*+ *+"{text}$'

    whole["_of_outside"] = _by_separator(sep, lambda s: line.rlike(rf"^{ends_inside(s)}"))
    closed = _by_separator(sep, lambda s: line.rlike(rf'^{text}"[^{s}\r\n]*+[{s}\r]{ends_inside(s)}'))
    whole["_of_inside"] = closed | line.rlike(rf"^{text}$")
    return {name: F.coalesce(c, F.lit(False)).cast("int") for name, c in whole.items()}


def read_registry_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``read_registry`` of delimited files, read in splits: a file of any size is many tasks.

    A record may run over line ends within quotes, so which lines begin a record depends on all lines before: every
    line is a function of "within quotes or not", and the functions are composed over blocks. From a quote that never
    closes on, lines stand for themselves. A file without a byte has no lines, and gives no reject either.
    """
    lines = L.read_lines(spark, paths, ends="\n")
    firsts = lines.where("line_no = 0").select("path", "modified", first_line(F.col("line")).alias("_preview"))
    kinds = computed_once(firsts, ["path", "modified", "_preview"], {"_kind": container(F.col("_preview")), "sep": separator(F.col("_preview"))})
    kinds = write_through(kinds, "registry-files")
    tables = lines.drop("modified").join(kinds.where("_kind = 'table'").select("path", "sep"), "path")
    stated = L.states(tables.withColumns(_quote_states(F.col("line"), F.col("sep"))), "_of_outside", "_of_inside")
    stated = write_through(stated, "registry-lines")
    # the line on which the last quote was opened, of files that end within it
    before, after = F.col("inside_before") == 1, F.col("inside_after") == 1
    opens = after & (~before | ~F.col("line").rlike(r'^[^"]*+(?:""[^"]*+)*+$'))
    ends = stated.groupBy("path").agg(F.max_by("inside_after", "line_no").alias("_ends_inside"), F.max(F.when(opens, F.col("line_no"))).alias("_opened"))
    ends = ends.where("_ends_inside = 1").select("path", "_opened")
    stated = stated.join(ends, "path", "left")
    loose = F.coalesce(F.col("line_no") > F.col("_opened"), F.lit(False))
    last_open = F.coalesce(F.col("line_no") == F.col("_opened"), F.lit(False))
    stated = stated.withColumns({"_starts": ~before | loose, "alone": loose | (~before & (~after | last_open))})
    texts = L.chunks(stated.select("path", "block", "line_no", "line", "_starts", "alone"), "_starts").join(kinds, "path")
    found = texts.select("path", "modified", "sep", "line_no", F.posexplode(split_records(F.col("text"), F.col("sep"))).alias("_nth", "_record"))
    found = write_through(found, "registry-records")
    headers = found.groupBy("path").agg(F.min_by(F.struct("line_no", "_nth", "_record", "sep"), F.struct("line_no", "_nth")).alias("_head"))
    header = F.transform(split_fields(F.col("_head._record"), F.col("_head.sep")), normalised_header)
    headed = computed_once(headers, ["path", "_head"], {"headers": header})
    placed = computed_once(headed, ["path", F.struct("_head.line_no", "_head._nth").alias("_first")], _positions(F.col("headers")))
    record_no = F.when(F.struct("line_no", "_nth") == F.col("_first"), 0).otherwise(1)
    named = {"source_name": landing.source_of(F.col("path")), "downloaded_at": landing.downloaded_at(F.col("path"), F.col("modified"))}
    nothing = {"_file_problem": F.lit(None).cast("string"), "_preview": F.lit(None).cast("string")}
    records = found.join(write_through(placed, "registry-headers"), "path").withColumns(named | nothing | {"record_no": record_no})
    refused = kinds.where("_kind <> 'table'").select("path", "modified", "_preview", F.col("_kind").alias("_file_problem"))
    return _rows(records.unionByName(refused.withColumns(named), allowMissingColumns=True))


def parse_registry_files(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return split(read_registry_files(spark, paths), schemas.STG_REGISTRY)


def parse_registry(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(read_registry(snapshots), schemas.STG_REGISTRY)


# --- workbooks -----------------------------------------------------------------------------------

# Parts and namespace of the spreadsheet format
_SHEET = "xl/worksheets/sheet1.xml"
_STRINGS = "xl/sharedStrings.xml"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORKBOOK_ROWS = "path string, source_name string, downloaded_micros bigint, row_no int, headers array<string>, values array<string>, problem string"
MALFORMED, NO_SHEET = "malformed workbook", "no worksheet"
_ROWS_PER_BATCH = 2000


def _sheet_rows(content: bytes) -> Iterator[dict[str, str | None]]:
    """Rows of the first sheet as column letter → text, streamed."""
    import io
    import zipfile
    from xml.etree.ElementTree import iterparse

    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = set(book.namelist())
        if _SHEET not in parts:
            raise KeyError(NO_SHEET)
        shared: list[str] = []
        if _STRINGS in parts:
            with book.open(_STRINGS) as part:
                for _, node in iterparse(part):
                    if node.tag == _NS + "si":
                        shared.append("".join(t.text or "" for t in node.iter(_NS + "t")))
                        node.clear()

        def cell_text(cell) -> str | None:
            value = cell.find(_NS + "v")
            if value is None:
                inline = cell.find(f"{_NS}is//{_NS}t")
                return None if inline is None else inline.text or ""
            raw = value.text or ""
            if cell.get("t") == "s" and raw.strip().isdigit() and int(raw) < len(shared):
                return shared[int(raw)]
            return raw

        with book.open(_SHEET) as part:
            for _, node in iterparse(part):
                if node.tag != _NS + "row":
                    continue
                row = {}
                for cell in node.findall(_NS + "c"):
                    letters = "".join(ch for ch in cell.get("r", "") if ch.isalpha()).upper()
                    if letters:
                        row[letters] = cell_text(cell)
                node.clear()
                if row:
                    yield row


def _trouble(content: bytes) -> str | None:
    """Why a workbook cannot be read to its end, if so. It is unpacked once for this, so that a workbook that breaks
    half-way yields one reject and no rows.
    """
    import struct
    import zipfile
    import zlib
    from xml.etree.ElementTree import ParseError

    try:
        for _ in _sheet_rows(content):
            pass
    except KeyError:
        return NO_SHEET
    except (zipfile.BadZipFile, zlib.error, ParseError, EOFError, OSError, NotImplementedError, RuntimeError, struct.error, ValueError):
        return MALFORMED
    return None


def _read_workbooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("path", pa.string()),
            ("source_name", pa.string()),
            ("downloaded_micros", pa.int64()),
            ("row_no", pa.int32()),
            ("headers", pa.list_(pa.string())),
            ("values", pa.list_(pa.string())),
            ("problem", pa.string()),
        ]
    )
    for batch in batches:
        for book in batch.to_pylist():
            content = book.pop("content")
            problem = _trouble(content)
            if problem:
                yield pa.RecordBatch.from_pylist([{**book, "row_no": 0, "headers": [], "values": [], "problem": problem}], schema=schema)
                continue
            rows = _sheet_rows(content)
            header = next(rows, None)
            if header is None:
                continue
            headers = list(header.values())
            out = []
            for number, row in enumerate(rows, start=1):
                values = [row.get(column) for column in header]
                out.append({**book, "row_no": number, "headers": headers, "values": values})
                if len(out) == _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_workbooks(books: DataFrame) -> DataFrame:
    """Registry workbooks (binary ``content``): first sheet, first row is the header.

    Unpacking is the one step without a Spark expression; it streams rows out of each workbook, and headers
    are resolved by the same columns as for delimited text. A workbook that cannot be read is one reject.
    """
    packed = books.select("path", "source_name", F.unix_micros("downloaded_at").alias("downloaded_micros"), "content")
    rows = packed.mapInArrow(_read_workbooks, _WORKBOOK_ROWS)
    headers = F.transform("headers", lambda h: normalised_header(F.coalesce(h, F.lit(""))))
    headed = rows.withColumns(
        {
            "headers": headers,
            "downloaded_at": F.timestamp_micros("downloaded_micros"),
            "_problem": F.col("problem"),
            "_preview": F.when(F.col("problem").isNotNull(), F.col("path")),
        }
    )
    return _resolve(computed_once(headed, headed.columns, _positions(F.col("headers"))))


def parse_workbooks(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(read_workbooks(books), schemas.STG_REGISTRY)
