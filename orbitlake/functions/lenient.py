"""Tolerant readers: text to typed values, NULL where the text does not fit (no exceptions under ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, the number shapes accepted, the day spreadsheets count from
WHITE_SPACE = " \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u3000"
_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SERIAL_DAY_ZERO = "1899-12-30"

# Date spellings accepted, as shape → format. A text is read only in the formats of its shape,
# because a failed attempt costs far more than a look at the shape.
_TIME = r" [0-9]{1,2}:[0-9]{2}"
DATE_FORMATS = {
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$": "yyyy-M-d",
    r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$": "yyyy/M/d",
    r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$": "M/d/yyyy",
    r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$": "M-d-yyyy",
    r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$": "d MMM yyyy",
    r"^[0-9]{1,2} [A-Za-z]{4,} [0-9]{4}$": "d MMMM yyyy",
    r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$": "d-MMM-yyyy",
    r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$": "MMM d, yyyy",
    r"^[A-Za-z]{4,} [0-9]{1,2}, [0-9]{4}$": "MMMM d, yyyy",
    rf"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{_TIME}$": "M/d/yyyy H:mm",
    rf"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{_TIME}:[0-9]{{2}}$": "M/d/yyyy H:mm:ss",
    rf"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{_TIME} [AP]M$": "M/d/yyyy h:mm a",
    rf"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{_TIME}:[0-9]{{2}} [AP]M$": "M/d/yyyy h:mm:ss a",
}
_ISO_TIME = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ].*$"


def without_mark(text: Column) -> Column:
    """Text without the byte-order mark some files begin with."""
    return F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def trimmed(text: Column) -> Column:
    """Text without surrounding white space, NULL when nothing is left."""
    return F.nullif(F.trim(text, F.lit(WHITE_SPACE)), F.lit(""))


def is_blank(text: Column) -> Column:
    return trimmed(text).isNull()


def lenient_int(text: Column) -> Column:
    value = trimmed(text)
    return F.when(value.rlike(_INTEGER), value.try_cast("int"))


def lenient_double(text: Column) -> Column:
    value = trimmed(text)
    return F.when(value.rlike(_NUMBER), value.try_cast("double"))


def lenient_timestamp(text: Column) -> Column:
    """ISO times; without an offset they are UTC (the session time zone)."""
    return trimmed(text).try_cast("timestamp")


def lenient_date(text: Column) -> Column:
    """Spreadsheet serial number above 1, else a date, else a date with a time."""
    value = trimmed(text)
    serial = lenient_double(value)
    from_serial = F.date_add(F.lit(SERIAL_DAY_ZERO).cast("date"), F.floor(serial).try_cast("int"))
    read = F.when(serial > 1, from_serial).when(value.rlike(_ISO_TIME), value.try_cast("timestamp").cast("date"))
    for shape, date_format in DATE_FORMATS.items():
        read = read.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(date_format)).cast("date"))
    return read
