"""Two-line element sets: framing and fixed-column fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A record is a non-blank name line, a line "1 …" and a line "2 …" with the same five id
# characters. Lengths count without trailing blanks: line 1 at least 32, line 2 at least 63 (full) or 7.
_NAME = r"^(?=[^\n]*\S)[^\n]*+\n"
_LINE_1 = r"1 ([^\n]{5})[^\n]{24}[^\n]*\S[^\n]*\n"
FULL_RECORD = rf"(?dm){_NAME}{_LINE_1}2 \1[^\n]{{55}}[^\n]*\S[^\n]*$"
CATALOGUE_RECORD = rf"(?dm){_NAME}{_LINE_1}2 \1(?:(?<=\S)|[^\n]*\S)[^\n]*$"

# Fixed values: (first column counted from 0, length)
LINE_1_FIELDS = {
    "norad_id": (2, 5),
    "classification": (7, 1),
    "international_designator": (9, 8),
    "designator_year": (9, 2),
    "designator_launch_number": (11, 3),
    "designator_piece": (14, 3),
    "epoch_year": (18, 2),
    "epoch_day": (20, 12),
}
LINE_2_FIELDS = {"inclination": (8, 8), "eccentricity": (26, 7), "mean_motion": (52, 11)}
FIRST_YEAR_OF_1900S = 57


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def records(text: Column, pattern: str) -> Column:
    """All records of a text, as an array.

    Matching left to right without overlap, from line starts only, is exactly the tolerant scan: a line that
    starts no record is skipped alone, a record consumes its three lines.
    """
    return F.regexp_extract_all(unix_lines(text), F.lit(pattern), F.lit(0))


def field(line: Column, span: tuple[int, int]) -> Column:
    start, length = span
    return F.substring(line, start + 1, length)


def epoch(two_digit_year: Column, day: Column) -> Column:
    """Time of a two-digit year and a day of year with fraction (1.0 is 1 January, 00:00)."""
    century = F.when(two_digit_year >= FIRST_YEAR_OF_1900S, 1900).otherwise(2000)
    whole = F.floor(day)
    start = F.make_date(two_digit_year + century, F.lit(1), F.lit(1))
    midnight = F.date_add(start, (whole - 1).cast("int")).cast("timestamp")
    micros = F.round((day - whole) * 86_400_000_000).cast("bigint")
    return F.timestamp_micros(F.unix_micros(midnight) + micros)
