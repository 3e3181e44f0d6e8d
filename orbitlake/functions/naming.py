"""Names and ids derived from feed metadata and record content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_group(uri: Column, source_name: Column) -> Column:
    """Group of a feed: its GROUP query parameter, else its name without the usual prefix and suffix.

    Any group mentioning debris is the one group ``debris``.
    """
    query = F.regexp_extract(uri, r"\?([^#]*)", 1)
    parameter = F.regexp_extract(query, r"(?i)(?:^|&)GROUP=([^&]*)", 1)
    has_parameter = query.rlike(r"(?i)(?:^|&)GROUP=")
    from_name = F.regexp_replace(source_name, r"(?i)celestrak-|-json", "")
    # a plus sign stays a plus sign in this decoding
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(parameter, r"\+", "%2B")), parameter)
    group = F.lower(F.trim(F.when(has_parameter, decoded).otherwise(from_name)))
    return F.when(group.contains("debris"), F.lit("debris")).otherwise(group)


def fallback_launch_id(name: Column, launch_date: Column, provider: Column) -> Column:
    """Id of a launch that carries none: hash of name, time (seven fraction digits, UTC) and provider."""
    time = F.concat(F.date_format(launch_date, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS"), F.lit("+00:00"))
    parts = [F.coalesce(part, F.lit("")) for part in (name, time, provider)]
    return F.upper(F.sha2(F.lower(F.concat_ws("|", *parts)), 256))


def normalised_header(header: Column) -> Column:
    """Lower case, with underscores, slashes, hyphens and runs of blanks as one blank."""
    return F.lower(F.trim(F.regexp_replace(header, r"[_/\- ]+", " ")))
