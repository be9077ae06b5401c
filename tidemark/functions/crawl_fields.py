"""Expressions on single fields of a crawl event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dash_to_null(value: Column | str) -> Column:
    value = _col(value)
    return F.when(value != "-", value)


def start_time(start_plus_duration: Column | str) -> Column:
    """``yyyyMMddHHmmssSSS+millis``: the start, to the millisecond (ours: missing milliseconds are zero)."""
    digits = F.split_part(_col(start_plus_duration), F.lit("+"), F.lit(1))
    seconds = F.try_to_timestamp(F.left(digits, F.lit(14)), F.lit("yyyyMMddHHmmss"))
    millis = F.coalesce(F.nullif(F.substring(digits, 15, 3), F.lit("")).try_cast("bigint"), F.lit(0))
    return F.timestamp_micros(F.unix_micros(seconds) + millis * 1000).cast("timestamp_ntz")


def duration_ms(start_plus_duration: Column | str) -> Column:
    return F.nullif(F.split_part(_col(start_plus_duration), F.lit("+"), F.lit(2)), F.lit("")).try_cast("bigint")


def annotation_list(text: Column | str) -> Column:
    """Comma-separated annotations as an array; empty text gives an empty array."""
    parts = F.transform(F.split(_col(text), ","), lambda a: F.trim(a))
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda a: (a != "") & (a != "-"))


def has_annotation(annotations: Column | str, value: str) -> Column:
    return F.array_contains(_col(annotations), value)


def annotation_value(annotations: Column | str, prefix: str) -> Column:
    """Text after ``prefix`` in the first annotation that starts with it."""
    hit = F.get(F.filter(_col(annotations), lambda a: a.startswith(prefix)), F.lit(0))
    return F.substr(hit, F.lit(len(prefix) + 1))


def any_annotation_matches(annotations: Column | str, pattern: str) -> Column:
    return F.exists(_col(annotations), lambda a: a.rlike(pattern))


def extra_info(text: Column | str) -> Column:
    """JSON object text as a map of strings; null when it is not an object."""
    return F.from_json(_col(text), "map<string,string>")


def hop_depth(hop_path: Column | str) -> Column:
    return F.length(F.coalesce(_col(hop_path), F.lit("")))


def last_hop(hop_path: Column | str) -> Column:
    return F.right(F.coalesce(_col(hop_path), F.lit("")), F.lit(1))


def is_seed_hop(hop_path: Column | str) -> Column:
    return F.coalesce(_col(hop_path), F.lit("")) == ""


def is_http_status(status: Column | str) -> Column:
    """Real responses; codes of zero and below are the crawler's own."""
    return _col(status).between(1, 600)


def status_class(status: Column | str) -> Column:
    status = _col(status)
    return F.when(is_http_status(status), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise(
        F.lit("internal")
    )


def mime_type(content_type: Column | str) -> Column:
    """Type without parameters, lower case; ``-`` and blank are null."""
    plain = F.trim(F.lower(F.split_part(_col(content_type), F.lit(";"), F.lit(1))))
    return F.when((plain != "-") & (plain != ""), plain)


def is_revisit(mime: Column | str) -> Column:
    return F.coalesce(_col(mime) == "warc/revisit", F.lit(False))
