"""Time expressions. Stored times are TIMESTAMP_NTZ; the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 14-digit timestamps that mean "first" and "last" capture and never parse as a date.
EARLIEST_TS14 = "10000101000000"
LATEST_TS14 = "99999999999999"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_seconds(_col(ts).cast("timestamp"))


def epoch_micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def bucket_start(ts: Column | str, seconds: int) -> Column:
    """Start of the fixed-width bucket, aligned to the epoch."""
    s = epoch_seconds(ts)
    return from_epoch_seconds(s - F.pmod(s, F.lit(seconds)))


def to_ts14(ts: Column | str) -> Column:
    return F.date_format(_col(ts).cast("timestamp"), "yyyyMMddHHmmss")


def from_ts14(ts14: Column | str) -> Column:
    """Null for the two sentinels and for text that is no timestamp."""
    value = _col(ts14)
    parsed = F.try_to_timestamp(value, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return F.when(value.isin(EARLIEST_TS14, LATEST_TS14), F.lit(None)).otherwise(parsed)


def day(ts: Column | str) -> Column:
    return F.to_date(_col(ts))
