"""Row filters and column choice."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.crawl_fields import any_annotation_matches, is_http_status, is_seed_hop

# Names of finished files that may be moved, and the infected-content annotation.
FINISHED_FILE = r"(?:\.warc\.gz|/crawl\.log\.cp[^/]*|/crawl\.log\.[0-9]+)$"
INFECTED = r"^.*stream:.+FOUND.*$"


def choose_columns(df: DataFrame, hidden: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Drop ``hidden`` columns, put the listed ones first; names the frame lacks are ignored."""
    shown = [c for c in df.columns if c not in set(hidden)]
    first = [c for c in order if c in shown]
    return df.select(*first, *[c for c in shown if c not in set(first)])


def seed_events(df: DataFrame, hop_path: str = "hop_path", thread: str = "thread") -> DataFrame:
    return df.where(is_seed_hop(hop_path) & F.col(thread).isNotNull())


def http_responses(df: DataFrame, status: str = "status_code") -> DataFrame:
    return df.where(is_http_status(status))


def between_times(df: DataFrame, ts: str, start: datetime | Column, end: datetime | Column) -> DataFrame:
    """Both ends included."""
    lower = start if isinstance(start, Column) else F.lit(start).cast("timestamp_ntz")
    upper = end if isinstance(end, Column) else F.lit(end).cast("timestamp_ntz")
    return df.where(F.col(ts).between(lower, upper))


def years_back(df: DataFrame, ts: str, now: datetime, years: int) -> DataFrame:
    """Rows of the current calendar year and the ``years`` before it (a range test, so it reaches the scan)."""
    first = datetime(now.year - years, 1, 1)
    return df.where(F.col(ts) >= F.lit(first).cast("timestamp_ntz"))


def tracked_files(
    df: DataFrame,
    kind: str | None = None,
    stream: str | None = None,
    service: str | None = None,
    path_prefix: str | None = None,
    has_value: tuple[str, str] | None = None,
    unmarked: str | None = None,
) -> DataFrame:
    """Facet search over tracked files; each given facet must hold.

    ``has_value`` = (array column, value it contains); ``unmarked`` = array column that must be empty.
    """
    conditions: list[Column] = []
    for column, wanted in (("kind", kind), ("stream", stream), ("service", service)):
        if wanted is not None:
            conditions.append(F.col(column) == wanted)
    if path_prefix is not None:
        conditions.append(F.col("file_path").startswith(path_prefix))
    if has_value is not None:
        conditions.append(F.array_contains(has_value[0], has_value[1]))
    if unmarked is not None:
        conditions.append(F.size(F.coalesce(F.col(unmarked), F.array().cast("array<string>"))) == 0)
    for condition in conditions:
        df = df.where(condition)
    return df


def ready_to_move(df: DataFrame, path: str, modified: str, day: datetime, back_days: int = 2) -> DataFrame:
    """Finished files modified from ``back_days`` before ``day`` until the end of ``day``."""
    start = F.lit(day).cast("timestamp_ntz") - F.expr(f"interval {int(back_days)} days")
    end = F.lit(day).cast("timestamp_ntz") + F.expr("interval 1 day")
    return df.where(F.col(path).rlike(FINISHED_FILE) & (F.col(modified) >= start) & (F.col(modified) < end))


def index_records(
    df: DataFrame,
    record_types: Sequence[str] = ("response",),
    status_prefixes: Sequence[str] = ("2",),
    schemes: Sequence[str] = ("http", "https"),
    url_excludes: Sequence[str] = (),
) -> DataFrame:
    """Records that go into the full-text index; expects ``record_type``, ``status_code``, ``url``."""
    status = F.col("status_code").cast("string")
    wanted_status = F.lit(False)
    for prefix in status_prefixes:
        wanted_status = wanted_status | status.startswith(prefix)
    scheme = F.lower(F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    out = df.where(F.col("record_type").isin(*record_types) & wanted_status & scheme.isin(*schemes))
    for pattern in url_excludes:
        out = out.where(~F.col("url").rlike(pattern))
    return out


def split_infected(df: DataFrame, annotations: str = "annotations") -> tuple[DataFrame, DataFrame]:
    """(clean, infected) by the scanner's annotation; every row is in exactly one of them."""
    infected = F.coalesce(any_annotation_matches(annotations, INFECTED), F.lit(False))
    return df.where(~infected), df.where(infected)


_TESTS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    ">": lambda c, v: c > v,
    "=~": lambda c, v: c.rlike(v),
    "!~": lambda c, v: ~c.rlike(v),
}


def ad_hoc(df: DataFrame, tests: Sequence[tuple[str, str, object]]) -> DataFrame:
    """All (column, operator, value) tests hold; unknown columns and operators are refused."""
    for column, operator, value in tests:
        if column not in df.columns:
            raise ValueError(f"no column {column!r}")
        if operator not in _TESTS:
            raise ValueError(f"no operator {operator!r}")
        df = df.where(_TESTS[operator](F.col(column), value))
    return df


def match_urls(df: DataFrame, key: str, value: str, match_type: str) -> DataFrame:
    """Index lookup: ``exact`` and ``prefix`` take a SURT key, ``host`` and ``domain`` an open host key (``uk,co,x``)."""
    column = F.col(key)
    if match_type == "exact":
        return df.where(column == value)
    if match_type == "prefix":
        return df.where(column.startswith(value))
    if match_type == "host":
        return df.where(column.startswith(value + ")"))
    if match_type == "domain":
        return df.where(column.startswith(value + ")") | column.startswith(value + ","))
    raise ValueError(f"no match type {match_type!r}")


def latest_rows(df: DataFrame, n: int, newest_first: str, tie_break: str) -> DataFrame:
    """The ``n`` newest rows; ``tie_break`` makes the order total."""
    return df.orderBy(F.col(newest_first).desc(), F.col(tie_break)).limit(n)


def cap(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` rows of a stated total order (a result cap of a search or scan)."""
    return df.orderBy(*order).limit(n)
