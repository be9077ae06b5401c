"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.tables import Tables
from tidemark.plans.views import with_views


@dataclass(frozen=True)
class Query:
    name: str
    row: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}

MODULES = ("activity", "urls", "captures", "storage", "curated", "texts", "inputs", "streams", "jobs")


def query(name: str, row: str, sql: str | None = None):
    """Register a function of :class:`Tables`; ``row`` names the inventory rows it covers."""

    def add(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = Query(name, row, run, with_views(sql) if sql else None)
        return run

    return add


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"tidemark.plans.{module}")
    return dict(_QUERIES)


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.run(Tables(spark, sf_dir))

    run.__name__ = q.name
    return run
