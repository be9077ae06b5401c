"""Matching SURT keys against lists of SURT prefixes.

Comparing every key with every prefix by ``startswith`` is a nested-loop join. Here each distinct key
is exploded into its own boundary prefixes, which are then matched by equality. Short prefixes
such as ``uk,`` are shared by most keys, so the exploded rows carry a salt and the (much smaller)
prefix list is repeated once per salt value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import SURT_BOUNDARIES, key_prefixes

SALTS = 16


def _boundary_forms(prefix: Column) -> Column:
    """A prefix that ends at a boundary stands for itself; any other also needs a boundary (or the end) after it."""
    closed = F.right(prefix, F.lit(1)).isin(*SURT_BOUNDARIES)
    forms = F.array(prefix, *[F.concat(prefix, F.lit(b)) for b in SURT_BOUNDARIES])
    return F.when(closed, F.array(prefix)).otherwise(forms)


def prefix_hits(
    keys: DataFrame, key: str, prefixes: DataFrame, prefix: str, salts: int = SALTS
) -> DataFrame:
    """(key, all columns of ``prefixes``) for every prefix that covers a distinct key."""
    exploded = (
        keys.select(key)
        .where(F.col(key).isNotNull())
        .distinct()
        .select(
            key,
            # never null, so that no null test of the key's whole expression is pushed down to the scan
            F.coalesce(F.pmod(F.xxhash64(key), F.lit(salts)), F.lit(0)).alias("_salt"),
            F.explode(key_prefixes(key)).alias("_form"),
        )
    )
    forms = (
        prefixes.where(F.col(prefix) != "")
        .distinct()
        .withColumn("_form", F.explode(_boundary_forms(F.col(prefix))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    )
    # a key has one character after a prefix, so it meets a list entry through one of its forms at most; of a key with a
    # port, forms with it and without it differ from the port on
    return exploded.join(forms, ["_form", "_salt"]).drop("_form", "_salt")


def longest_prefix(
    df: DataFrame,
    key: str,
    prefixes: DataFrame,
    prefix: str,
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """``df`` with the columns of its longest covering prefix, null where none covers it.

    Among equal prefixes the one with the greatest ``tie_break`` wins. Matching is done once per
    distinct key; the result joins back on the key.
    """
    hits = prefix_hits(df, key, prefixes, prefix)
    columns = [c for c in prefixes.columns]
    rank = F.struct(F.length(prefix), *[t.alias(f"_t{i}") for i, t in enumerate(tie_break)])
    best = (
        hits.groupBy(key)
        .agg(F.max_by(F.struct(*columns), rank).alias("_best"))
        .select(key, *[F.col("_best")[c].alias(c) for c in columns])
    )
    return df.join(best, key, "left")


def covered(df: DataFrame, key: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows whose key some prefix covers."""
    return df.join(prefix_hits(df, key, prefixes, prefix).select(key).distinct(), key, "left_semi")


def not_covered(df: DataFrame, key: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows whose key no prefix covers; rows without a key are kept."""
    return df.join(prefix_hits(df, key, prefixes, prefix).select(key).distinct(), key, "left_anti")


def flag_covered(df: DataFrame, key: str, prefixes: DataFrame, prefix: str, out: str) -> DataFrame:
    """``df`` with a boolean: does some prefix cover the key?"""
    hit = prefix_hits(df, key, prefixes, prefix).select(key).distinct().withColumn(out, F.lit(True))
    return df.join(hit, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def effective_access(
    df: DataFrame,
    key: str,
    blocks: DataFrame,
    allows: DataFrame,
    prefix: str = "surt_prefix",
    default: str = "block",
    out: str = "access",
) -> DataFrame:
    """Access per row: the longest covering rule, ``block`` before ``allow`` at equal prefixes, else the default."""
    rules = blocks.select(prefix).withColumn("_access", F.lit("block")).unionByName(
        allows.select(prefix).withColumn("_access", F.lit("allow"))
    )
    found = longest_prefix(df, key, rules, prefix, tie_break=[(F.col("_access") == "block").cast("int")])
    return found.withColumn(out, F.coalesce(F.col("_access"), F.lit(default))).drop("_access").withColumnRenamed(
        prefix, "access_rule"
    )


def annotate(
    df: DataFrame,
    key: str,
    scopes: DataFrame,
    prefix: str,
    labels: Sequence[str],
) -> DataFrame:
    """Attach to each key the distinct labels of all scopes that cover it, as sorted text lists.

    The number of scopes over one key is bounded by the labels a curator gave its prefixes, at most
    one per (prefix, label value), not by the number of captures.
    """
    hits = prefix_hits(df, key, scopes, prefix)
    lists = hits.groupBy(key).agg(
        *[F.array_join(F.array_sort(F.collect_set(label)), "|").alias(label) for label in labels]
    )
    return df.join(lists, key, "left")
