"""Shared steps: given tables, tables written to the shared folder, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_dir

SPACE = "\x20\x09-\x0d"
WORD = rf"[^{SPACE}]+"
# A joined side of at most this many narrow rows is broadcast; a larger one is left to a shuffled join.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Types that fields() knows, by their SQL names.
_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "longs": T.ArrayType(T.LongType())}


def fields(listed: str) -> T.StructType:
    """A struct type from ``name type, ...``; unlike a SQL string it needs no running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, listed.split(","))])


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage and survives lost executors.

    Results may still read these tables after an operator has returned, so they stay until the folder is cleared like any checkpoints.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a stored, narrow table only if its counted rows stay under ``max_rows``."""
    return F.broadcast(df) if df.count() <= max_rows else df


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it (letter case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each linked node with the least node it can reach. Nodes without links are absent.

    Distributed union-find: every round lowers each node's root to the least root among its
    neighbours, hooks the old roots to it, and follows the root of the root. The state of a round is written to the shared
    folder; only a count of changed rows reaches the driver. A node of any degree costs one partial minimum
    per task. Null ends are ignored; repeated links and links to itself do no harm.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = stored(ends.union(ends.select("y", "x")).distinct(), "links")
    state = stored(edges.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("root")), "roots")
    while True:
        heard = (
            edges.join(state.select(F.col("x").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("heard"))
        )
        lowered = state.join(heard, "x").select("x", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        # a root that any of its members has left follows the least root its members found
        hooked = lowered.groupBy(F.col("old").alias("at")).agg(F.min("root").alias("hook"))
        onward = lowered.join(hooked, F.col("root") == F.col("at"), "left").select(
            "x", "old", F.least(F.col("root"), F.coalesce("hook", "root")).alias("root")
        )
        after = stored(onward, "roots")
        if after.where("root <> old").isEmpty():
            return after.select(F.col("x").alias("node"), F.col("root").alias("component"))
        state = after.select("x", "root")
