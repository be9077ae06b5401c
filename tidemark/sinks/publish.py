"""Publishing a set of outputs as a whole, and collection aliases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.curation import union_collections


def create_alias(spark: SparkSession, name: str, collections: dict[str, DataFrame]) -> None:
    """Create or replace one logical name over several collections."""
    union_collections(collections).createOrReplaceTempView(name)


def publish_all(outputs: dict[str, DataFrame], root: str, minimum_rows: dict[str, int] | None = None) -> DataFrame:
    """Write every output into a new version folder and list it in the manifest only if all are whole.

    Readers follow the manifest, which gets one small file appended as the last step, so they see either all new
    outputs or all old ones. A failed run leaves an unlisted folder behind. Row counts are observed
    while writing, not by a second scan. Returns (version, output, rows, path).
    """
    from pyspark.sql import Observation

    spark = next(iter(outputs.values())).sparkSession
    version = uuid.uuid4().hex
    rows = []
    for name, df in outputs.items():
        seen = Observation(f"{name}_{version}")
        path = f"{root}/versions/{version}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(path)
        count = int(seen.get["n"])
        if count < (minimum_rows or {}).get(name, 0):
            raise ValueError(f"{name}: {count} rows are too few; nothing was published")
        rows.append((version, name, count, path))
    manifest = spark.createDataFrame(rows, "version string, output string, rows bigint, path string")
    manifest.coalesce(1).withColumn("published_at", F.current_timestamp()).write.mode("append").json(f"{root}/manifest")
    return manifest


def current_version(spark: SparkSession, root: str) -> DataFrame:
    """(output, rows, path) of the last version that was published whole."""
    listed = spark.read.schema(
        "version string, output string, rows bigint, path string, published_at timestamp"
    ).json(f"{root}/manifest")
    newest = listed.select(F.max_by("version", F.struct("published_at", "version"))).scalar()
    return listed.where(F.col("version") == newest).select("version", "output", "rows", "path")


def read_published(spark: SparkSession, root: str, output: str) -> DataFrame:
    """The current version of one output."""
    path = current_version(spark, root).where(F.col("output") == output).first()
    if path is None:
        raise ValueError(f"{output!r} was never published")
    return spark.read.parquet(path["path"])
