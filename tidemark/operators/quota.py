"""Download quotas per server."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import by_bucket
from tidemark.operators.scope import bypasses_quota

# Default quotas in KB; -1 switches a quota off.
SERVER_MAX_SUCCESS_KB = 524_288
HOST_MAX_SUCCESS_KB = -1


def success_bytes(status: str, size: str):
    """Bytes that count against a quota: those of successful responses."""
    return F.when(F.col(status).between(200, 299), F.col(size)).otherwise(F.lit(0)).cast("bigint")


def server_volume(df: DataFrame, server: str, status: str, size: str, max_kb: int = SERVER_MAX_SUCCESS_KB) -> DataFrame:
    """Successful KB per server and whether the quota is used up."""
    volume = F.sum(success_bytes(status, size))
    over = F.lit(False) if max_kb < 0 else F.col("success_bytes") >= F.lit(max_kb * 1024)
    return df.groupBy(server).agg(volume.alias("success_bytes")).withColumn("over_quota", over)


def running_quota(
    df: DataFrame,
    server: str,
    ts: str,
    row_id: str,
    status: str,
    size: str,
    hop_path: str,
    is_launch: str,
    max_kb: int = SERVER_MAX_SUCCESS_KB,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Each event with the bytes its server had used before it and whether the quota stops it.

    A launch row clears the quota of its server from itself on; prerequisites are never stopped.

    Bytes never fall, so the bytes used since the last launch are the bytes used so far minus the greatest total
    any launch saw. Sum, launch count and that greatest total are all taken within (server, time bucket) in
    one pass, and one summary row per bucket carries them along the server.
    """
    rows = by_bucket(df, [server], ts, bucket_seconds).withColumns(
        {
            "_bytes": success_bytes(status, size),
            "_launch": F.coalesce(F.col(is_launch).cast("int"), F.lit(0)),
        }
    )
    so_far = Window.partitionBy("_key", "_bucket").orderBy(ts, row_id).rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        rows.withColumn("_sum", F.sum("_bytes").over(so_far) - F.col("_bytes"))
        .withColumn("_launches", F.sum("_launch").over(so_far))
        .withColumn("_base", F.max(F.when(F.col("_launch") == 1, F.col("_sum"))).over(so_far))
    )
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        inside.groupBy("_key", "_bucket")
        .agg(F.sum("_bytes").alias("_b"), F.sum("_launch").alias("_n"), F.max("_base").alias("_m"))
        .withColumn("_sum0", F.coalesce(F.sum("_b").over(earlier), F.lit(0)))
        .withColumn("_launches0", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_base0", F.coalesce(F.max(F.col("_sum0") + F.col("_m")).over(earlier), F.lit(0)))
        .select("_key", "_bucket", "_sum0", "_launches0", "_base0")
    )
    base = F.coalesce(F.col("_sum0") + F.col("_base"), F.col("_base0"))
    used = (
        inside.join(carried, ["_key", "_bucket"], "left")
        .withColumn("launch_no", F.col("_launches0") + F.col("_launches"))
        .withColumn("used_bytes", F.col("_sum0") + F.col("_sum") - base)
        .select(*df.columns, "launch_no", "used_bytes")
    )
    full = F.lit(False) if max_kb < 0 else F.col("used_bytes") >= F.lit(max_kb * 1024)
    return used.withColumn("capped", full & ~bypasses_quota(hop_path))
