"""Plans and registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import histograms, network, ordered, prefixes
from tidemark.plans.registry import all_queries, runner
from tidemark.plans.tables import TABLE_NAMES, Tables

SAMPLE = [
    "status_histogram", "top_targets", "recent_activity_summary", "running_quota", "low_activity_alerts", "scope_decisions",
    "longest_prefix", "effective_access", "address_location", "closest_capture", "revisit_records", "recently_seen",
    "store_comparison", "checkpoint_gaps", "newest_batches", "documents_found", "hourly_launches", "taxonomy_ancestors",
    "quality_problems", "page_texts", "text_fingerprints", "near_copy_groups", "crawl_log_lines", "stream_status_counts", "take_down",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["status_code", "bucket", "n"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_unique_and_rows_are_named():
    for name, q in all_queries().items():
        assert q.row, name
        assert name == q.run.__name__


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in TABLE_NAMES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, small, name):
    q = all_queries()[name]
    df = runner(q)(spark, small)
    result = duck.execute(q.sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in sorted(columns)) for r in df.collect())
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted(tuple(str(int(r[i]) if hasattr(r[i], "quantize") else r[i]) for i in order) for r in result.fetchall())
    assert got == want and got


@pytest.mark.parametrize(
    "name",
    ["longest_prefix", "never_crawl_filter", "effective_access", "address_location", "surt_keys", "scope_decisions", "page_texts",
     "outlink_hosts", "term_index", "text_fingerprints", "closest_capture", "running_quota", "path_rules", "event_fields"],
)
def test_no_nested_loops_and_no_python(spark, small, name):
    plan = plan_of(runner(all_queries()[name])(spark, small))
    for bad in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, name


def test_day_filter_prunes_partitions(spark, small, tmp_path):
    from tidemark.sinks.exports import write_days
    from tidemark.sources.tables import read_days

    folder = str(tmp_path / "days")
    write_days(Tables(spark, small).crawl_log, "ts", folder)
    assert "PartitionFilters: [isnotnull(day" in plan_of(read_days(spark, folder, "2024-01-03", "2024-01-04"))


def test_scan_reads_only_needed_columns(spark, small):
    plan = plan_of(runner(all_queries()["top_status_codes"])(spark, small))
    assert "html" not in plan and "ReadSchema: struct<event_id:bigint,event_type:string,props:string>" in plan


def test_counts_over_time_read_the_rows_once(spark, small):
    """Bounds, terms and zeros come from the written counts: the events are read for these alone, by one stage."""
    reads = spark.sparkContext.accumulator(0)
    rows = spark.read.parquet(f"{small}/events.parquet")

    def seen(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    watched = rows.select("ts", "event_type").mapInPandas(seen, "ts timestamp_ntz, event_type string")
    out = histograms.counts_over_time(watched, "ts", 3600, ["event_type"])
    assert out.count() > 0 and "FileScan" not in plan_of(out)
    assert reads.value == rows.count()


def test_hot_key_is_spread_over_tasks(spark):
    """All rows have one key; bucketed operators still use many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(20_000).select(
            F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 30).cast("timestamp_ntz").alias("ts"), "id"
        )
        for out in (
            ordered.running_total(df, ["key"], ["ts", "id"], F.lit(1), "x"),
            ordered.nearest_value(df, ["key"], ["ts", "id"], F.col("id"), "x", "y"),
            ordered.trailing_sum(df, ["key"], "ts", "id", 7200, "x"),
        ):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert len(sizes) == 4 and max(sizes) < 10_000
        keys = spark.range(4000).select(F.concat(F.lit("uk,co,x"), "id", F.lit(")/a")).alias("key"))
        listed = spark.createDataFrame([("uk,",)], "prefix string")
        hits = prefixes.prefix_hits(keys, "key", listed, "prefix")
        assert hits.count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_address_block_with_many_clients(spark):
    clients = spark.range(30_000).select(F.lit("192.0.2.7").alias("ip"), "id")
    lists = spark.createDataFrame([("a", "192.0.2.0/24"), ("b", "192.0.2.0/28")], "name string, ips string")
    found = network.lookup_ranges(clients, "ip", network.cidr_ranges(lists, "ips", ["name"]), ["name"])
    assert found.where("name = 'b'").count() == 30_000
