"""Streaming queries, run to the end of the events table and compared with plain SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import bloom, documents, prefixes, scope
from tidemark.operators.filters import http_responses
from tidemark.plans.curated import _FOUND, _watched
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.plans.urls import _ACCEPTING, _SCOPE
from tidemark.plans.views import SHARED_TEXT
from tidemark.session import shared_dir
from tidemark.streaming import feeds, gates, intake


def _stream(t: Tables, view: str | None = None) -> DataFrame:
    """The events table (or a view derived from it) as a stream."""
    events = intake.file_stream(t.spark, f"{t.folder}/event[s].parquet", t.events.schema)
    return t.spark.sql(SHARED_TEXT[view], events=events) if view else events


def _folders(t: Tables, name: str, *parts: str) -> list[str]:
    root = shared_dir(t.spark, name)
    return [f"{root}/{part}" for part in parts]


@query(
    "stream_daily_tail",
    "T1 S2 S3 K6",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_id) AS events, CAST(sum(size) AS BIGINT) AS bytes FROM crawl_log GROUP BY 1",
)
def stream_daily_tail(t: Tables):
    out, checkpoint = _folders(t, "daily-tail", "days", "checkpoint")
    intake.tail_to_days(_stream(t, "crawl_log"), "ts", out, checkpoint, available_now=True).awaitTermination()
    return (
        t.spark.read.parquet(out)
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"), F.sum("size").alias("bytes"))
    )


@query(
    "stream_status_counts",
    "T2",
    """
    SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, status_code, count(*) AS n
    FROM crawl_log GROUP BY 1, 2, 3 HAVING time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)
    """,
)
def stream_status_counts(t: Tables):
    out, checkpoint = _folders(t, "status-counts", "out", "checkpoint")
    counts = intake.windowed_counts(_stream(t, "crawl_log"), "ts", ["status_code"], "1 day", "1 hour")
    intake.append_to(counts, out, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.parquet(out)


@query(
    "stream_host_counts",
    "T2",
    """
    WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - to_hours(CAST(6 * s AS INTEGER)) AS window_start, host FROM crawl_log, range(0, 4) r(s))
    SELECT window_start, window_start + INTERVAL '1 day' AS window_end, host, count(*) AS n FROM w GROUP BY 1, 2, 3
    HAVING window_start + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)
    """,
)
def stream_host_counts(t: Tables):
    out, checkpoint = _folders(t, "host-counts", "out", "checkpoint")
    counts = intake.windowed_counts(_stream(t, "crawl_log"), "ts", ["host"], "1 day", "1 hour", "6 hours")
    intake.append_to(counts, out, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.parquet(out)


@query(
    "stream_rolling_summary",
    "T3 K12",
    """
    WITH m AS (SELECT *, time_bucket(INTERVAL '1 minute', ts) AS minute FROM crawl_log),
    r AS (SELECT * FROM m WHERE minute > (SELECT max(minute) FROM m) - INTERVAL '2 days')
    SELECT 'total' AS dimension, CAST(NULL AS VARCHAR) AS value, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM r
    UNION ALL SELECT 'host', host, count(*), CAST(sum(size) AS BIGINT) FROM r GROUP BY host
    UNION ALL SELECT 'mimetype', mimetype, count(*), CAST(sum(size) AS BIGINT) FROM r GROUP BY mimetype
    """,
)
def stream_rolling_summary(t: Tables):
    partials, summary, checkpoint = _folders(t, "summary", "partials", "summary", "checkpoint")
    feeds.rolling_summary(
        _stream(t, "crawl_log"), "ts", ["host", "mimetype"], "size", 2 * 86_400, partials, summary, checkpoint, available_now=True
    ).awaitTermination()
    return feeds.read_summary(summary, t.spark)


@query(
    "stream_unique_events",
    "T4",
    "SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y%m%d%H') || ':' || url AS message_id FROM crawl_log",
)
def stream_unique_events(t: Tables):
    """Repeats of one URL within the hour count as one event; only identities are compared."""
    out, checkpoint = _folders(t, "unique-events", "out", "checkpoint")
    log = _stream(t, "crawl_log").withColumn(
        "message_id", F.concat_ws(":", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHH"), "url")
    )
    unique = intake.drop_repeats(log, "ts", ["message_id"], "40 days").select("message_id")
    intake.append_to(unique, out, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_first_seen", "T8", "SELECT DISTINCT url FROM crawl_log")
def stream_first_seen(t: Tables):
    out, checkpoint = _folders(t, "first-seen", "out", "checkpoint")
    seen = intake.first_seen(_stream(t, "crawl_log").select("url"), "url")
    intake.append_to(seen, out, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.parquet(out)


# Of the filter that stands for the crawl's: keys it is made for, and the rate at which it may miss a new one.
SEEN_CAPACITY, SEEN_RATE = 1_000_000, 1e-9


@query("stream_first_seen_bounded", "T8 A15", "SELECT DISTINCT urlkey FROM captures")
def stream_first_seen_bounded(t: Tables):
    """The keys of A15 from a stream whose state is a filter of fixed size."""
    out, checkpoint = _folders(t, "first-seen-bounded", "out", "checkpoint")
    gates.use_rocksdb(t.spark)
    keyed = http_responses(_stream(t, "crawl_log")).select(urls.surt_key("url").alias("urlkey"))
    seen = gates.first_seen_bounded(keyed, "urlkey", bloom.Shape.of(SEEN_CAPACITY, SEEN_RATE), shards=8)
    intake.append_to(seen, out, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.parquet(out)


@query("unseen_urls", "A15 T8", "SELECT DISTINCT urlkey FROM captures EXCEPT SELECT urlkey FROM captures WHERE event_id % 3 = 0 OR status_code = 404")
def unseen_urls(t: Tables):
    """Two crawls' filters, merged; the keys that neither has seen."""
    shape = bloom.Shape.of(SEEN_CAPACITY, SEEN_RATE)
    one = bloom.build_filter(t.captures.where("event_id % 3 = 0"), "urlkey", shape)
    other = bloom.build_filter(t.captures.where("status_code = 404"), "urlkey", shape)
    return bloom.not_in_filter(t.captures, "urlkey", bloom.merge_filters(one, other), shape)


@query(
    "stream_scope_split",
    "T9 T10",
    _SCOPE
    + f"SELECT event_id, rule, CASE WHEN rule IN {_ACCEPTING} THEN 'frequent' END AS crawl_name FROM decided",
)
def stream_scope_split(t: Tables):
    accepted, discarded, checkpoint = _folders(t, "scope-split", "accepted", "discarded", "checkpoint")
    in_scope, shut = t.scope_accept, t.scope_exclude

    def decide(batch: DataFrame) -> DataFrame:
        keyed = batch.withColumn("urlkey", urls.surt_key("url"))
        keyed = prefixes.flag_covered(keyed, "urlkey", in_scope, "surt_prefix", "in_scope")
        keyed = prefixes.flag_covered(keyed, "urlkey", shut, "surt_prefix", "shut")
        verdict = scope.decide(scope.standard_rules("url", "hop_path", F.col("in_scope"), F.col("shut")))
        return keyed.select("event_id", "url", verdict.alias("v")).select("event_id", "url", "v.*")

    feeds.split_by_scope(
        _stream(t, "url_case"), decide, accepted, discarded, checkpoint, "frequent", available_now=True
    ).awaitTermination()
    left = t.spark.read.parquet(accepted).select("event_id", "rule", "crawl_name")
    right = t.spark.read.parquet(discarded).select("event_id", "rule")
    return left.unionByName(right, allowMissingColumns=True)


@query("stream_documents", "T11", _FOUND + "SELECT * FROM found")
def stream_documents(t: Tables):
    out, checkpoint = _folders(t, "documents", "out", "checkpoint")
    watched = _watched(t)

    def find(batch: DataFrame) -> DataFrame:
        events = batch.withColumns(
            {
                "landing_page_url": F.expr("concat('http://', host, '/p/', event_id % 7)"),
                "source": F.col("hop_path"),
            }
        )
        return documents.find_documents(events, watched, "surt_prefix", "target_id", "frequent-npld")

    feeds.spot_documents(_stream(t, "crawl_log"), find, out, checkpoint, available_now=True).awaitTermination()
    return feeds.read_documents(out, t.spark)


@query(
    "stream_activity_alerts",
    "T12 W3",
    """
    WITH h AS (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 20:00:00', INTERVAL '1 hour')) AS ts),
    f AS (SELECT h.ts, count(e.event_id) AS n FROM h LEFT JOIN events e ON e.event_type = 'error' AND time_bucket(INTERVAL '1 hour', e.ts) = h.ts GROUP BY 1),
    i AS (SELECT ts, sum(n) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 14399 SECONDS PRECEDING AND CURRENT ROW) AS increase FROM f),
    g AS (SELECT *, increase < 10 AS low, sum(CASE WHEN increase < 10 THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS run FROM i)
    SELECT min(ts) AS since, max(ts) AS until, count(*) AS samples FROM g WHERE low GROUP BY run HAVING max(ts) - min(ts) >= INTERVAL '60 minutes'
    """,
)
def stream_activity_alerts(t: Tables):
    out, checkpoint = _folders(t, "alerts", "out", "checkpoint")
    counts = intake.windowed_counts(_stream(t).where("event_type = 'error'"), "ts", [], "1 hour", "1 hour")
    intake.append_to(counts, out, checkpoint, available_now=True).awaitTermination()
    hourly = t.spark.read.parquet(out).select(F.col("window_start").alias("ts"), "n").where("ts < '2024-01-30 20:00:00'")
    first = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    last = F.lit("2024-01-30 19:00:00").cast("timestamp_ntz")
    return feeds.activity_alerts(hourly, "ts", "n", first, last)


@query(
    "stream_silence_alerts",
    "T12 W3",
    """
    WITH e AS (SELECT event_type AS series, time_bucket(INTERVAL '1 hour', ts) AS step_at FROM events WHERE event_type IN ('error', 'signup')),
    s AS (SELECT series, unnest(range(min(step_at), (SELECT max(ts) - INTERVAL '2 hours' FROM events) + INTERVAL '1 microsecond', INTERVAL '1 hour')) AS step_at FROM e GROUP BY series),
    f AS (SELECT s.series, s.step_at, count(e.step_at) AS n FROM s LEFT JOIN e ON e.series = s.series AND e.step_at = s.step_at GROUP BY 1, 2),
    i AS (SELECT *, sum(n) OVER (PARTITION BY series ORDER BY step_at ROWS 3 PRECEDING) < 10 AS low FROM f),
    g AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY step_at) AS run, max(step_at) OVER (PARTITION BY series) AS final FROM i),
    r AS (SELECT series, min(step_at) AS since, max(step_at) AS until, count(*) AS samples, any_value(final) AS final FROM g WHERE low GROUP BY series, run)
    SELECT series, 'firing' AS state, since, since + INTERVAL '1 hour' AS reached, CAST(2 AS BIGINT) AS samples FROM r WHERE until - since >= INTERVAL '1 hour'
    UNION ALL SELECT series, 'resolved', since, until, samples FROM r WHERE until - since >= INTERVAL '1 hour' AND until < final
    """,
)
def stream_silence_alerts(t: Tables):
    """Alerts as the running query gives them out, for two kinds of event."""
    out, checkpoint = _folders(t, "silence-alerts", "out", "checkpoint")
    gates.use_rocksdb(t.spark)
    alerts = gates.silence_alerts(_stream(t), "ts", F.col("event_type"), F.col("event_type").isin("error", "signup"), "1 hour")
    intake.append_to(alerts, out, checkpoint, available_now=True).awaitTermination()
    found = t.spark.read.parquet(out)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "reached")})


@query(
    "recent_days_kept",
    "T13",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-31' - 10 GROUP BY 1",
)
def recent_days_kept(t: Tables):
    days = t.events.withColumn("day", F.to_date("ts"))
    return intake.keep_recent(days, "day", date(2024, 1, 31), 10).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_recrawl_gate",
    "T6",
    """
    WITH RECURSIVE k AS (SELECT event_id, ts, 'uk,co,example,h' || (user_id % 20) || ')/p/' || (event_id % 5) AS urlkey FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY urlkey ORDER BY ts, event_id) AS rn FROM k),
    g AS (SELECT urlkey, rn, event_id, ts AS last, TRUE AS passed FROM o WHERE rn = 1
      UNION ALL SELECT o.urlkey, o.rn, o.event_id, CASE WHEN o.ts - g.last >= INTERVAL '5 days' THEN o.ts ELSE g.last END, o.ts - g.last >= INTERVAL '5 days'
      FROM g JOIN o ON o.urlkey = g.urlkey AND o.rn = g.rn + 1)
    SELECT event_id, urlkey, passed FROM g
    """,
)
def stream_recrawl_gate(t: Tables):
    out, checkpoint = _folders(t, "recrawl-gate", "out", "checkpoint")
    gates.use_rocksdb(t.spark)
    keyed = intake.event_time(_stream(t)).selectExpr(
        "event_id", "ts", "concat('uk,co,example,h', user_id % 20, ')/p/', event_id % 5) AS urlkey"
    )
    passed = gates.recrawl_gate(keyed, 5 * 86_400)
    intake.append_to(passed, out, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.parquet(out)


_QUOTA = """
    WITH l AS (SELECT *, url LIKE '%/p/0' AS launched, CASE WHEN status_code BETWEEN 200 AND 299 THEN size ELSE 0 END AS ok FROM crawl_log),
    n AS (SELECT *, sum(CASE WHEN launched THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, event_id) AS launch_no FROM l),
    u AS (SELECT *, CAST(coalesce(sum(ok) OVER (PARTITION BY host, launch_no ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_bytes FROM n)
    SELECT event_id, host, used_bytes, used_bytes >= 500 * 1024 AND NOT regexp_matches(hop_path, '^PR*$') AS capped FROM u
"""


def _quota_gate(t: Tables, name: str, delay: str | None) -> DataFrame:
    out, state, checkpoint = _folders(t, name, "out", "state", "checkpoint")
    gates.use_rocksdb(t.spark)
    events = _stream(t, "crawl_log").select(
        "event_id", "host", "ts", "status_code", "size", "hop_path", F.col("url").like("%/p/0").alias("launched")
    )
    gates.quota_gate(events, 500, out, state, checkpoint, available_now=True, bucket_seconds=21_600, delay=delay).awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "host", "used_bytes", "capped")


@query("stream_quota_gate", "T7 W5", _QUOTA)
def stream_quota_gate(t: Tables):
    return _quota_gate(t, "quota-gate", None)


@query(
    "stream_quota_gate_held",
    "T7 W5",
    _QUOTA + " WHERE time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)",
)
def stream_quota_gate_held(t: Tables):
    """Rows are held until their server's six hours are closed, so late ones take their place in time."""
    return _quota_gate(t, "quota-gate-held", "1 hour")
