"""Crawl activity: event lists, histograms, totals, counters, quotas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import crawl_fields as cf
from tidemark.functions.times import bucket_start
from tidemark.operators import counters, curation, filters, histograms, quota, tracking
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables

CAPPED = "Q:serverMaxSuccessKb"


def _events(t: Tables):
    """Crawl log with the annotation list as an array."""
    return t.crawl_log.withColumn("annotations", cf.annotation_list("annotations"))


@query(
    "status_histogram",
    "A1 F24 P5",
    """
    SELECT s.status_code, b.bucket, CAST(count(e.event_id) AS BIGINT) AS n
    FROM (SELECT DISTINCT status_code FROM crawl_log) s
    CROSS JOIN (SELECT unnest(range(time_bucket(INTERVAL '1 hour', min(ts)), max(ts), INTERVAL '1 hour')) AS bucket FROM events) b
    LEFT JOIN crawl_log e ON e.status_code = s.status_code AND time_bucket(INTERVAL '1 hour', e.ts) = b.bucket
    GROUP BY 1, 2
    """,
)
def status_histogram(t: Tables):
    return histograms.counts_over_time(t.crawl_log, "ts", 3600, ["status_code"])


_TOP_OVER_TIME = """
    WITH picked AS (SELECT * FROM crawl_log WHERE {where}),
    top AS (SELECT host FROM picked GROUP BY host ORDER BY count(*) DESC, host LIMIT {n}),
    kept AS (SELECT * FROM picked WHERE host IN (SELECT host FROM top)),
    buckets AS (SELECT unnest(range(date_trunc('day', min(ts)), max(ts), INTERVAL '1 day')) AS bucket FROM kept)
    SELECT t.host, b.bucket, CAST(count(k.event_id) AS BIGINT) AS n
    FROM top t CROSS JOIN buckets b LEFT JOIN kept k ON k.host = t.host AND date_trunc('day', k.ts) = b.bucket
    GROUP BY 1, 2
"""


@query("top_hosts_over_time", "A2", _TOP_OVER_TIME.format(where="TRUE", n=10))
def top_hosts_over_time(t: Tables):
    return histograms.top_terms_over_time(t.crawl_log, "host", 10, "ts", 86_400)


@query("capped_hosts_over_time", "A2 P4", _TOP_OVER_TIME.format(where=f"annotations = '{CAPPED}'", n=20))
def capped_hosts_over_time(t: Tables):
    capped = _events(t).where(cf.has_annotation("annotations", CAPPED))
    return histograms.top_terms_over_time(capped, "host", 20, "ts", 86_400)


_OVER_TIME = """
    WITH picked AS (SELECT * FROM crawl_log WHERE {where}),
    buckets AS (SELECT unnest(range(date_trunc('day', min(ts)), max(ts), INTERVAL '1 day')) AS bucket FROM picked)
    SELECT b.bucket, CAST(count(p.event_id) AS BIGINT) AS n
    FROM buckets b LEFT JOIN picked p ON date_trunc('day', p.ts) = b.bucket GROUP BY 1
"""


@query("seed_events_over_time", "A3 P2", _OVER_TIME.format(where="hop_path = '' AND thread IS NOT NULL"))
def seed_events_over_time(t: Tables):
    return histograms.counts_over_time(filters.seed_events(t.crawl_log), "ts", 86_400)


@query("responses_over_time", "A3 P3", _OVER_TIME.format(where="status_code BETWEEN 1 AND 600"))
def responses_over_time(t: Tables):
    return histograms.counts_over_time(filters.http_responses(t.crawl_log), "ts", 86_400)


@query("capped_over_time", "A3 P4", _OVER_TIME.format(where=f"annotations = '{CAPPED}'"))
def capped_over_time(t: Tables):
    capped = _events(t).where(cf.has_annotation("annotations", CAPPED))
    return histograms.counts_over_time(capped, "ts", 86_400)


@query(
    "top_status_codes",
    "A4",
    "SELECT status_code, count(*) AS n FROM crawl_log WHERE hop_path = '' AND thread IS NOT NULL"
    " GROUP BY 1 ORDER BY n DESC, status_code LIMIT 10",
)
def top_status_codes(t: Tables):
    return histograms.top_terms(filters.seed_events(t.crawl_log), "status_code", 10)


_DOC_STATUS = "(VALUES (0,'New'),(1,'Saved'),(2,'Submitted'),(3,'Ignored'),(4,'Deleted')) m(code, status_name)"


@query(
    "documents_per_day",
    "A5 J1 F24",
    f"""
    WITH named AS (SELECT d.id, d.updated_at, m.status_name FROM document d JOIN {_DOC_STATUS} ON d.status = m.code),
    days AS (SELECT unnest(range(date_trunc('day', min(updated_at)), max(updated_at) + INTERVAL '1 second', INTERVAL '1 day')) AS bucket FROM named)
    SELECT s.status_name, b.bucket, CAST(count(n.id) AS BIGINT) AS n
    FROM (SELECT DISTINCT status_name FROM named) s CROSS JOIN days b
    LEFT JOIN named n ON n.status_name = s.status_name AND date_trunc('day', n.updated_at) = b.bucket GROUP BY 1, 2
    """,
)
def documents_per_day(t: Tables):
    # five rows of fixed names
    names = F.broadcast(curation.status_names(t.spark))
    named = t.document.join(names, F.col("status") == F.col("code"))
    return histograms.counts_over_time(named, "updated_at", 86_400, ["status_name"], counted="id")


@query(
    "document_status_totals",
    "A6 J1",
    f"SELECT m.status_name, count(d.id) AS n FROM document d JOIN {_DOC_STATUS} ON d.status = m.code GROUP BY 1",
)
def document_status_totals(t: Tables):
    names = F.broadcast(curation.status_names(t.spark))
    return histograms.status_totals(t.document, "status", names, "code", "status_name", "id")


@query(
    "top_targets",
    "A7 J2",
    """
    SELECT n.n_name AS target, count(*) AS n FROM document d JOIN customer c ON d.id_watched_target = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1 ORDER BY n DESC, target LIMIT 20
    """,
)
def top_targets(t: Tables):
    joined = t.document.join(t.customer, F.col("id_watched_target") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return histograms.top_terms(joined.select(F.col("n_name").alias("target")), "target", 20)


@query(
    "output_record_counts",
    "A8 K9",
    """
    SELECT 'record_count' AS metric, 'feed_npld' AS kind, count(*) AS value FROM curated_base WHERE basis = 'npld'
    UNION ALL SELECT 'record_count', 'feed_bypm', count(*) FROM curated_base WHERE basis = 'bypm'
    UNION ALL SELECT 'record_count', 'never_crawl', count(*) FROM curated_base WHERE frequency = 'NEVERCRAWL'
    UNION ALL SELECT 'record_count', 'allows', count(*) FROM curated_base WHERE open_access
    """,
)
def output_record_counts(t: Tables):
    base = t.curated_base
    return counters.record_count_metrics(
        {
            "feed_npld": base.where("basis = 'npld'"),
            "feed_bypm": base.where("basis = 'bypm'"),
            "never_crawl": base.where("frequency = 'NEVERCRAWL'"),
            "allows": base.where("open_access"),
        }
    )


@query(
    "job_metrics",
    "A11 K9",
    """
    WITH j AS (SELECT host AS job, CASE WHEN status_code > 0 THEN 'success' ELSE 'failure' END AS status, count(*) AS b,
               CAST(sum(size) AS BIGINT) AS s, CAST(floor(epoch(max(ts))) AS BIGINT) AS e FROM crawl_log GROUP BY 1, 2)
    SELECT job, status, 'task_batch_size' AS metric, b AS value FROM j
    UNION ALL SELECT job, status, 'task_total_sent_record_count', s FROM j
    UNION ALL SELECT job, status, 'task_event_timestamp', e FROM j
    """,
)
def job_metrics(t: Tables):
    runs = t.crawl_log.select(
        F.col("host").alias("job"),
        F.when(F.col("status_code") > 0, "success").otherwise("failure").alias("status"),
        "ts",
        "size",
    )
    return counters.job_metrics(runs, "job", "status", "ts", "size")


@query(
    "recent_activity_summary",
    "A12",
    """
    WITH r AS (SELECT * FROM crawl_log WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '2 days')
    SELECT 'total' AS dimension, CAST(NULL AS VARCHAR) AS value, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM r
    UNION ALL SELECT 'host', host, count(*), CAST(sum(size) AS BIGINT) FROM r GROUP BY host
    UNION ALL SELECT 'status_code', CAST(status_code AS VARCHAR), count(*), CAST(sum(size) AS BIGINT) FROM r GROUP BY status_code
    UNION ALL SELECT 'mimetype', mimetype, count(*), CAST(sum(size) AS BIGINT) FROM r GROUP BY mimetype
    """,
)
def recent_activity_summary(t: Tables):
    now = t.events.select(F.max("ts")).scalar()
    return histograms.activity_summary(t.crawl_log, "ts", 2 * 86_400, now, ["host", "status_code", "mimetype"], "size")


@query(
    "server_volume",
    "A13 F4",
    """
    SELECT 'http://' || host || ':80' AS server,
     CAST(sum(CASE WHEN status_code BETWEEN 200 AND 299 THEN size ELSE 0 END) AS BIGINT) AS success_bytes,
     sum(CASE WHEN status_code BETWEEN 200 AND 299 THEN size ELSE 0 END) >= 10000 * 1024 AS over_quota
    FROM crawl_log GROUP BY host
    """,
)
def server_volume(t: Tables):
    from tidemark.functions.urls import url_server

    return quota.server_volume(
        t.crawl_log.withColumn("server", url_server("url")), "server", "status_code", "size", max_kb=10_000
    )


@query(
    "running_quota",
    "W5 P13",
    """
    WITH l AS (SELECT *, url LIKE '%/p/0' AS launched FROM crawl_log),
    n AS (SELECT *, CAST(sum(CASE WHEN launched THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, event_id) AS BIGINT) AS launch_no FROM l),
    u AS (SELECT *, CAST(coalesce(sum(CASE WHEN status_code BETWEEN 200 AND 299 THEN size ELSE 0 END) OVER (
          PARTITION BY host, launch_no ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_bytes FROM n)
    SELECT event_id, host, launch_no, used_bytes,
     used_bytes >= 500 * 1024 AND NOT regexp_matches(hop_path, '^PR*$') AS capped FROM u
    """,
)
def running_quota(t: Tables):
    events = t.crawl_log.withColumn("launched", F.col("url").like("%/p/0"))
    out = quota.running_quota(
        events, "host", "ts", "event_id", "status_code", "size", "hop_path", "launched", max_kb=500, bucket_seconds=21_600
    )
    return out.select("event_id", "host", "launch_no", "used_bytes", "capped")


@query(
    "event_columns",
    "P1",
    "SELECT ts, status_code, url, host, mimetype, size FROM crawl_log",
)
def event_columns(t: Tables):
    hidden = ["event_id", "hop_path", "thread", "annotations", "content_digest", "no_such_column"]
    return filters.choose_columns(t.crawl_log, hidden, ["ts", "status_code", "url", "not_here", "host", "mimetype"])


@query("seed_event_list", "P2", "SELECT event_id, url, thread FROM crawl_log WHERE hop_path = '' AND thread IS NOT NULL")
def seed_event_list(t: Tables):
    return filters.seed_events(t.crawl_log).select("event_id", "url", "thread")


@query(
    "events_in_range",
    "P5",
    "SELECT event_id, ts, url FROM crawl_log WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 00:00:00'",
)
def events_in_range(t: Tables):
    picked = filters.between_times(t.crawl_log, "ts", datetime(2024, 1, 10, 6), datetime(2024, 1, 12))
    return picked.select("event_id", "ts", "url")


@query(
    "ad_hoc_filter",
    "P25",
    "SELECT event_id, host, status_code FROM crawl_log WHERE status_code <> 404 AND regexp_matches(host, '^h1[0-9]') AND size > 20000",
)
def ad_hoc_filter(t: Tables):
    tests = [("status_code", "!=", 404), ("host", "=~", "^h1[0-9]"), ("size", ">", 20_000)]
    return filters.ad_hoc(t.crawl_log, tests).select("event_id", "host", "status_code")


@query(
    "infected_split",
    "P18",
    """
    SELECT CASE WHEN regexp_matches(annotations, '^.*stream:.+FOUND.*$') THEN 'viral' ELSE 'warcs' END AS folder,
     count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM crawl_log GROUP BY 1
    """,
)
def infected_split(t: Tables):
    clean, infected = filters.split_infected(_events(t))
    both = clean.withColumn("folder", F.lit("warcs")).unionByName(infected.withColumn("folder", F.lit("viral")))
    return both.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(
    "latest_events",
    "L1",
    "SELECT event_id, ts, url, status_code FROM crawl_log ORDER BY ts DESC, event_id LIMIT 500",
)
def latest_events(t: Tables):
    return filters.latest_rows(t.crawl_log, 500, "ts", "event_id").select("event_id", "ts", "url", "status_code")


@query(
    "event_fields",
    "F5 F6 F7 F8 F23",
    """
    SELECT event_id, TIMESTAMP '2024-01-01 00:00:00.250' + to_seconds(CAST(event_id % 3600 AS BIGINT)) AS started, CAST(event_id % 5000 AS BIGINT) AS duration,
     len(list_filter(string_split(annotations, ','), lambda a: trim(a) <> '')) AS n_annotations,
     annotations = 'Q:serverMaxSuccessKb' AS capped,
     CASE WHEN starts_with(annotations, 'Q:') THEN substr(annotations, 3) END AS quota_name,
     json_extract_string(e.props, '$.k') AS extra_k,
     CAST(length(hop_path) AS INTEGER) AS depth, right(hop_path, 1) AS last_hop, hop_path = '' AS is_seed,
     CASE WHEN status_code BETWEEN 1 AND 600 THEN CAST(status_code // 100 AS VARCHAR) || 'xx' ELSE 'internal' END AS status_class
    FROM crawl_log JOIN (SELECT event_id, props FROM events) e USING (event_id)
    """,
)
def event_fields(t: Tables):
    log = t.crawl_log.join(t.events.select("event_id", "props"), "event_id")
    started = F.date_format(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("event_id") % 3600), "yyyyMMddHHmmss"
    )
    text = F.concat(started, F.lit("250+"), (F.col("event_id") % 5000).cast("string"))
    annotations = cf.annotation_list("annotations")
    return log.select(
        "event_id",
        cf.start_time(text).alias("started"),
        cf.duration_ms(text).alias("duration"),
        F.size(annotations).cast("bigint").alias("n_annotations"),
        cf.has_annotation(annotations, CAPPED).alias("capped"),
        cf.annotation_value(annotations, "Q:").alias("quota_name"),
        cf.extra_info("props")["k"].alias("extra_k"),
        cf.hop_depth("hop_path").alias("depth"),
        cf.last_hop("hop_path").alias("last_hop"),
        cf.is_seed_hop("hop_path").alias("is_seed"),
        cf.status_class("status_code").alias("status_class"),
    )


@query(
    "time_buckets",
    "F24",
    "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS quarter, time_bucket(INTERVAL '6 hours', ts) AS quarter_day FROM events",
)
def time_buckets(t: Tables):
    return t.events.select(
        "event_id", bucket_start("ts", 900).alias("quarter"), bucket_start("ts", 21_600).alias("quarter_day")
    )


_INCREASE = """
    WITH d AS (SELECT {label}, ts, value, lag(value) OVER (PARTITION BY {label} ORDER BY ts) AS p FROM {source}),
    s AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS step FROM d),
    i AS (SELECT {label}, ts, value, CAST(sum(step) OVER (PARTITION BY {label} ORDER BY ts
          RANGE BETWEEN INTERVAL 14399 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS increase FROM s)
"""


@query(
    "counter_increase",
    "W2",
    _INCREASE.format(label="kind", source="counter_samples") + "SELECT kind, ts, value, increase FROM i",
)
def counter_increase(t: Tables):
    return counters.counter_increase(t.counter_samples, ["kind"], "ts", "value", 14_400)


@query(
    "low_activity_alerts",
    "W3 W2",
    _INCREASE.format(label="kind", source="counter_samples")
    + """, g AS (SELECT *, increase < 10 AS low, sum(CASE WHEN increase < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY kind ORDER BY ts) AS run FROM i)
    SELECT kind, min(ts) AS since, max(ts) AS until, count(*) AS samples FROM g WHERE low GROUP BY kind, run
    HAVING max(ts) - min(ts) >= INTERVAL '60 minutes'
    """,
)
def low_activity_alerts(t: Tables):
    grown = counters.counter_increase(t.counter_samples, ["kind"], "ts", "value", 14_400)
    return counters.held_alerts(grown, ["kind"], "ts", F.col("increase") < 10, 3600)


@query(
    "topic_throughput",
    "A14 W4",
    _INCREASE.format(label="part", source="offset_samples")
    + "SELECT ts, round(CAST(sum(increase) AS DOUBLE) / 14400, 9) AS rate FROM i GROUP BY ts",
)
def topic_throughput(t: Tables):
    per_partition = counters.counter_rate(t.offset_samples, ["part"], "ts", "value", 14_400)
    return per_partition.groupBy("ts").agg(F.round(F.sum("rate"), 9).alias("rate"))


@query(
    "file_facets",
    "A17",
    """
    WITH f AS (SELECT 'service' AS facet, service AS value, count(*) AS n FROM tracked_file GROUP BY service
      UNION ALL SELECT 'job', split_part(file_path, '/', 4), count(*) FROM tracked_file GROUP BY 2
      UNION ALL SELECT 'modified_day', CAST(CAST(modified_at AS DATE) AS VARCHAR), count(*) FROM tracked_file GROUP BY 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS INTEGER) AS rank FROM f)
    SELECT facet, value, n, rank FROM r WHERE rank <= 10
    """,
)
def file_facets(t: Tables):
    files = tracking.parse_paths(t.tracked_file).withColumn("modified_day", F.to_date("modified_at"))
    return histograms.facet_counts(files, ["service", "job", "modified_day"], 10)


@query(
    "complaint_lookup",
    "B12 P5",
    """
    SELECT host, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM crawl_log
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-08 00:00:00' AND regexp_matches(url, '/p/4[0-9]$')
    GROUP BY host
    """,
)
def complaint_lookup(t: Tables):
    """Which hosts did the crawler visit at that time under that path?"""
    near = filters.between_times(t.crawl_log, "ts", datetime(2024, 1, 5), datetime(2024, 1, 8))
    return (
        near.where(F.col("url").rlike("/p/4[0-9]$"))
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


@query(
    "events_by_day",
    "S11",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM crawl_log"
    " WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' GROUP BY 1",
)
def events_by_day(t: Tables):
    from tidemark.sinks.exports import write_days
    from tidemark.sources.tables import read_days
    from tidemark.session import shared_dir

    folder = shared_dir(t.spark, "daily-events")
    write_days(t.crawl_log, "ts", folder)
    days = read_days(t.spark, folder, "2024-01-03", "2024-01-09")
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


