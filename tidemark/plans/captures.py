"""Capture index queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import crawl_fields as cf
from tidemark.functions import times, urls
from tidemark.operators import captures as ops
from tidemark.operators import filters, merge
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.plans.views import covers, surt, ts14
from tidemark.session import shared_dir
from tidemark.sinks import blocks


@query(
    "timestamps14",
    "F3",
    f"""
    SELECT event_id, {ts14('ts')} AS ts14, date_trunc('second', ts) AS parsed, {ts14('ts')} >= '20240115000000' AS late FROM events
    """,
)
def timestamps14(t: Tables):
    stamped = t.events.withColumn("ts14", times.to_ts14("ts"))
    return stamped.select(
        "event_id", "ts14", times.from_ts14("ts14").alias("parsed"), (F.col("ts14") >= "20240115000000").alias("late")
    )


@query(
    "mime_types",
    "F13",
    """
    SELECT event_id, nullif(lower(split_part(m, ';', 1)), '-') AS mime, m = 'warc/revisit' AS revisit
    FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '-' WHEN 1 THEN 'Text/HTML; charset=UTF-8' WHEN 2 THEN 'warc/revisit' ELSE mimetype END AS m FROM crawl_log)
    """,
)
def mime_types(t: Tables):
    raw = t.crawl_log.selectExpr(
        "event_id",
        "CASE event_id % 6 WHEN 0 THEN '-' WHEN 1 THEN 'Text/HTML; charset=UTF-8' WHEN 2 THEN 'warc/revisit' ELSE mimetype END AS m",
    )
    return raw.select("event_id", cf.mime_type("m").alias("mime"), cf.is_revisit("m").alias("revisit"))


@query(
    "access_urls",
    "F12",
    "SELECT event_id, 'https://archive.example.org/access/resolve/' || ts14 || '/' || url AS access_url FROM captures",
)
def access_urls(t: Tables):
    return t.captures.select(
        "event_id", urls.access_url("https://archive.example.org/access/resolve/", "ts14", "url").alias("access_url")
    )


_RECENT = """
    WITH seen AS (SELECT urlkey, max(ts) AS last_capture FROM captures WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1),
    cand AS (SELECT event_id, urlkey, ts, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2024-01-18 00:00:00' END AS launch_ts
      FROM captures WHERE ts >= TIMESTAMP '2024-01-20 00:00:00')
    SELECT c.event_id, c.urlkey, s.last_capture, coalesce(
      c.ts < s.last_capture + INTERVAL '5 days' AND (c.launch_ts IS NULL OR s.last_capture >= c.launch_ts), FALSE) AS seen_recently
    FROM cand c LEFT JOIN seen s USING (urlkey)
"""


@query("recently_seen", "J7", _RECENT.replace("c.ts < s.last_capture + INTERVAL '5 days'",
       "floor(epoch(c.ts)) - floor(epoch(s.last_capture)) < 432000"))
def recently_seen(t: Tables):
    cut = F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")
    captures = t.captures
    candidates = captures.where(F.col("ts") >= cut).withColumn(
        "launch_ts", F.when(F.col("event_id") % 4 == 0, F.lit(datetime(2024, 1, 18)).cast("timestamp_ntz"))
    )
    known = captures.where(F.col("ts") < cut)
    out = ops.recently_seen(candidates, known, "urlkey", "ts", "ts", 432_000, launch="launch_ts")
    return out.select("event_id", "urlkey", "last_capture", "seen_recently")


@query(
    "revisit_records",
    "J8",
    """
    WITH c AS (SELECT event_id, urlkey, ts, CASE WHEN event_id % 11 <> 0 THEN content_digest END AS content_digest FROM captures)
    SELECT event_id, urlkey, content_digest,
     CASE WHEN content_digest IS NULL OR row_number() OVER w = 1 THEN 'response' ELSE 'revisit' END AS record_type,
     CASE WHEN content_digest IS NOT NULL AND row_number() OVER w > 1 THEN first_value(event_id) OVER w END AS refers_to
    FROM c WINDOW w AS (PARTITION BY urlkey, content_digest ORDER BY ts, event_id)
    """,
)
def revisit_records(t: Tables):
    some_unknown = t.captures.withColumn("content_digest", F.expr("CASE WHEN event_id % 11 <> 0 THEN content_digest END"))
    out = ops.mark_revisits(some_unknown, ["urlkey", "content_digest"], "ts", "event_id")
    return out.select("event_id", "urlkey", "content_digest", "record_type", "refers_to")


@query(
    "closest_capture",
    "J10",
    """
    WITH req AS (SELECT event_id AS request_id, 'uk,co,example,h' || (event_id % 20) || ')/p/' || (event_id % 100) AS urlkey,
       CASE WHEN event_id % 50 = 0 THEN TIMESTAMP '1000-01-01 00:00:00' WHEN event_id % 50 = 1 THEN TIMESTAMP '9999-12-31 00:00:00'
         ELSE date_trunc('second', ts) END AS target
      FROM crawl_log WHERE status_code < 0),
    near AS (SELECT r.*, c.ts AS capture_ts, c.event_id AS capture_id, c.status_code, row_number() OVER (PARTITION BY r.request_id
        ORDER BY abs(epoch_us(c.ts) - epoch_us(r.target)), c.ts, c.event_id) AS rn
      FROM req r LEFT JOIN (SELECT * FROM captures WHERE event_id % 9 <> 0) c ON c.urlkey = r.urlkey)
    SELECT request_id, urlkey, target, capture_ts, CAST(capture_id AS BIGINT) AS capture_id, status_code FROM near WHERE rn = 1
    """,
)
def closest_capture(t: Tables):
    requested = (
        F.when(F.col("event_id") % 50 == 0, times.EARLIEST_TS14)
        .when(F.col("event_id") % 50 == 1, times.LATEST_TS14)
        .otherwise(times.to_ts14("ts"))
    )
    requests = t.crawl_log.where("status_code < 0").select(
        F.col("event_id").alias("request_id"),
        F.expr("concat('uk,co,example,h', event_id % 20, ')/p/', event_id % 100) AS urlkey"),
        ops.target_time(requested).alias("target"),
    )
    captures = t.captures.withColumn("revisit", F.col("event_id") % 9 == 0)
    return ops.closest_capture(
        requests, captures, "urlkey", "target", "ts", "event_id", ["status_code"], skip_revisits="revisit"
    )


@query(
    "capture_at_time",
    "J10",
    """
    SELECT urlkey, wanted, capture_ts, capture_id FROM (
      SELECT urlkey, 'middle' AS wanted, ts AS capture_ts, event_id AS capture_id, row_number() OVER (PARTITION BY urlkey
        ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), ts, event_id) AS rn FROM captures
      UNION ALL SELECT urlkey, 'first', ts, event_id, row_number() OVER (PARTITION BY urlkey ORDER BY ts, event_id) FROM captures
      UNION ALL SELECT urlkey, 'last', ts, event_id, row_number() OVER (PARTITION BY urlkey ORDER BY ts DESC, event_id) FROM captures)
    WHERE rn = 1
    """,
)
def capture_at_time(t: Tables):
    out = None
    for wanted, ts14_value in (("middle", "20240115120000"), ("first", times.EARLIEST_TS14), ("last", times.LATEST_TS14)):
        one = ops.capture_for_time(t.captures, "urlkey", "ts", "event_id", ts14_value, []).withColumn("wanted", F.lit(wanted))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "deletions_applied",
    "J13",
    """
    SELECT event_id, urlkey FROM captures WHERE NOT (starts_with(urlkey, 'uk,co,example,h3)/p/1') AND ts14 >= '20240110000000')
    """,
)
def deletions_applied(t: Tables):
    captures = t.captures
    doomed = captures.where("startswith(urlkey, 'uk,co,example,h3)/p/1') AND ts14 >= '20240110000000'")
    return ops.drop_listed(captures, doomed, ["urlkey", "ts14", "event_id"]).select("event_id", "urlkey")


@query(
    "url_aliases",
    "J12",
    """
    SELECT event_id, urlkey, CASE WHEN starts_with(urlkey, 'uk,co,example,h1)') THEN replace(urlkey, 'h1)', 'h2)') ELSE urlkey END AS current_key FROM captures
    """,
)
def url_aliases(t: Tables):
    captures = t.captures
    aliases = (
        captures.where("startswith(urlkey, 'uk,co,example,h1)')")
        .select(F.col("urlkey").alias("old_key"), F.expr("replace(urlkey, 'h1)', 'h2)')").alias("new_key"))
        .distinct()
    )
    out = ops.apply_aliases(captures, "urlkey", aliases, "old_key", "new_key", "current_key")
    return out.select("event_id", "urlkey", "current_key")


# Chains: host h of 0 to 8 moved on to the next one; h10, h11 and h12 form a loop, and h13 leads into it.
_MOVED = """(SELECT DISTINCT urlkey AS old_key, replace(urlkey, concat('h', h, ')'), concat('h', CASE WHEN h = 12 THEN 10 WHEN h = 13 THEN 11 ELSE h + 1 END, ')')) AS new_key
    FROM (SELECT urlkey, CAST(regexp_extract(urlkey, 'h([0-9]+)[)]', 1) AS INT) AS h FROM {captures}) k WHERE h <= 13 AND h <> 9)"""


@query(
    "url_alias_chains",
    "J12 P26",
    f"""
    WITH RECURSIVE moved AS (SELECT * FROM {_MOVED.format(captures='captures')}),
    walk AS (SELECT old_key, new_key, 1 AS steps, [new_key] AS path FROM moved
      UNION ALL SELECT w.old_key, m.new_key, w.steps + 1, list_append(w.path, m.new_key) FROM walk w JOIN moved m ON m.old_key = w.new_key
      WHERE NOT list_contains(w.path, m.new_key)),
    far AS (SELECT *, row_number() OVER (PARTITION BY old_key ORDER BY steps DESC) AS rn FROM walk),
    ends AS (SELECT f.old_key, f.path, f.new_key, f.steps, m.new_key AS back FROM far f LEFT JOIN moved m ON m.old_key = f.new_key WHERE rn = 1)
    SELECT old_key, CASE WHEN back IS NULL THEN new_key ELSE list_min(list_slice(path, list_position(path, back), len(path))) END AS final,
      CASE WHEN back IS NULL THEN CAST(steps AS BIGINT) END AS steps FROM ends
    """,
)
def url_alias_chains(t: Tables):
    moved = t.spark.sql("SELECT * FROM " + _MOVED, captures=t.captures)
    return ops.resolved_aliases(moved, "old_key", "new_key")


@query(
    "unique_urls",
    "A15 T8",
    """
    SELECT urlkey, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY urlkey ORDER BY ts, event_id) AS rn FROM captures) WHERE rn = 1
    """,
)
def unique_urls(t: Tables):
    return ops.first_seen_urls(t.captures.select("urlkey", "event_id", "ts"), "urlkey", "ts", "event_id")


@query(
    "deletion_profile",
    "A16",
    """
    SELECT content_digest, mimetype, status_code, count(*) AS captures, count(DISTINCT urlkey) AS urls, min(ts) AS first_ts, max(ts) AS last_ts
    FROM captures GROUP BY 1, 2, 3
    """,
)
def deletion_profile(t: Tables):
    return ops.deletion_profile(t.captures, ["content_digest", "mimetype", "status_code"], "ts", "urlkey")


@query(
    "fetch_history",
    "W6",
    """
    SELECT urlkey, event_id, ts, recency FROM (SELECT *, CAST(row_number() OVER (PARTITION BY urlkey ORDER BY ts DESC, event_id DESC) AS INTEGER) AS recency FROM captures)
    WHERE recency <= 2
    """,
)
def fetch_history(t: Tables):
    return ops.fetch_history(t.captures, "urlkey", "ts", "event_id").select("urlkey", "event_id", "ts", "recency")


@query(
    "content_changes",
    "W9",
    """
    SELECT event_id, host, lag(content_digest) OVER w AS previous_digest, content_digest <> lag(content_digest) OVER w AS changed
    FROM captures WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)
    """,
)
def content_changes(t: Tables):
    """Per host here, so that most captures have one before them."""
    out = ops.content_changes(t.captures, "host", "ts", "event_id", "content_digest")
    return out.select("event_id", "host", "previous_digest", "changed")


@query(
    "merged_updates",
    "W1 K5",
    """
    SELECT host, url, max_by(status_code, (ts, event_id)) FILTER (status_code > 0) AS status_code,
      max_by(thread, (ts, event_id)) FILTER (thread IS NOT NULL) AS thread, max_by(size, (ts, event_id)) AS size
    FROM crawl_log GROUP BY host, url
    """,
)
def merged_updates(t: Tables):
    partial = t.crawl_log.withColumn("status_code", F.expr("CASE WHEN status_code > 0 THEN status_code END"))
    return merge.latest_non_null(partial, ["host", "url"], ["ts", "event_id"], ["status_code", "thread", "size"])


@query(
    "upserted_events",
    "K5 W1",
    """
    WITH u AS (SELECT event_id AS id, ts, url, status_code, thread, 0 AS v FROM crawl_log WHERE event_id % 2 = 0 OR event_id % 3 <> 0
      UNION ALL SELECT event_id, ts, url, NULL, 'patched', 1 FROM crawl_log WHERE event_id % 3 = 0)
    SELECT id, ts, url, max_by(status_code, v) FILTER (status_code IS NOT NULL) AS status_code,
      max_by(thread, v) FILTER (thread IS NOT NULL) AS thread, max(v) AS v FROM u GROUP BY id, ts, url
    """,
)
def upserted_events(t: Tables):
    log = t.crawl_log.withColumnRenamed("event_id", "id")
    existing = log.where("id % 2 = 0 OR id % 3 <> 0").select("id", "ts", "url", "status_code", "thread", F.lit(0).alias("v"))
    updates = log.where("id % 3 = 0").select(
        "id", "ts", "url", F.lit(None).cast("int").alias("status_code"), F.lit("patched").alias("thread"), F.lit(1).alias("v")
    )
    once = merge.upsert(existing, updates, ["id", "ts", "url"], ["v"], ["status_code", "thread"])
    # sending the same updates again must change nothing
    return merge.upsert(once, updates, ["id", "ts", "url"], ["v"], ["status_code", "thread"])


@query(
    "index_block_lookup",
    "P10 P27 J10",
    """
    SELECT 'prefix' AS match_type, event_id, urlkey, ts14 FROM captures WHERE starts_with(urlkey, 'uk,co,example,h3)/p/1')
    UNION ALL SELECT 'host', event_id, urlkey, ts14 FROM captures WHERE starts_with(urlkey, 'uk,co,example,h5)')
    UNION ALL SELECT 'domain', event_id, urlkey, ts14 FROM captures WHERE starts_with(urlkey, 'uk,co,example,h1)') OR starts_with(urlkey, 'uk,co,example,h1,')
    UNION ALL SELECT 'exact', event_id, urlkey, ts14 FROM captures WHERE urlkey = 'uk,co,example,h2)/p/7'
    """,
)
def index_block_lookup(t: Tables):
    """An index written, added to and merged in key order; each lookup reads the files of its stretch of keys."""
    folder = shared_dir(t.spark, "index-blocks")
    rows = t.captures.select("event_id", "urlkey", "ts14")
    blocks.write_index(rows.where("event_id % 3 = 0"), "urlkey", "ts14", folder, 8)
    blocks.append_index(rows.where("event_id % 3 = 1"), "urlkey", "ts14", folder, 8)
    blocks.merge_index(t.spark, "urlkey", "ts14", folder, 16)
    blocks.append_index(rows.where("event_id % 3 = 2"), "urlkey", "ts14", folder, 8)
    out = None
    for kind, value in (("prefix", "uk,co,example,h3)/p/1"), ("host", "uk,co,example,h5"), ("domain", "uk,co,example,h1"), ("exact", "uk,co,example,h2)/p/7")):
        one = blocks.lookup(t.spark, folder, "urlkey", value, kind).select(F.lit(kind).alias("match_type"), "event_id", "urlkey", "ts14")
        out = one if out is None else out.unionByName(one)
    return out


_SCAN_PREFIXES = "(VALUES ('uk,co,example,h3)/p/1'), ('uk,co,example,h4)'), ('uk,co,example,h5)/p/77')) s(surt_prefix)"


@query(
    "prefix_scan",
    "P10 L4",
    f"""
    SELECT surt_prefix, event_id, urlkey, ts14, scan_no FROM (
      SELECT s.surt_prefix, c.event_id, c.urlkey, c.ts14, row_number() OVER (PARTITION BY s.surt_prefix ORDER BY c.urlkey, c.ts14, c.event_id) AS scan_no
      FROM captures c JOIN {_SCAN_PREFIXES} ON {covers('s.surt_prefix', 'c.urlkey')} WHERE c.ts14 >= '20240110000000') WHERE scan_no <= 100
    """,
)
def prefix_scan(t: Tables):
    wanted = t.spark.createDataFrame(
        [("uk,co,example,h3)/p/1",), ("uk,co,example,h4)",), ("uk,co,example,h5)/p/77",)], "surt_prefix string"
    )
    out = ops.scan_from(t.captures, "urlkey", "ts14", wanted, "surt_prefix", "20240110000000", 100, "event_id")
    return out.select("surt_prefix", "event_id", "urlkey", "ts14", "scan_no")


@query(
    "capped_search",
    "L4",
    "SELECT event_id, urlkey, ts14 FROM captures WHERE status_code = 200 ORDER BY urlkey, ts14, event_id LIMIT 1000",
)
def capped_search(t: Tables):
    hits = t.captures.where("status_code = 200").select("event_id", "urlkey", "ts14")
    return filters.cap(hits, 1000, ["urlkey", "ts14", "event_id"])


@query(
    "presence_audit",
    "J20",
    f"""
    WITH w AS (SELECT DISTINCT url, {surt('url')} AS urlkey FROM crawl_log WHERE mimetype = 'application/pdf'),
    a AS (SELECT w.*, EXISTS (SELECT 1 FROM captures c WHERE c.urlkey = w.urlkey) AS in_crawl_index,
      EXISTS (SELECT 1 FROM captures c WHERE c.urlkey = w.urlkey AND c.status_code = 200 AND c.event_id % 3 = 0) AS in_access_index,
      EXISTS (SELECT 1 FROM captures c WHERE c.urlkey = w.urlkey AND c.status_code = 200 AND c.event_id % 6 = 0) AS in_documents FROM w)
    SELECT *, CASE WHEN NOT in_crawl_index THEN 'crawl_index' WHEN NOT in_access_index THEN 'access_index' WHEN NOT in_documents THEN 'documents' ELSE 'none' END AS first_gap FROM a
    """,
)
def presence_audit(t: Tables):
    from tidemark.operators.documents import presence_audit as audit

    captures = t.captures
    wanted = (
        t.crawl_log.where("mimetype = 'application/pdf'").select("url").distinct().withColumn("urlkey", urls.surt_key("url"))
    )
    found = captures.where("status_code = 200")
    stages = [
        ("crawl_index", captures),
        ("access_index", found.where("event_id % 3 = 0")),
        ("documents", found.where("event_id % 6 = 0")),
    ]
    return audit(wanted, stages, "urlkey")
