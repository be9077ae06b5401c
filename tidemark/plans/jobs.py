"""Whole jobs on the test tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.plans.curated import _FOUND, _found, _index, _INDEXED, _watched, _WATCHED
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.plans.texts import _DOMAINS, _PRINTS

from tidemark.plans.views import covers, host, page_text, surt, text_literal, ts14
from tidemark.functions import content
from tidemark.session import shared_dir
from tidemark.sinks import committed, publish


@query(
    "track_files",
    "B1 S5 W1 K5",
    f"""
    WITH l AS (SELECT file_path, service, size, modified_at, l_returnflag, l_linenumber, l_orderkey FROM tracked_file),
    old AS (SELECT file_path, service, max(size) AS size, max(modified_at) AS modified_at FROM l WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
    new AS (SELECT DISTINCT file_path, service, size + 1 AS size, modified_at FROM l WHERE l_orderkey % 3 = 0 AND starts_with(file_path, '/heritrix/output/frequent'))
    SELECT coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.service, o.service) AS service, CAST(CASE WHEN n.file_path IS NULL THEN 0 ELSE 1 END AS INTEGER) AS version,
      max(coalesce(n.size, o.size)) AS size, max(coalesce(n.modified_at, o.modified_at)) AS modified_at
    FROM old o FULL JOIN new n ON n.file_path = o.file_path AND n.service = o.service GROUP BY 1, 2, 3
    """,
)
def track_files(t: Tables):
    """The listings of both services, each merged twice; the second time changes nothing."""
    merged = t.tracked_file.where("l_orderkey % 2 = 0").groupBy("file_path", "service").agg(
        F.max("size").alias("size"), F.max("modified_at").alias("modified_at")
    ).select(
        "file_path", "service", F.lit("warcs").alias("kind"), F.lit("x").alias("stream"), "size", "modified_at", F.lit(0).alias("seen_at")
    )
    for service in ("h020", "h3"):
        lines = t.tracked_file.where((F.col("service") == service) & (F.col("l_orderkey") % 3 == 0)).select(
            F.concat(
                F.lit("-rw-r--r-- 3 a b "), (F.col("size") + 1).cast("string"), F.lit(" "),
                F.date_format(F.col("modified_at").cast("timestamp"), "yyyy-MM-dd HH:mm"), F.lit(" "), "file_path",
            ).alias("value")
        )
        for _ in range(2):
            merged = jobs.track_files(lines, merged, service, F.lit(1), under="/heritrix/output/frequent")
    return merged.select("file_path", "service", F.col("seen_at").alias("version"), "size", "modified_at")


_INDEX_BATCH = """
    WITH files AS (SELECT host, '/heritrix/output/frequent-npld/20240101000000/warcs/' || host || '.warc.gz' AS file_path, max(ts) AS modified_at FROM crawl_log GROUP BY 1),
    batch AS (SELECT host, file_path FROM files WHERE host NOT IN ('h1.example.co.uk', 'h2.example.co.uk') ORDER BY modified_at DESC, file_path LIMIT 5),
    next_batch AS (SELECT host, file_path FROM files WHERE host NOT IN ('h1.example.co.uk', 'h2.example.co.uk') AND host NOT IN (SELECT host FROM batch) ORDER BY modified_at DESC, file_path LIMIT 5)
"""


@query(
    "capture_index_batch",
    "B2 P7 J5 W7 J8",
    _INDEX_BATCH
    + """, both_batches AS (SELECT 1 AS run, * FROM batch UNION ALL SELECT 2, host, file_path FROM next_batch),
    r AS (SELECT run, c.event_id, c.urlkey, c.ts14, file_path, c.mimetype AS mime,
      first_value(c.event_id) OVER (PARTITION BY c.urlkey, c.content_digest ORDER BY run, c.ts, c.event_id) AS first_of_one, first_value(c.event_id) OVER (PARTITION BY c.urlkey, c.content_digest ORDER BY c.ts, c.event_id) AS first_of_all
      FROM captures c JOIN both_batches USING (host)),
    f AS (SELECT *, CASE WHEN run = 1 THEN first_of_one ELSE first_of_all END AS first_id FROM r)
    SELECT run, event_id, urlkey, ts14, file_path, mime, CASE WHEN event_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN event_id <> first_id THEN first_id END AS refers_to FROM f""",
)
def capture_index_batch(t: Tables):
    where = F.concat(F.lit("/heritrix/output/frequent-npld/20240101000000/warcs/"), "host", F.lit(".warc.gz"))
    records = t.crawl_log.withColumn("file_path", where)
    files = records.groupBy("file_path").agg(F.max("ts").alias("modified_at")).withColumn("stream", F.lit("frequent"))
    marks = files.where(F.col("file_path").rlike("/h[12][.]example"))
    first = jobs.capture_index(files, marks, records, "frequent", datetime(2024, 2, 1), 5)
    marks = marks.select("file_path").unionByName(first.marks.select("file_path"))
    second = jobs.capture_index(files, marks, records, "frequent", datetime(2024, 2, 1), 5, indexed=first.rows)
    out = ("event_id", "urlkey", "ts14", "file_path", "mime", "record_type", "refers_to")
    return first.rows.select(F.lit(1).alias("run"), *out).unionByName(second.rows.select(F.lit(2).alias("run"), *out))


@query(
    "fulltext_index",
    "B3 P9 F15 F18 J9",
    f"""
    WITH p AS (SELECT * FROM page_record WHERE record_type = 'response' AND status_code = 200),
    acc AS (SELECT DISTINCT p.page_id FROM p JOIN surt_prefixes s ON s.decision = 'accept' AND {covers('s.surt_prefix', 'p.urlkey')}),
    col AS (SELECT p.page_id, array_to_string(list_sort(list_distinct(list(s.decision))), '|') AS collection FROM p JOIN surt_prefixes s ON {covers('s.surt_prefix', 'p.urlkey')} GROUP BY 1)
    SELECT p.page_id, md5({page_text('html')}) AS text_md5, sha1(html) AS digest,
      array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, {text_literal(content.ELEMENT)}, 1), lambda e: lower(e)))), ',') AS elements,
      {host('url')} AS link_hosts, col.collection, CASE WHEN acc.page_id IS NULL THEN 'reading room' ELSE 'open' END AS access_terms
    FROM p LEFT JOIN acc USING (page_id) LEFT JOIN col USING (page_id)
    """,
)
def fulltext_index(t: Tables):
    listed = t.surt_prefixes
    scopes = listed.select("surt_prefix", F.col("decision").alias("collection"), F.lit("s").alias("subject"))
    rows = jobs.fulltext_index(t.page_record, scopes, listed.where("decision = 'accept'"), "pages-2024")
    return rows.select("page_id", F.md5(F.encode("text", "utf-8")).alias("text_md5"), "digest", "elements", "link_hosts", "collection", "access_terms")


_PAGE_PRINTS = _PRINTS.replace("FROM documents", "FROM ptext", 1)


@query(
    "fulltext_links",
    "B3 F17 F19",
    f"""
    WITH p AS (SELECT * FROM page_record WHERE record_type = 'response' AND status_code = 200),
    ptext AS (SELECT page_id AS doc_id, {page_text('html')} AS text FROM p),
    pr AS ({_PAGE_PRINTS} SELECT doc_id, band, value FROM prints),
    o AS (SELECT page_id, {host('url')} AS host FROM p), hosts AS (SELECT DISTINCT host FROM o),
    """
    + _DOMAINS
    + """, f AS (SELECT doc_id, string_agg(value, ' ' ORDER BY band) AS text_print FROM pr GROUP BY doc_id)
    SELECT o.page_id, coalesce(d.domain, '') AS link_domains, f.text_print FROM o LEFT JOIN d ON d.host = o.host LEFT JOIN f ON f.doc_id = o.page_id""",
)
def fulltext_links(t: Tables):
    """Linked domains and text fingerprint of the full-text index rows."""
    listed = t.surt_prefixes
    scopes = listed.select("surt_prefix", F.col("decision").alias("collection"), F.lit("s").alias("subject"))
    rows = jobs.fulltext_index(t.page_record, scopes, listed.where("decision = 'accept'"), "pages-2024", t.suffix_rules)
    return rows.select("page_id", "link_domains", "text_print")


_DAILY_FOUND = _FOUND.replace("row_number() OVER (PARTITION BY k.url ORDER", "row_number() OVER (PARTITION BY CAST(k.ts AS DATE), k.url ORDER").replace(
    "{ts14('ts')}", ts14("ts")
)


@query(
    "log_analysis_days",
    "B4 B14 J19",
    _DAILY_FOUND
    + " SELECT document_url, target_id, wayback_timestamp, strptime(left(wayback_timestamp, 8), '%Y%m%d')::DATE AS day FROM found"
    " WHERE left(wayback_timestamp, 8) BETWEEN '20240105' AND '20240108' QUALIFY row_number() OVER (PARTITION BY document_url ORDER BY wayback_timestamp) = 1",
)
def log_analysis_days(t: Tables):
    """Back-fill of four days; the second day is run twice and must not double, nor may a URL be found on two days."""
    folder = shared_dir(t.spark, "found-by-day")
    events = t.crawl_log.withColumns(
        {"landing_page_url": F.expr("concat('http://', host, '/p/', event_id % 7)"), "source": F.col("hop_path")}
    )

    def run(day: date):
        before = [f"{folder}/day={date(2024, 1, d).isoformat()}" for d in range(5, day.day)]
        earlier = t.spark.read.parquet(*before) if before else None
        return jobs.analyse_logs(events, _watched(t), day, "frequent-npld", earlier)

    jobs.back_fill(t.spark, run, date(2024, 1, 5), date(2024, 1, 8), folder)
    jobs.back_fill(t.spark, run, date(2024, 1, 6), date(2024, 1, 6), folder)
    return t.spark.read.parquet(folder).select("document_url", "target_id", "wayback_timestamp", "day")


_WAITING = """
    WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM crawl_log), ranked AS (SELECT d.day, count(l.day) // 6 AS batch FROM days d LEFT JOIN days l ON l.day > d.day GROUP BY d.day),
"""
_WAITING_FOUND = (
    _FOUND.replace("WITH k AS (SELECT *,", "k AS (SELECT c.*, r.batch,", 1)
    .replace("FROM crawl_log WHERE", "FROM crawl_log c JOIN ranked r ON r.day = CAST(c.ts AS DATE) WHERE r.batch < 2 AND", 1)
    .replace("OVER (PARTITION BY k.url ORDER BY", "OVER (PARTITION BY k.url ORDER BY k.batch,", 1)
)


@query(
    "waiting_logs_findings",
    "B4 K13 J5",
    _WAITING + _WAITING_FOUND.replace("list_last(string_split(url, '/')) AS filename", "list_last(string_split(url, '/')) AS filename, batch")
    + " SELECT document_url, target_id, wayback_timestamp, size, status, CAST(batch AS INTEGER) AS batch FROM found",
)
def waiting_logs_findings(t: Tables):
    """Two runs over the newest logs without a mark, six at a time, each run's findings and marks visible at once."""
    root, runs = _waiting_runs(t)
    found = committed.read_committed(t.spark, root, "findings", jobs.DOCUMENT_ROW)
    number = F.when(F.col("run") == runs[0], 0).when(F.col("run") == runs[1], 1)
    return found.select("document_url", "target_id", "wayback_timestamp", "size", "status", number.alias("batch"))


@query(
    "waiting_logs_metrics",
    "B4 K9",
    _WAITING + _WAITING_FOUND.replace("list_last(string_split(url, '/')) AS filename", "list_last(string_split(url, '/')) AS filename, batch")
    + """ SELECT CAST(batch AS INTEGER) AS batch, 'findings' AS kind, count(*) AS value FROM found GROUP BY batch
    UNION ALL SELECT CAST(batch AS INTEGER), 'logs', count(*) FROM ranked WHERE batch < 2 GROUP BY batch
    UNION ALL SELECT CAST(b AS INTEGER), 'invalid', (SELECT count(*) FROM found WHERE landing_page_url IS NULL AND batch = b) FROM range(2) r(b)""",
)
def waiting_logs_metrics(t: Tables):
    root, runs = _waiting_runs(t)
    rows = committed.read_committed(t.spark, root, "metrics", jobs.METRIC_ROW)
    return rows.select(F.when(F.col("run") == runs[0], 0).when(F.col("run") == runs[1], 1).alias("batch"), "kind", "value")


def _waiting_runs(t: Tables) -> tuple[str, list[str]]:
    root = shared_dir(t.spark, "waiting-logs")
    path = F.concat(F.lit("/heritrix/output/frequent-npld/logs/crawl.log.cp"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd"))
    events = t.crawl_log.withColumns(
        {"landing_page_url": F.expr("concat('http://', host, '/p/', event_id % 7)"), "source": F.col("hop_path"), "file_path": path}
    )
    files = events.groupBy("file_path").agg(F.max("ts").alias("modified_at"))
    return root, [jobs.analyse_waiting_logs(files, events, _watched(t), "frequent-npld", root, 6) for _ in range(2)]


@query(
    "process_documents",
    "B5 L3 J4 F12 T14",
    _INDEXED
    + """, batch AS (SELECT * FROM found ORDER BY wayback_timestamp DESC, document_url LIMIT 100)
    SELECT b.document_url, b.wayback_timestamp, b.target_id, CASE WHEN NOT EXISTS (SELECT 1 FROM idx WHERE idx.document_url = b.document_url AND idx.wayback_timestamp = b.wayback_timestamp) THEN 'NEW'
      WHEN b.target_id IS NOT NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, 'https://archive.example.org/access/resolve/' || b.wayback_timestamp || '/' || b.document_url AS access_url
    FROM batch b""",
)
def process_documents(t: Tables):
    out = jobs.process_documents(
        _found(t), _index(t), 100, "https://archive.example.org/access/resolve/", F.col("target_id").isNotNull()
    )
    return out.select("document_url", "wayback_timestamp", "target_id", "status", "access_url")


@query(
    "curated_export_lines",
    "B6 K1 K2 K3 K7 P23",
    f"""
    WITH c AS (SELECT *, {surt('url')} AS k,
      '{{"id":' || target_id || ',"title":"' || title || '","seeds":["' || url || '"],"frequency":"' || frequency || '","scope":"' || scope || '","depth":"' || depth || '","basis":"' || basis || '"}}' AS entry FROM curated),
    live AS (SELECT * FROM c WHERE frequency <> 'NEVERCRAWL' AND (end_date IS NULL OR end_date >= TIMESTAMP '2024-01-10'))
    SELECT 'feed_' || basis AS output, entry AS value FROM live
    UNION ALL SELECT DISTINCT 'never_crawl', k FROM c WHERE frequency = 'NEVERCRAWL'
    UNION ALL SELECT DISTINCT 'allows', k || ' - {{"access":"allow","url":"' || k || '"}}' FROM c WHERE open_access
    UNION ALL SELECT DISTINCT 'blocks', k || ' - {{"access":"block","url":"' || k || '"}}' FROM c WHERE frequency = 'NEVERCRAWL'
    UNION ALL SELECT DISTINCT 'annotations', '{{"surt_prefix":"' || k || '","collection_id":' || collection_id || '}}' FROM c
    """,
)
def curated_export_lines(t: Tables):
    """Every published line but those of the collections, whose content ``collection_export`` checks."""
    root = shared_dir(t.spark, "curated-export")
    jobs.export_curated(t.curated, datetime(2024, 1, 10), root)
    out = None
    for name in ("feed_npld", "feed_bypm", "never_crawl", "allows", "blocks", "annotations"):
        one = publish.read_published(t.spark, root, name).select(F.lit(name).alias("output"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "curated_export_counts",
    "B6 K7 K9 A8 K1 K2 K3 K11 P23",
    f"""
    WITH c AS (SELECT *, {surt('url')} AS k FROM curated), live AS (SELECT * FROM c WHERE frequency <> 'NEVERCRAWL' AND (end_date IS NULL OR end_date >= TIMESTAMP '2024-01-10'))
    SELECT 'feed_npld' AS output, count(*) AS rows FROM live WHERE basis = 'npld' UNION ALL SELECT 'feed_bypm', count(*) FROM live WHERE basis = 'bypm'
    UNION ALL SELECT 'never_crawl', count(DISTINCT k) FROM c WHERE frequency = 'NEVERCRAWL' UNION ALL SELECT 'allows', count(DISTINCT k) FROM c WHERE open_access
    UNION ALL SELECT 'blocks', count(DISTINCT k) FROM c WHERE frequency = 'NEVERCRAWL' UNION ALL SELECT 'annotations', count(*) FROM (SELECT DISTINCT k, collection_id FROM c)
    UNION ALL SELECT 'collections', CAST(sum(ceil(n / 1000.0)) AS BIGINT) FROM (SELECT count(*) AS n FROM c GROUP BY collection_id)
    """,
)
def curated_export_counts(t: Tables):
    root = shared_dir(t.spark, "curated-export")
    jobs.export_curated(t.curated, datetime(2024, 1, 10), root)
    return publish.current_version(t.spark, root).select("output", "rows")


@query(
    "verified_transfer",
    "B8 P8 J6",
    """
    WITH s AS (SELECT file_path, list(DISTINCT md5(file_path || size)) AS sums FROM tracked_file WHERE l_orderkey % 10 <> 1 AND modified_at >= TIMESTAMP '1999-03-01' - INTERVAL '2 days' AND modified_at < TIMESTAMP '1999-03-02'
      AND (file_path LIKE '%.warc.gz' OR file_path LIKE '%/crawl.log.cp%') GROUP BY 1),
    d AS (SELECT file_path, list(DISTINCT sum) AS sums, count(*) - count(sum) AS open FROM (SELECT file_path, CASE WHEN l_orderkey % 10 = 4 THEN NULL ELSE md5(file_path || size || CASE WHEN size % 10 = 1 THEN 'x' ELSE '' END) END AS sum
      FROM tracked_file WHERE l_orderkey % 10 <> 2) GROUP BY 1)
    SELECT file_path, CASE WHEN d.open IS NULL THEN 'missing' WHEN d.open > 0 THEN 'unknown' WHEN len(s.sums) = 1 AND d.sums = s.sums THEN 'match' ELSE 'differ' END AS result FROM s LEFT JOIN d USING (file_path)
    """,
)
def verified_transfer(t: Tables):
    files = t.tracked_file.withColumn("checksum", F.md5(F.concat("file_path", "size").cast("binary")))
    source = files.where("l_orderkey % 10 <> 1")
    torn = F.md5(F.concat("file_path", "size", F.expr("CASE WHEN size % 10 = 1 THEN 'x' ELSE '' END")).cast("binary"))
    target = files.where("l_orderkey % 10 <> 2").withColumn("checksum", F.when(F.col("l_orderkey") % 10 != 4, torn))
    return jobs.verified_transfer(source, target, datetime(1999, 3, 1))


@query(
    "storage_report",
    "B9 J14",
    """
    WITH l AS (SELECT file_path, service AS store FROM tracked_file UNION ALL SELECT file_path, 'cloud' FROM tracked_file WHERE size % 10 <> 0),
    c AS (SELECT file_path, count(*) FILTER (store = 'h020') > 0 AS h020, count(*) FILTER (store = 'h3') > 0 AS h3, count(*) FILTER (store = 'cloud') > 0 AS cloud, count(*) AS copies FROM l GROUP BY 1)
    SELECT copies, CAST(h020 AS INTEGER) + CAST(h3 AS INTEGER) + CAST(cloud AS INTEGER) AS stores, h020, h3, cloud, count(*) AS files FROM c GROUP BY 1, 2, 3, 4, 5
    """,
)
def storage_report(t: Tables):
    files = t.tracked_file
    return jobs.storage_report(
        {"h020": files.where("service = 'h020'"), "h3": files.where("service = 'h3'"), "cloud": files.where("size % 10 <> 0")}
    )


@query(
    "storage_holdings",
    "B9 J14 A9",
    """
    WITH l AS (SELECT file_path, size, service AS store FROM tracked_file UNION ALL SELECT file_path, size, 'cloud' FROM tracked_file WHERE size % 10 <> 0),
    c AS (SELECT substr(file_path, 2) AS name, max(size) AS size, min(size) < max(size) AS size_differs, array_to_string(list_sort(list(DISTINCT store)), '+') AS held_by
      FROM l GROUP BY 1),
    f AS (SELECT *, split_part(name, '/', 1) || CASE WHEN contains(name, '/') THEN '/' || split_part(name, '/', 2) ELSE '' END AS folder FROM c)
    SELECT held_by, folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (size_differs) AS size_differs,
      CAST(grouping(held_by) + grouping(folder) AS INTEGER) AS level FROM f GROUP BY ROLLUP (held_by, folder)
    """,
)
def storage_holdings(t: Tables):
    """Listings as the stores write them: with a scheme and server, with doubled slashes, and cloud keys without a leading slash."""
    files = t.tracked_file
    listings = {
        "h020": files.where("service = 'h020'").withColumn("file_path", F.concat(F.lit("hdfs://h020:54310"), "file_path")),
        "h3": files.where("service = 'h3'").withColumn("file_path", F.regexp_replace("file_path", "/", "//")),
        "cloud": files.where("size % 10 <> 0").withColumn("file_path", F.concat(F.lit("s3://archive"), "file_path")),
    }
    return jobs.storage_holdings(listings)


@query(
    "take_down",
    "B11 J13 A16",
    """
    WITH d AS (SELECT * FROM captures WHERE ts14 >= '20240110000000' AND (starts_with(urlkey, 'uk,co,example,h3)') OR urlkey = 'uk,co,example,h4)/p/1'))
    SELECT content_digest, mimetype, status_code, count(*) AS captures, count(DISTINCT urlkey) AS urls, min(ts) AS first_ts, max(ts) AS last_ts,
      (SELECT count(*) FROM captures) - (SELECT count(*) FROM d) AS remaining FROM d GROUP BY 1, 2, 3
    """,
)
def take_down(t: Tables):
    listed = t.spark.createDataFrame([("uk,co,example,h3)",), ("uk,co,example,h4)/p/1",)], "surt_prefix string")
    run = jobs.take_down(t.captures, listed, "20240110000000")
    return run.profile.withColumn("remaining", run.remaining.select(F.count(F.lit(1))).scalar())


@query(
    "complaint_follow_up",
    "B12 P5",
    """
    WITH h AS (SELECT host, count(*) AS hits FROM crawl_log WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AND regexp_matches(url, '/p/4[0-9]$') GROUP BY 1),
    l AS (SELECT host, count(*) AS n FROM crawl_log WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1)
    SELECT h.host, h.hits, '+uk,co,example,' || split_part(h.host, '.', 1) || ')' AS exclusion, coalesce(l.n, 0) AS fetches_since FROM h LEFT JOIN l USING (host)
    """,
)
def complaint_follow_up(t: Tables):
    return jobs.complaint_follow_up(
        t.crawl_log, "/p/4[0-9]$", datetime(2024, 1, 5), datetime(2024, 1, 6), datetime(2024, 1, 30, 12)
    )


@query(
    "complaint_applied",
    "B12 P17",
    """
    WITH h AS (SELECT DISTINCT host FROM crawl_log WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AND regexp_matches(url, '/p/4[0-9]$'))
    SELECT l.host, count(*) AS fetches, count(*) FILTER (h.host IS NULL) AS still_in_scope FROM crawl_log l LEFT JOIN h ON h.host = l.host
    WHERE l.ts >= TIMESTAMP '2024-01-06' GROUP BY l.host
    """,
)
def complaint_applied(t: Tables):
    """The exclusion lines of a complaint, added to the list and applied to what was fetched later."""
    found = jobs.complaint_follow_up(t.crawl_log, "/p/4[0-9]$", datetime(2024, 1, 5), datetime(2024, 1, 6), datetime(2024, 1, 6))
    return jobs.apply_exclusions(t.crawl_log, found, "exclusion", datetime(2024, 1, 6))


@query(
    "documents_located",
    "B5 P20 J18",
    f"""
    WITH hdr AS (SELECT url AS document_url, {ts14('ts')} AS wayback_timestamp, min(CASE WHEN event_id % 3 = 0 THEN 'http://h' || (event_id % 20) || '.example.co.uk/p/up' END) AS up FROM crawl_log GROUP BY 1, 2),
    """
    + _FOUND.replace("WITH k AS", "k AS", 1).rstrip()
    + f""",
    p AS (SELECT f.document_url, f.wayback_timestamp, coalesce(hdr.up, f.landing_page_url) AS landing_page_url FROM found f LEFT JOIN hdr ON hdr.document_url = f.document_url AND hdr.wayback_timestamp = f.wayback_timestamp),
    q AS (SELECT p.*, {surt('landing_page_url')} AS lk FROM p),
    t AS (SELECT q.document_url, w.target_id, row_number() OVER (PARTITION BY q.document_url ORDER BY length(w.surt_prefix) DESC, w.target_id) AS rn FROM q JOIN {_WATCHED} w ON {covers('w.surt_prefix', 'q.lk')})
    SELECT q.document_url, q.wayback_timestamp, q.landing_page_url, t.target_id FROM q LEFT JOIN t ON t.document_url = q.document_url AND t.rn = 1
    """,
)
def documents_located(t: Tables):
    """Found documents with the landing page their response names, and the target that covers it."""
    headers = t.crawl_log.selectExpr(
        "url AS document_url", "date_format(CAST(ts AS TIMESTAMP), 'yyyyMMddHHmmss') AS wayback_timestamp",
        "CASE WHEN event_id % 3 = 0 THEN concat('<http://h', event_id % 20, '.example.co.uk/p/up>; rel=\"up\"') WHEN event_id % 3 = 1 THEN '<http://x.example/>; rel=next' END AS link",
    )
    located = jobs.locate_documents(_found(t), headers, _watched(t))
    return located.select("document_url", "wayback_timestamp", "landing_page_url", "target_id")


@query(
    "archive_moves",
    "B13 F9 F10",
    """
    WITH f AS (SELECT DISTINCT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d') || '101010123' AS ts17 FROM lineitem),
    l AS (SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y%m%d') || '120000' AS launch_id FROM orders),
    n AS (SELECT '/loose/ARC-' || ts17 || '-' || l_orderkey || '-' || l_linenumber || '~w~8443.warc.gz' AS file_path, left(ts17, 14) AS at FROM f)
    SELECT file_path, '/heritrix/output/frequent-npld/' || launch || '/warcs/' || substr(file_path, 8) AS target_path, CASE WHEN launch IS NULL THEN 'before the first launch' END AS reason
    FROM (SELECT *, (SELECT max(launch_id) FROM l WHERE l.launch_id <= n.at) AS launch FROM n)
    UNION ALL SELECT '/loose/' || r_name || '.warc.gz', NULL, 'no time in the name' FROM region
    """,
)
def archive_moves(t: Tables):
    # Hardly a row comes twice, so nothing is gained by making rows distinct before the shuffle, where a task would hold a whole
    # split of paths; and as rows compress well, partitions merged by their bytes would hold millions. The number given keeps them apart.
    lines = t.lineitem.select(
        F.concat(
            F.lit("/loose/ARC-"), F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyyMMdd"), F.lit("101010123-"), "l_orderkey", F.lit("-"), "l_linenumber",
            F.lit("~w~8443.warc.gz"),
        ).alias("file_path")
    )
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 16 * t.lineitem.rdd.getNumPartitions())
    files = lines.repartition(tasks, "file_path").distinct().unionByName(t.region.select(F.concat(F.lit("/loose/"), "r_name", F.lit(".warc.gz")).alias("file_path")))
    launches = t.orders.select(
        F.concat(F.date_format(F.date_trunc("month", F.col("o_orderdate")), "yyyyMMdd"), F.lit("120000")).alias("launch_id")
    ).distinct()
    return jobs.archive_moves(files, launches, "file_path", "frequent-npld", "/heritrix/output")


@query(
    "tidy_report",
    "B13 A10 W8",
    f"""
    WITH c AS (SELECT DISTINCT split_part(file_path, '/', 4) AS job, l_orderkey AS cp FROM tracked_file WHERE l_returnflag = 'R'),
    g AS (SELECT job, cp, lead(cp) OVER (PARTITION BY job ORDER BY cp) AS nxt FROM c),
    s AS (SELECT job, count(*) AS gaps, CAST(sum(nxt - cp - 1) AS BIGINT) AS missing FROM g WHERE nxt > cp + 1 GROUP BY 1),
    l AS (SELECT split_part(file_path, '/', 4) AS job, count(*) AS logs FROM tracked_file WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT l.job, l.logs, s.gaps, s.missing FROM l LEFT JOIN s USING (job)
    """,
)
def tidy_report(t: Tables):
    jobs_seen = t.tracked_file.where("l_returnflag = 'R'").select(F.split_part("file_path", F.lit("/"), F.lit(4)).alias("job")).distinct()
    growth, gaps = jobs.tidy_report(t.tracked_file, jobs_seen)
    lost = gaps.groupBy("job").agg(F.count(F.lit(1)).alias("gaps"), F.sum("missing").alias("missing"))
    return growth.join(lost, "job", "left").select("job", "logs", "gaps", "missing")


