"""Curated targets, feeds, launches and documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.schedules import is_due
from tidemark.operators import curation, documents, filters, prefixes
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.plans.views import covers, surt, ts14

NOW = datetime(2024, 1, 10)
LAUNCH_HOUR = datetime(2024, 3, 1, 11)


@query(
    "feed_selection",
    "P23",
    """
    SELECT 'npld' AS feed, target_id FROM curated WHERE basis = 'npld' AND frequency <> 'NEVERCRAWL' AND (end_date IS NULL OR end_date >= TIMESTAMP '2024-01-10')
    UNION ALL SELECT 'bypm', target_id FROM curated WHERE basis = 'bypm' AND frequency <> 'NEVERCRAWL' AND NOT hidden AND (end_date IS NULL OR end_date >= TIMESTAMP '2024-01-10')
    UNION ALL SELECT 'never', target_id FROM curated WHERE frequency = 'NEVERCRAWL'
    """,
)
def feed_selection(t: Tables):
    npld = curation.select_feed(t.curated, NOW, basis="npld", include_hidden=True)
    bypm = curation.select_feed(t.curated, NOW, basis="bypm")
    never = curation.select_feed(t.curated, NOW, frequency="NEVERCRAWL", include_hidden=True, include_expired=True)
    out = None
    for name, feed in (("npld", npld), ("bypm", bypm), ("never", never)):
        rows = feed.select(F.lit(name).alias("feed"), "target_id")
        out = rows if out is None else out.unionByName(rows)
    return out


_DUE = """
    start_date IS NOT NULL AND date_trunc('hour', start_date) <= TIMESTAMP '2024-03-01 11:00:00' AND (end_date IS NULL OR end_date >= TIMESTAMP '2024-03-01 11:00:00')
    AND CASE frequency WHEN 'DAILY' THEN hour(start_date) = 11
      WHEN 'WEEKLY' THEN hour(start_date) = 11 AND date_diff('day', CAST(start_date AS DATE), DATE '2024-03-01') % 7 = 0
      ELSE frequency <> 'NEVERCRAWL' AND hour(start_date) = 11 AND ((2024 - year(start_date)) * 12 + 3 - month(start_date)) %
        (CASE frequency WHEN 'MONTHLY' THEN 1 WHEN 'QUARTERLY' THEN 3 WHEN 'SIXMONTHLY' THEN 6 ELSE 12 END) = 0
        AND CAST(start_date + to_months(CAST((2024 - year(start_date)) * 12 + 3 - month(start_date) AS INTEGER)) AS DATE) = DATE '2024-03-01' END
"""


@query("due_targets", "F21", f"SELECT target_id, frequency, start_date FROM curated WHERE {_DUE}")
def due_targets(t: Tables):
    hour = F.lit(LAUNCH_HOUR).cast("timestamp_ntz")
    return t.curated.where(is_due("frequency", "start_date", "end_date", hour)).select(
        "target_id", "frequency", "start_date"
    )


def _sheets():
    return [
        ("recrawl", F.col("frequency").isin("DAILY", "WEEKLY")),
        ("subdomains", F.col("scope") == "subdomains"),
        ("noRobots", F.col("ignore_robots")),
        ("cap-large", F.col("depth") == "capped_large"),
        ("cap", F.col("depth") == "capped"),
    ]


_SHEETS = """concat_ws(',', CASE WHEN frequency IN ('DAILY','WEEKLY') THEN 'recrawl' END, CASE WHEN scope = 'subdomains' THEN 'subdomains' END,
  CASE WHEN ignore_robots THEN 'noRobots' END, CASE depth WHEN 'capped_large' THEN 'cap-large' WHEN 'capped' THEN 'cap' END)"""


@query("option_sheets", "J16", f"SELECT target_id, {_SHEETS} AS sheets FROM curated")
def option_sheets(t: Tables):
    return t.curated.select("target_id", F.array_join(curation.option_sheets(_sheets()), ",").alias("sheets"))


@query(
    "hourly_launches",
    "T5 B7 P22 K4",
    f"""
    WITH due AS (SELECT *, {surt('url')} AS urlkey FROM curated WHERE {_DUE}),
    never AS (SELECT DISTINCT {surt('url')} AS surt_prefix FROM curated WHERE frequency = 'NEVERCRAWL')
    SELECT url, urlkey, target_id, TIMESTAMP '2024-03-01 11:00:00' AS launch_ts, {_SHEETS} AS sheets, '20240301110000:' || url AS message_key
    FROM due d WHERE NOT EXISTS (SELECT 1 FROM never n WHERE {covers('n.surt_prefix', 'd.urlkey')})
    """,
)
def hourly_launches(t: Tables):
    never = t.curated.where("frequency = 'NEVERCRAWL'").select(urls.surt_key("url").alias("surt_prefix")).distinct()
    return curation.launches(t.curated, LAUNCH_HOUR, never, "surt_prefix", _sheets())


@query(
    "page_annotations",
    "J9",
    f"""
    WITH scopes AS (SELECT DISTINCT s.surt_prefix, 'collection ' || length(s.surt_prefix) % 5 AS collection, 'subject ' || length(s.surt_prefix) % 3 AS subject FROM surt_prefixes s),
    hit AS (SELECT p.page_id, array_to_string(list_sort(list_distinct(list(s.collection))), '|') AS collection, array_to_string(list_sort(list_distinct(list(s.subject))), '|') AS subject
      FROM page_record p JOIN scopes s ON {covers('s.surt_prefix', 'p.urlkey')} GROUP BY 1),
    oa AS (SELECT DISTINCT p.page_id FROM page_record p JOIN surt_prefixes s ON s.decision = 'accept' AND {covers('s.surt_prefix', 'p.urlkey')})
    SELECT p.page_id, h.collection, h.subject, CASE WHEN oa.page_id IS NOT NULL THEN 'open' ELSE 'reading room' END AS access_terms
    FROM page_record p LEFT JOIN hit h USING (page_id) LEFT JOIN oa USING (page_id)
    """,
)
def page_annotations(t: Tables):
    scopes = t.surt_prefixes.select(
        "surt_prefix",
        F.expr("concat('collection ', length(surt_prefix) % 5) AS collection"),
        F.expr("concat('subject ', length(surt_prefix) % 3) AS subject"),
    ).distinct()
    pages = prefixes.annotate(t.page_record, "urlkey", scopes, "surt_prefix", ["collection", "subject"])
    allowed = t.surt_prefixes.where("decision = 'accept'")
    flagged = prefixes.flag_covered(pages, "urlkey", allowed, "surt_prefix", "open_access")
    return flagged.select(
        "page_id", "collection", "subject",
        F.when(F.col("open_access"), "open").otherwise("reading room").alias("access_terms"),
    )


_FEED = """(SELECT surt_prefix, min(id) AS target_id FROM (SELECT surt_prefix, length(surt_prefix) % 20 AS id FROM surt_prefixes) GROUP BY 1)"""


def _prefix_feed(t: Tables):
    """Watched prefixes with target ids; some prefixes belong to two targets."""
    one = t.surt_prefixes.select("surt_prefix", F.expr("length(surt_prefix) % 20 AS target_id"))
    two = t.surt_prefixes.where("length(surt_prefix) % 4 = 0").select("surt_prefix", F.expr("length(surt_prefix) % 20 + 7 AS target_id"))
    return one.unionByName(two)


@query(
    "documents_to_targets",
    "J18",
    f"""
    SELECT page_id, surt_prefix AS matched_prefix, target_id FROM (
      SELECT p.page_id, f.surt_prefix, CAST(f.target_id AS INTEGER) AS target_id, row_number() OVER (PARTITION BY p.page_id ORDER BY length(f.surt_prefix) DESC NULLS LAST) AS rn
      FROM page_record p LEFT JOIN {_FEED} f ON {covers('f.surt_prefix', 'p.urlkey')}) WHERE rn = 1
    """,
)
def documents_to_targets(t: Tables):
    out = documents.assign_targets(t.page_record, "urlkey", _prefix_feed(t), "surt_prefix", "target_id")
    return out.select("page_id", "matched_prefix", "target_id")


_WATCHED = "(SELECT 'uk,co,example,h' || i || ')' AS surt_prefix, i AS target_id FROM range(0, 12) r(i))"


def _watched(t: Tables):
    """Watched hosts: the crawl's first twelve."""
    hosts = t.events.where("user_id % 20 < 12").selectExpr("user_id % 20 AS target_id").distinct()
    return hosts.select(F.expr("concat('uk,co,example,h', target_id, ')') AS surt_prefix"), "target_id")


_FOUND = f"""
    WITH k AS (SELECT *, {surt('url')} AS urlkey, 'http://' || host || '/p/' || (event_id % 7) AS landing_page_url, hop_path AS source
      FROM crawl_log WHERE mimetype = 'application/pdf'),
    f AS (SELECT k.*, w.target_id, row_number() OVER (PARTITION BY k.url ORDER BY k.ts, k.event_id) AS rn FROM k JOIN {_WATCHED} w ON {covers('w.surt_prefix', 'k.urlkey')}),
    found AS (SELECT url AS document_url, list_last(string_split(url, '/')) AS filename, landing_page_url, source, {ts14('ts')} AS wayback_timestamp,
      'frequent-npld' AS job_name, size, 'NEW' AS status, target_id FROM f WHERE rn = 1)
"""


@query("documents_found", "J19 P19 B4", _FOUND + "SELECT * FROM found")
def documents_found(t: Tables):
    return _found(t)


def _found(t: Tables):
    events = t.crawl_log.withColumns(
        {
            "landing_page_url": F.expr("concat('http://', host, '/p/', event_id % 7)"),
            "source": F.col("hop_path"),
        }
    )
    return documents.find_documents(events, _watched(t), "surt_prefix", "target_id", "frequent-npld")


@query(
    "watched_documents",
    "P19",
    f"""
    SELECT event_id, url FROM (SELECT *, {surt('url')} AS urlkey FROM crawl_log WHERE starts_with(mimetype, 'application/pdf')) k
    WHERE EXISTS (SELECT 1 FROM {_WATCHED} w WHERE {covers('w.surt_prefix', 'k.urlkey')})
    """,
)
def watched_documents(t: Tables):
    keyed = t.crawl_log.withColumn("urlkey", urls.surt_key("url"))
    return documents.watched_documents(keyed, "urlkey", "mimetype", _watched(t), "surt_prefix").select("event_id", "url")


@query(
    "landing_pages",
    "P20",
    """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'https://www.example.co.uk/landing/' || event_id ELSE 'http://' || host || '/' END AS landing_page FROM crawl_log
    """,
)
def landing_pages(t: Tables):
    linked = t.crawl_log.selectExpr(
        "event_id",
        "concat('http://', host, '/') AS via",
        "CASE WHEN event_id % 3 = 0 THEN concat('<https://www.example.co.uk/landing/', event_id, '>; rel=\"up\"')"
        " WHEN event_id % 3 = 1 THEN '<https://x.example/>; rel=next' END AS link",
    )
    return linked.select("event_id", documents.landing_page("link", "via").alias("landing_page"))


_INDEXED = _FOUND + ", idx AS (SELECT url AS document_url, ts14 AS wayback_timestamp FROM captures WHERE event_id % 3 <> 0)"


def _index(t: Tables):
    return t.captures.where("event_id % 3 <> 0").select(
        F.col("url").alias("document_url"), F.col("ts14").alias("wayback_timestamp")
    )


@query(
    "documents_in_index",
    "J4",
    _INDEXED + "SELECT document_url, wayback_timestamp FROM found SEMI JOIN idx USING (document_url, wayback_timestamp)",
)
def documents_in_index(t: Tables):
    keys = ["document_url", "wayback_timestamp"]
    return documents.present_in_index(_found(t), _index(t), keys).select(*keys)


@query(
    "document_states",
    "T14 K13 J4",
    _INDEXED
    + """SELECT f.document_url, f.wayback_timestamp, CASE WHEN NOT EXISTS (SELECT 1 FROM idx WHERE idx.document_url = f.document_url AND idx.wayback_timestamp = f.wayback_timestamp)
      THEN 'NEW' WHEN f.size > 30000 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status FROM found f""",
)
def document_states(t: Tables):
    keys = ["document_url", "wayback_timestamp"]
    out = documents.next_states(_found(t), _index(t), keys, F.col("size") > 30_000)
    return out.select(*keys, "status")


@query(
    "next_documents",
    "L3",
    "SELECT id, updated_at FROM document WHERE status = 0 ORDER BY updated_at DESC, id LIMIT 400",
)
def next_documents(t: Tables):
    return filters.latest_rows(t.document.where("status = 0"), 400, "updated_at", "id").select("id", "updated_at")


@query(
    "taxonomy_ancestors",
    "J17",
    """
    WITH RECURSIVE edges AS (SELECT 'nation ' || n_nationkey AS child, 'region ' || n_regionkey AS parent FROM nation
       UNION ALL SELECT 'region ' || r_regionkey, 'world' FROM region
       UNION ALL SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer),
    up AS (SELECT child AS node, child AS ancestor, 0 AS depth FROM (SELECT child FROM edges UNION SELECT parent FROM edges)
      UNION ALL SELECT u.node, e.parent, u.depth + 1 FROM up u JOIN edges e ON u.ancestor = e.child)
    SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2
    """,
)
def taxonomy_ancestors(t: Tables):
    edges = (
        t.nation.selectExpr("concat('nation ', n_nationkey) AS child", "concat('region ', n_regionkey) AS parent")
        .unionByName(t.region.selectExpr("concat('region ', r_regionkey) AS child", "'world' AS parent"))
        .unionByName(t.customer.selectExpr("concat('customer ', c_custkey) AS child", "concat('nation ', c_nationkey) AS parent"))
    )
    return curation.taxonomy_ancestors(edges, "child", "parent")


_QA = f"""
    WITH c AS (SELECT *, {surt('url')} AS k, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS h,
      regexp_matches(url, '^https?://[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+(:[0-9]+)?([/?#].*)?$') AS valid FROM curated),
    d AS (SELECT k FROM c GROUP BY k HAVING count(*) > 1),
    problems AS (SELECT target_id, 'bad_url' AS rule FROM c WHERE NOT valid
      UNION ALL SELECT target_id, 'unknown_suffix' FROM c WHERE valid AND NOT EXISTS (SELECT 1 FROM suffix_rules r WHERE h = ltrim(rule, '!') OR ends_with(h, '.' || ltrim(rule, '!*.')))
      UNION ALL SELECT target_id, 'duplicate_url' FROM c WHERE k IN (SELECT k FROM d)
      UNION ALL SELECT target_id, 'no_start_date' FROM c WHERE start_date IS NULL)
"""


def _problems(t: Tables):
    return curation.quality_problems(t.curated, "url", "target_id", t.suffix_rules, "rule")


@query("quality_problems", "F25 B10", _QA + "SELECT target_id, rule FROM problems")
def quality_problems(t: Tables):
    return _problems(t)


@query("quality_summary", "F25 B10", _QA + "SELECT rule, count(*) AS n FROM problems GROUP BY 1")
def quality_summary(t: Tables):
    return curation.quality_summary(_problems(t))


@query(
    "collection_export",
    "K11",
    """
    WITH r AS (SELECT *, (row_number() OVER (PARTITION BY collection_id ORDER BY target_id) - 1) // 25 AS page FROM curated)
    SELECT collection_id, page, '[' || string_agg('{"target_id":' || target_id || ',"title":"' || title || '","hidden":' || hidden || '}', ',' ORDER BY target_id) || ']' AS members,
      count(*) AS n FROM r GROUP BY 1, 2
    """,
)
def collection_export(t: Tables):
    return curation.collection_pages(t.curated, "collection_id", "target_id", ["target_id", "title", "hidden"], 25)


@query(
    "feed_lines",
    "K1",
    """
    SELECT target_id, '{"id":' || target_id || ',"title":"' || title || '","seeds":["' || url || '"],"basis":"' || basis || '"}' AS line
    FROM curated WHERE basis = 'npld' AND frequency <> 'NEVERCRAWL'
    """,
)
def feed_lines(t: Tables):
    feed = t.curated.where("basis = 'npld' AND frequency <> 'NEVERCRAWL'")
    entry = F.struct(F.col("target_id").alias("id"), "title", F.array("url").alias("seeds"), "basis")
    return feed.select("target_id", F.to_json(entry).alias("line"))
