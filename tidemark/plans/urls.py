"""URL keys, scope rules, prefix joins, access rules, address lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import curation, filters, network, prefixes, scope
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.plans.views import (
    canonical,
    covers,
    excluded,
    host,
    repeated,
    reverse_host,
    surt,
    text_literal,
    too_deep,
)
from tidemark.session import shared_dir
from tidemark.sinks import exports
from tidemark.sources.tables import clean_url_lines


@query("url_list", "S13", "SELECT trim(url) AS url FROM pages WHERE trim(url) <> ''")
def url_list(t: Tables):
    return clean_url_lines(t.pages, "url")




@query(
    "canonical_urls",
    "F1",
    f"SELECT page_id AS id, 'page' AS kind, {canonical('url')} AS canonical FROM pages"
    f" UNION ALL SELECT event_id, 'case', {canonical('url')} FROM url_case",
)
def canonical_urls(t: Tables):
    pages = t.pages.select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), "url")
    cases = t.url_case.select(F.col("event_id").alias("id"), F.lit("case").alias("kind"), "url")
    return pages.unionByName(cases).select("id", "kind", urls.canonical_url("url").alias("canonical"))


@query(
    "surt_keys",
    "F2",
    f"SELECT page_id AS id, 'page' AS kind, {surt('url')} AS urlkey FROM pages"
    f" UNION ALL SELECT event_id, 'case', {surt('url')} FROM url_case",
)
def surt_keys(t: Tables):
    pages = t.pages.select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), "url")
    cases = t.url_case.select(F.col("event_id").alias("id"), F.lit("case").alias("kind"), "url")
    return pages.unionByName(cases).select("id", "kind", urls.surt_key("url").alias("urlkey"))


@query(
    "host_parts",
    "F4",
    f"""
    SELECT page_id, {host('url')} AS host, split_part(url, ':', 1) || '://' || {host('url')} ||
      CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END AS server,
     {reverse_host(host(canonical('url')))} AS authority,
     array_to_string(list_slice(string_split({host('url')}, '.'), -2, -1), '.') AS domain FROM pages
    """,
)
def host_parts(t: Tables):
    return t.pages.select(
        "page_id",
        urls.url_host("url").alias("host"),
        urls.url_server("url").alias("server"),
        urls.surt_authority("url").alias("authority"),
        urls.registered_domain(urls.url_host("url")).alias("domain"),
    )


@query(
    "document_filenames",
    "F11",
    """
    WITH p AS (SELECT page_id AS id, 'page' AS kind, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM pages
      UNION ALL SELECT event_id, 'case', regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') FROM url_case)
    SELECT id, kind, CASE WHEN path = '' OR right(path, 1) = '/' THEN 'index' ELSE url_decode(list_last(string_split(path, '/'))) END AS filename FROM p
    """,
)
def document_filenames(t: Tables):
    pages = t.pages.select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), "url")
    cases = t.url_case.select(F.col("event_id").alias("id"), F.lit("case").alias("kind"), "url")
    return pages.unionByName(cases).select("id", "kind", urls.document_filename("url").alias("filename"))


@query(
    "exclude_list_hits",
    "P11",
    f"SELECT event_id, url FROM url_case WHERE {excluded('url')}",
)
def exclude_list_hits(t: Tables):
    return t.url_case.where(scope.is_excluded("url")).select("event_id", "url")


@query(
    "helper_assets",
    "P12",
    "SELECT event_id, regexp_matches(url, "
    + text_literal(rf"^https?://[^/]+/.+(?i:\.(?:{scope.ASSET_EXTENSIONS}))\b.*$")
    + ") AS is_asset FROM url_case",
)
def helper_assets(t: Tables):
    return t.url_case.select("event_id", scope.is_helper_asset("url").alias("is_asset"))


@query(
    "hop_path_rules",
    "P13 P14 P26",
    """
    SELECT event_id, regexp_matches(hop_path, '[ER]$') AS embed, right(hop_path, 5) = 'RRRRR' AS redirects,
     hop_path <> '' AND left(hop_path, 1) = 'P' AND replace(substr(hop_path, 2), 'R', '') = '' AS no_quota,
     length(hop_path) > 20 AS too_far, hop_path <> '' AND replace(hop_path, 'R', '') = '' AS seed_redirect FROM url_case
    """,
)
def hop_path_rules(t: Tables):
    return t.url_case.select(
        "event_id",
        scope.ends_in_embed_or_redirect("hop_path").alias("embed"),
        scope.ends_in_five_redirects("hop_path").alias("redirects"),
        scope.bypasses_quota("hop_path").alias("no_quota"),
        scope.too_many_hops("hop_path").alias("too_far"),
        scope.is_redirected_seed("hop_path").alias("seed_redirect"),
    )


@query(
    "path_rules",
    "P15 P16",
    f"SELECT event_id, {repeated('url')} AS repeated, {too_deep('url')} AS too_deep FROM url_case",
)
def path_rules(t: Tables):
    return t.url_case.select(
        "event_id", scope.repeats_segment("url").alias("repeated"), scope.path_too_deep("url").alias("too_deep")
    )


_SCOPE = f"""
    WITH keyed AS (SELECT *, {surt('url')} AS urlkey FROM url_case),
    flagged AS (SELECT k.*, EXISTS (SELECT 1 FROM scope_accept a WHERE {covers('a.surt_prefix', 'k.urlkey')}) AS in_scope,
      EXISTS (SELECT 1 FROM scope_exclude x WHERE {covers('x.surt_prefix', 'k.urlkey')}) AS shut FROM keyed k),
    decided AS (SELECT event_id, ts, url, hop_path, CASE
      WHEN right(hop_path, 1) = 'P' THEN 'prerequisite'
      WHEN shut THEN 'excluded_prefix'
      WHEN {too_deep('url')} THEN 'path_too_deep'
      WHEN {repeated('url')} THEN 'repeated_segment'
      WHEN {excluded('url')} THEN 'excluded_pattern'
      WHEN right(hop_path, 5) = 'RRRRR' THEN 'five_redirects'
      WHEN length(hop_path) > 20 THEN 'too_many_hops'
      WHEN right(hop_path, 1) IN ('E', 'R') THEN 'embed_or_redirect'
      WHEN regexp_matches(url, {text_literal(rf"^https?://[^/]+/.+(?i:[.](?:{scope.ASSET_EXTENSIONS}))\b.*$")}) THEN 'helper_asset'
      WHEN in_scope THEN 'seed_prefix' ELSE 'start' END AS rule FROM flagged)
"""
_ACCEPTING = "('prerequisite', 'embed_or_redirect', 'helper_asset', 'seed_prefix')"


def scope_decisions_of(t: Tables):
    keyed = t.url_case.withColumn("urlkey", urls.surt_key("url"))
    keyed = prefixes.flag_covered(keyed, "urlkey", t.scope_accept, "surt_prefix", "in_scope")
    keyed = prefixes.flag_covered(keyed, "urlkey", t.scope_exclude, "surt_prefix", "shut")
    verdict = scope.decide(scope.standard_rules("url", "hop_path", F.col("in_scope"), F.col("shut")))
    return keyed.select("event_id", "ts", "url", "hop_path", verdict.alias("verdict")).select(
        "event_id", "ts", "url", "hop_path", "verdict.*"
    )


@query(
    "scope_decisions",
    "P17",
    _SCOPE + f"SELECT event_id, CASE WHEN rule IN {_ACCEPTING} THEN 'ACCEPT' ELSE 'REJECT' END AS decision, rule FROM decided",
)
def scope_decisions(t: Tables):
    return scope_decisions_of(t).select("event_id", "decision", "rule")


@query(
    "scope_rule_totals",
    "P17 T9",
    _SCOPE + f"SELECT CASE WHEN rule IN {_ACCEPTING} THEN 'ACCEPT' ELSE 'REJECT' END AS decision, rule, count(*) AS n FROM decided GROUP BY 1, 2",
)
def scope_rule_totals(t: Tables):
    return scope_decisions_of(t).groupBy("decision", "rule").agg(F.count(F.lit(1)).alias("n"))


_COUNTRY_NETS = (("GB", "192.0.2.0/26"), ("FR", "192.0.2.64/26"), ("GB", "192.0.2.192/28"))
_STAGED = f"""
    WITH keyed AS (SELECT *, {surt('url')} AS urlkey, {host('url')} AS host FROM scope_case),
    seen AS (SELECT urlkey, max(ts) AS captured_at FROM keyed WHERE event_id % 10 = 3 GROUP BY urlkey),
    flagged AS (SELECT k.*, EXISTS (SELECT 1 FROM scope_accept a WHERE {covers('a.surt_prefix', 'k.urlkey')}) AS in_scope,
      EXISTS (SELECT 1 FROM scope_exclude x WHERE {covers('x.surt_prefix', 'k.urlkey')}) AS shut,
      regexp_matches(host, '(^|[.])site[0-4][.]org[.]uk$') AS on_domain, event_id % 256 < 64 OR event_id % 256 BETWEEN 192 AND 207 AS in_country,
      regexp_matches(k.urlkey, '^example,short[0-2][)]') AS shortener,
      coalesce(TIMESTAMP '2024-02-01' - s.captured_at < INTERVAL '10 days', FALSE) AS seen FROM keyed k LEFT JOIN seen s ON s.urlkey = k.urlkey),
    early AS (SELECT *, CASE WHEN right(hop_path, 1) IN ('E', 'R') THEN 'embed_or_redirect'
      WHEN regexp_matches(url, {text_literal(rf"^https?://[^/]+/.+(?i:[.](?:{scope.ASSET_EXTENSIONS}))\b.*$")}) THEN 'helper_asset'
      WHEN in_scope THEN 'seed_prefix' WHEN on_domain THEN 'on_domain' WHEN in_country THEN 'in_country' WHEN shortener THEN 'url_shortener' ELSE 'start' END AS accepted FROM flagged),
    cut AS (SELECT *, CASE WHEN {too_deep('url')} THEN 'path_too_deep' WHEN {repeated('url')} THEN 'repeated_segment' WHEN {excluded('url')} THEN 'excluded_pattern'
      WHEN right(hop_path, 5) = 'RRRRR' THEN 'five_redirects' WHEN length(hop_path) > 20 THEN 'too_many_hops' END AS cut FROM early),
    decided AS (SELECT event_id, CASE WHEN right(hop_path, 1) = 'P' THEN 'prerequisite' WHEN cut IS NOT NULL THEN cut WHEN accepted = 'start' THEN 'start'
      WHEN shut THEN 'excluded_prefix' WHEN seen THEN 'seen_recently' ELSE accepted END AS rule FROM cut)
    SELECT event_id, CASE WHEN rule IN ('prerequisite', 'embed_or_redirect', 'helper_asset', 'seed_prefix', 'on_domain', 'in_country', 'url_shortener') THEN 'ACCEPT' ELSE 'REJECT' END AS decision, rule FROM decided
"""


def staged_chain(t: Tables, rows: DataFrame) -> list:
    """The whole chain over ``rows`` (url, hop_path, urlkey, host, ip, now) with its lists, ranges and captures."""
    seeds = t.events.selectExpr("concat('www.site', event_id % 5, '.org.uk') AS seed_host").distinct()
    short = t.events.selectExpr("concat('example,short', event_id % 3, ')') AS surt_prefix").distinct()
    nets = t.spark.createDataFrame(list(_COUNTRY_NETS), "country string, nets string")
    captured = rows.where("event_id % 10 = 3").select("urlkey", F.col("ts").alias("captured_at"))
    return scope.staged_rules(
        "url",
        "hop_path",
        in_scope=scope.prefix_lookup("seed_prefix", "urlkey", t.scope_accept, "surt_prefix", scope.ACCEPT),
        on_domain=scope.domain_lookup("on_domain", "host", seeds, "seed_host", t.suffix_rules, "rule"),
        in_country=scope.country_lookup("in_country", "ip", network.cidr_ranges(nets, "nets", ["country"]), ["GB"]),
        shortener=scope.prefix_lookup("url_shortener", "urlkey", short, "surt_prefix", scope.ACCEPT),
        excluded_prefix=scope.prefix_lookup("excluded_prefix", "urlkey", t.scope_exclude, "surt_prefix", scope.REJECT),
        seen_recently=scope.seen_lookup("seen_recently", "urlkey", "now", captured, "captured_at", 10 * 86_400),
    )


def scope_cases(t: Tables) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return t.scope_case.withColumns({"urlkey": urls.surt_key("url"), "host": urls.url_host("url"), "now": now})


@query("scope_staged", "P17 P21 J7 J11", _STAGED)
def scope_staged(t: Tables):
    """Every rule of the chain with its join; a join sees only the rows whose verdict it can change."""
    rows = scope_cases(t)
    return scope.decide_in_stages(rows, staged_chain(t, rows)).select("event_id", "decision", "rule")


@query(
    "longest_prefix",
    "J3",
    f"""
    WITH hit AS (SELECT p.page_id, p.urlkey, s.surt_prefix, s.decision,
       row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.surt_prefix) DESC) AS rn
      FROM page_record p JOIN surt_prefixes s ON {covers('s.surt_prefix', 'p.urlkey')})
    SELECT p.page_id, p.urlkey, h.surt_prefix, h.decision FROM page_record p LEFT JOIN hit h ON h.page_id = p.page_id AND h.rn = 1
    """,
)
def longest_prefix(t: Tables):
    found = prefixes.longest_prefix(t.page_record, "urlkey", t.surt_prefixes, "surt_prefix")
    return found.select("page_id", "urlkey", "surt_prefix", "decision")


@query(
    "all_prefix_hits",
    "J3",
    f"""
    SELECT DISTINCT p.urlkey, s.surt_prefix, s.decision FROM page_record p JOIN surt_prefixes s ON {covers('s.surt_prefix', 'p.urlkey')}
    """,
)
def all_prefix_hits(t: Tables):
    return prefixes.prefix_hits(t.page_record, "urlkey", t.surt_prefixes, "surt_prefix")


@query(
    "never_crawl_filter",
    "P22 J3",
    f"""
    SELECT page_id, urlkey FROM page_record p WHERE NOT EXISTS (
      SELECT 1 FROM surt_prefixes s WHERE s.decision = 'reject' AND {covers('s.surt_prefix', 'p.urlkey')})
    """,
)
def never_crawl_filter(t: Tables):
    shut = t.surt_prefixes.where("decision = 'reject'")
    return prefixes.not_covered(t.page_record, "urlkey", shut, "surt_prefix").select("page_id", "urlkey")


@query(
    "feed_violations",
    "U5",
    f"""
    SELECT page_id, urlkey FROM page_record p WHERE EXISTS (
      SELECT 1 FROM surt_prefixes s WHERE s.decision = 'reject' AND {covers('s.surt_prefix', 'p.urlkey')})
    """,
)
def feed_violations(t: Tables):
    shut = t.surt_prefixes.where("decision = 'reject'")
    return curation.feed_violations(t.page_record, shut, "urlkey", "surt_prefix").select("page_id", "urlkey")


@query(
    "effective_access",
    "U4",
    f"""
    WITH rules AS (SELECT surt_prefix, 'allow' AS access FROM surt_prefixes WHERE decision = 'accept'
      UNION ALL SELECT surt_prefix, 'block' FROM surt_prefixes WHERE decision = 'reject'
      UNION ALL SELECT surt_prefix, 'block' FROM surt_prefixes WHERE decision = 'accept' AND length(surt_prefix) % 2 = 0),
    hit AS (SELECT p.page_id, r.surt_prefix, r.access, row_number() OVER (PARTITION BY p.page_id
      ORDER BY length(r.surt_prefix) DESC, CASE r.access WHEN 'block' THEN 0 ELSE 1 END) AS rn
      FROM page_record p JOIN rules r ON {covers('r.surt_prefix', 'p.urlkey')})
    SELECT p.page_id, h.surt_prefix AS access_rule, coalesce(h.access, 'block') AS access
    FROM page_record p LEFT JOIN hit h ON h.page_id = p.page_id AND h.rn = 1
    """,
)
def effective_access(t: Tables):
    listed = t.surt_prefixes
    allows = listed.where("decision = 'accept'")
    blocks = listed.where("decision = 'reject' OR length(surt_prefix) % 2 = 0")
    out = prefixes.effective_access(t.page_record, "urlkey", blocks, allows)
    return out.select("page_id", "access_rule", "access")




@query(
    "licence_allows",
    "P24 K2",
    f"SELECT DISTINCT {surt('url')} AS value FROM curated_base WHERE open_access",
)
def licence_allows(t: Tables):
    open_targets = t.curated_base.where("open_access")
    return exports.prefix_lines(open_targets.withColumn("surt", urls.surt_key("url")), "surt")


@query(
    "access_list_lines",
    "K3",
    """
    SELECT DISTINCT surt_prefix || ' - {"access":"' || CASE decision WHEN 'accept' THEN 'allow' ELSE 'block' END
      || '","url":"' || surt_prefix || '"}' AS value FROM surt_prefixes
    """,
)
def access_list_lines(t: Tables):
    rules = t.surt_prefixes.withColumn("access", F.expr("CASE decision WHEN 'accept' THEN 'allow' ELSE 'block' END"))
    return exports.access_lines(rules, "surt_prefix", "access")


@query(
    "access_list_order",
    "K3",
    """
    WITH v AS (SELECT DISTINCT surt_prefix || ' - {"access":"' || CASE decision WHEN 'accept' THEN 'allow' ELSE 'block' END
      || '","url":"' || surt_prefix || '"}' AS value FROM surt_prefixes)
    SELECT row_number() OVER (ORDER BY value DESC) AS line_no, value FROM v
    """,
)
def access_list_order(t: Tables):
    """The written list, line by line as it lies in its files."""
    folder = shared_dir(t.spark, "access-list")
    rules = t.surt_prefixes.withColumn("access", F.expr("CASE decision WHEN 'accept' THEN 'allow' ELSE 'block' END"))
    exports.write_access_list(rules, "surt_prefix", "access", folder)
    return exports.read_lines(t.spark, folder, "line_no")


@query(
    "assembled_seeds",
    "U6",
    f"""
    WITH u AS (SELECT url, 'curated' AS source, 0 AS r FROM curated_base
      UNION ALL SELECT 'http://site' || c_custkey || '.example.co.uk/', 'registry', 1 FROM customer
      UNION ALL SELECT url, 'pages', 2 FROM pages),
    k AS (SELECT *, {surt('url')} AS urlkey FROM u)
    SELECT urlkey, url, source FROM (SELECT *, row_number() OVER (PARTITION BY urlkey ORDER BY r, url) AS rn FROM k) WHERE rn = 1
    """,
)
def assembled_seeds(t: Tables):
    registry = t.customer.selectExpr("concat('http://site', c_custkey, '.example.co.uk/') AS url")
    return curation.assemble_seeds(
        [("curated", t.curated_base), ("registry", registry), ("pages", t.pages)], "url"
    )


@query(
    "seed_scope_list",
    "U6 K2",
    "SELECT DISTINCT split_part(urlkey, ')', 1) || ')' AS surt_prefix FROM page_record",
)
def seed_scope_list(t: Tables):
    return curation.scope_list(t.page_record, "urlkey")


_IP = "'192.0.2.' || (user_id % 256)"
_RANGES = """(VALUES (0,'Main','192.0.2.',0,15),(0,'Main','192.0.2.',16,23),(0,'Main','198.51.100.',7,7),(1,'North','192.0.2.',64,127),
  (1,'North','192.0.2.',32,33),(1,'North','192.0.2.',34,34),(2,'South','192.0.2.',128,255),(3,'Annex','192.0.2.',200,203),
  (3,'Annex','203.0.113.',0,255)) r(location_id, location, net, a, b)"""


@query(
    "address_location",
    "J11",
    f"""
    WITH c AS (SELECT event_id, {_IP} AS ip, CAST(user_id % 256 AS INTEGER) AS last FROM events),
    hit AS (SELECT c.event_id, r.location_id, r.location, row_number() OVER (PARTITION BY event_id ORDER BY r.b - r.a, r.location_id) AS rn
      FROM c JOIN {_RANGES} ON r.net = '192.0.2.' AND c.last BETWEEN r.a AND r.b)
    SELECT c.event_id, c.ip, h.location_id, h.location FROM c LEFT JOIN hit h ON h.event_id = c.event_id AND h.rn = 1
    """,
)
def address_location(t: Tables):
    clients = t.events.selectExpr("event_id", "concat('192.0.2.', user_id % 256) AS ip")
    ranges = network.cidr_ranges(t.ip_lists, "ips", ["location_id", "location"])
    found = network.lookup_ranges(clients, "ip", ranges, ["location_id", "location"])
    return found.select("event_id", "ip", "location_id", "location")


@query(
    "country_accept",
    "P21 J11 P17",
    f"""
    WITH c AS (SELECT event_id, CAST(user_id % 256 AS INTEGER) AS last FROM events)
    SELECT event_id, last < 128 AS in_country, CASE WHEN last < 128 THEN 'ACCEPT' ELSE 'REJECT' END AS decision FROM c
    """,
)
def country_accept(t: Tables):
    clients = t.events.selectExpr("event_id", "concat('192.0.2.', user_id % 256) AS ip")
    blocks = t.spark.createDataFrame([("GB", "192.0.2.0/25"), ("FR", "192.0.2.128/25")], "country string, nets string")
    found = network.lookup_ranges(clients, "ip", network.cidr_ranges(blocks, "nets", ["country"]), ["country"])
    verdict = scope.decide([scope.Rule("in_country", F.col("country") == "GB", scope.ACCEPT)])
    return found.select("event_id", (F.coalesce(F.col("country") == "GB", F.lit(False))).alias("in_country"), verdict["decision"].alias("decision"))


@query(
    "key_lookup",
    "P27",
    """
    SELECT 'exact' AS match_type, page_id FROM page_record WHERE urlkey = (SELECT min(urlkey) FROM page_record)
    UNION ALL SELECT 'prefix', page_id FROM page_record WHERE starts_with(urlkey, 'com,example,')
    UNION ALL SELECT 'host', page_id FROM page_record WHERE starts_with(urlkey, 'com,example,cheap-pills)')
    UNION ALL SELECT 'domain', page_id FROM page_record WHERE starts_with(urlkey, 'net,example)') OR starts_with(urlkey, 'net,example,')
    """,
)
def key_lookup(t: Tables):
    first = t.page_record.select(F.min("urlkey")).scalar()
    wanted = [("exact", first), ("prefix", "com,example,"), ("host", "com,example,cheap-pills"), ("domain", "net,example")]
    out = None
    for match_type, value in wanted:
        hits = filters.match_urls(t.page_record, "urlkey", value, match_type).select(
            F.lit(match_type).alias("match_type"), "page_id"
        )
        out = hits if out is None else out.unionByName(hits)
    return out


@query(
    "authority_partitions",
    "T15",
    "SELECT count(DISTINCT host) AS authorities, CAST(1 AS BIGINT) AS partitions_per_authority FROM crawl_log",
)
def authority_partitions(t: Tables):
    """Publishing by authority: every authority's messages are in one of the 16 partitions."""
    from tidemark.sources.topics import partition_by_authority

    placed = partition_by_authority(t.crawl_log, "url").withColumn("_part", F.spark_partition_id())
    per_host = placed.groupBy("message_key").agg(F.count_distinct("_part").alias("parts"))
    return per_host.agg(
        F.count(F.lit(1)).alias("authorities"), F.max("parts").cast("bigint").alias("partitions_per_authority")
    )


_KEY = reverse_host(host("url"))


@query(
    "published_partitions",
    "T15 K4",
    f"""
    WITH m AS (SELECT {_KEY} AS key, event_id FROM crawl_log)
    SELECT key, CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 16 AS INTEGER) AS partition, count(*) AS messages,
      CAST(sum(event_id) AS BIGINT) AS event_ids FROM m GROUP BY 1
    """,
)
def published_partitions(t: Tables):
    """Key and partition number of every message as published, with what its messages say."""
    from tidemark.sources.topics import placed_messages

    sent = placed_messages(t.crawl_log, "url", ["event_id", "url"])
    event_id = F.get_json_object("value", "$.event_id").cast("long")
    return sent.groupBy("key", "partition").agg(F.count(F.lit(1)).alias("messages"), F.sum(event_id).alias("event_ids"))


