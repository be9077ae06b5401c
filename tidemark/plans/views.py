"""Plain SQL of the derived tables and expression builders for the check SQL.

The SQL side is written on its own (list functions, window functions, joins by ``starts_with``) and
shares only fixed values and the texts that make the derived input tables.
"""

from __future__ import annotations

import re

from tidemark.functions import content
from tidemark.operators import scope

# Columns of the derived inputs; the same text runs on both engines.
EVENTS_K = "SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM {events}"

CRAWL_LOG = f"""
SELECT event_id, ts, concat('http://h',user_id % 20,'.example.co.uk/p/',k) AS url,
 concat('h',user_id % 20,'.example.co.uk') AS host,
 CASE event_type WHEN 'view' THEN 200 WHEN 'purchase' THEN 200 WHEN 'click' THEN 301 WHEN 'signup' THEN 404 ELSE -5003 END AS status_code,
 CASE WHEN k < 10 THEN '' WHEN k < 40 THEN 'L' WHEN k < 70 THEN 'LE' WHEN k < 90 THEN 'LLR' ELSE 'P' END AS hop_path,
 CASE WHEN event_id % 25 = 0 THEN NULL ELSE concat('t',event_id % 8) END AS thread,
 CAST(floor(value*1024) AS BIGINT) AS size,
 CASE WHEN event_type='error' AND k % 2 = 0 THEN 'Q:serverMaxSuccessKb' WHEN k % 17 = 0 THEN '1: stream: Test FOUND' ELSE '' END AS annotations,
 CASE k % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE 'text/html' END AS mimetype,
 md5(concat(user_id % 20,'/',k % 10)) AS content_digest
FROM ({EVENTS_K}) e
"""

DOCUMENT = """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 9 END AS status,
 o_orderdate AS updated_at, o_custkey AS id_watched_target FROM {orders}
"""

TRACKED_FILE = """
SELECT concat('/heritrix/output/',CASE l_linenumber % 3 WHEN 0 THEN 'dc2023' WHEN 1 THEN 'frequent-npld' ELSE 'frequent-bypm' END,
 '/20230101000000/',CASE WHEN l_returnflag='R' THEN 'logs/crawl.log.cp' ELSE 'warcs/ARC-' END,l_orderkey,'-',l_linenumber,'-',l_partkey,
 CASE WHEN l_returnflag='R' THEN '' ELSE '.warc.gz' END) AS file_path,
 CASE l_suppkey % 2 WHEN 0 THEN 'h020' ELSE 'h3' END AS service, CAST(floor(l_extendedprice*100) AS BIGINT) AS size,
 l_shipdate AS modified_at, l_orderkey, l_linenumber, l_returnflag FROM {lineitem}
"""

URL_CASE = """
SELECT event_id, ts, concat(CASE event_id % 3 WHEN 0 THEN 'http://www.' WHEN 1 THEN 'https://' ELSE 'http://User:pw@www2.' END,
 'H',user_id % 20,'.example.co.uk',
 CASE event_id % 13 WHEN 0 THEN '/a/a/a/a/a/x.html' WHEN 1 THEN '/1/2/3/4/5/6/7/8/9/10/11/12/13/14/15/16/x' WHEN 2 THEN '/cart/add/5'
  WHEN 3 THEN '/wp-admin/x.php' WHEN 4 THEN '/img/logo.PNG?v=2'
  WHEN 5 THEN concat('/post?replytocom=',user_id) WHEN 6 THEN concat('/doc/',user_id,'.pdf') WHEN 7 THEN '' WHEN 8 THEN '/?'
  WHEN 9 THEN concat('/s;jsessionid=0123456789abcdef0123456789abcdef?q=',user_id) WHEN 10 THEN concat('/',repeat('y',600))
  WHEN 11 THEN concat('/blog/',user_id % 7,'/')
  WHEN 12 THEN concat('/s?sid=',repeat('a1',16),'&phpsessid=',repeat('b2',16),'&cfid=1&cftoken=2-x&q=',event_id % 3) ELSE concat('/p/',event_id % 50,'?b=2&a=1#top') END) AS url,
 CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'L' WHEN 2 THEN 'LLE' WHEN 3 THEN 'LRRRRR' WHEN 4 THEN 'P' WHEN 5 THEN repeat('L',21) ELSE 'R' END AS hop_path
FROM {events}
"""

# Candidates for every rule of the scope chain: other domains, addresses, shorteners, copies of pages seen before.
SCOPE_CASE = f"""
SELECT event_id, ts, hop_path, concat('192.0.2.', event_id % 256) AS ip,
 CASE event_id % 6 WHEN 0 THEN replace(url, '.example.co.uk', concat('.site', event_id % 9, '.org.uk'))
  WHEN 1 THEN replace(url, '.example.co.uk', '.elsewhere.com') WHEN 2 THEN concat('http://short', event_id % 4, '.example/', event_id % 30)
  WHEN 3 THEN concat('http://h', event_id % 20, '.example.co.uk/page/', event_id % 40) ELSE url END AS url
FROM ({URL_CASE}) u
"""

CURATED_TARGET = """
SELECT c_custkey AS target_id, c_name AS title, c_nationkey AS collection_id,
 CASE WHEN c_custkey % 97 = 0 THEN concat('htp:/bad host',c_custkey)
  WHEN c_custkey % 11 = 0 THEN concat('https://www.site',c_custkey,'.example.invalidtld/')
  ELSE concat('https://www.site',c_custkey % 1200,'.example.co.uk/',CASE WHEN c_custkey % 4 = 0 THEN 'docs/' ELSE '' END) END AS url,
 CASE c_custkey % 7 WHEN 0 THEN 'DAILY' WHEN 1 THEN 'WEEKLY' WHEN 2 THEN 'MONTHLY' WHEN 3 THEN 'QUARTERLY' WHEN 4 THEN 'SIXMONTHLY' WHEN 5 THEN 'ANNUAL' ELSE 'NEVERCRAWL' END AS frequency,
 CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'bypm' ELSE 'npld' END AS basis,
 c_custkey % 10 = 0 AS hidden, c_custkey % 3 = 0 AS watched, c_custkey % 13 = 0 AS ignore_robots,
 CASE WHEN c_acctbal > 5000 THEN 'capped_large' WHEN c_acctbal > 0 THEN 'capped' ELSE 'uncapped' END AS depth,
 CASE c_custkey % 5 WHEN 0 THEN 'root' WHEN 1 THEN 'subdomains' ELSE 'resource' END AS scope,
 c_acctbal > 2000 AS open_access
FROM {customer}
"""

SHARED_TEXT = {
    "crawl_log": CRAWL_LOG,
    "document": DOCUMENT,
    "tracked_file": TRACKED_FILE,
    "url_case": URL_CASE,
    "scope_case": SCOPE_CASE,
    "curated_base": CURATED_TARGET,
}


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_q = text_literal


# Suffix rules of every kind; a real list is a table of the same form.
SUFFIX_RULES = ("uk", "co.uk", "org.uk", "com", "org", "net", "example", "*.ck", "!www.ck", "*.example.net", "!shop.example.net")


# --- expression builders for the check SQL ---------------------------------------------------


# One pattern per canonicalisation rule, in rule order.
URL_PARTS = r"^(?:([a-z][a-z0-9+.\-]*)://)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?"
CANONICAL_STEPS = (
    (r"#.*$", ""),
    (r"^(https?://)[^/?#@]*@", r"\1"),
    (r"^(https?://)www[0-9]*\.", r"\1"),
    (r";jsessionid=[0-9a-z]{32}", ""),
    # a step takes the separator that a neighbouring parameter needs, so it is repeated
    *[(r"([?&])(?:jsessionid|phpsessid|sid)=[0-9a-z]{32}(?:&|$)", r"\1")] * 3,
    *[(r"([?&])aspsessionid[a-z]{8}=[a-z]{24}(?:&|$)", r"\1")] * 2,
    *[(r"([?&])cfid=[0-9]+&cftoken=[0-9a-z\-]+(?:&|$)", r"\1")] * 2,
    (r"[?&]+$", ""),
)


def canonical(url: str) -> str:
    out = f"lower(trim({url}))"
    for pattern, replacement in CANONICAL_STEPS:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(replacement)}, 'g')"
    return out


def host(url: str) -> str:
    return f"regexp_extract(lower({url}), {_q(URL_PARTS)}, 2)"


def reverse_host(name: str) -> str:
    return f"array_to_string(list_reverse(string_split({name}, '.')), ',')"


def surt(url: str) -> str:
    """For URLs without a port."""
    c = canonical(url)
    path = f"regexp_extract({c}, {_q(URL_PARTS)}, 4)"
    return (
        f"({reverse_host(host(c))} || ')' || (CASE WHEN {path} = '' THEN '/' ELSE {path} END)"
        f" || regexp_extract({c}, {_q(URL_PARTS)}, 5))"
    )


def ts14(ts: str) -> str:
    return f"strftime({ts}, '%Y%m%d%H%M%S')"


def covers(prefix: str, key: str) -> str:
    """A prefix covers the key itself or the key without its port."""

    def one(key: str) -> str:
        return (
            f"(starts_with({key}, {prefix}) AND (right({prefix}, 1) IN (',', ')', '/', '?') OR {key} = {prefix}"
            f" OR substr({key}, length({prefix}) + 1, 1) IN (',', ')', '/', '?')))"
        )

    portless = f"regexp_replace({key}, '^([^:)]*):[0-9]+[)]', '\\1)')"
    return f"({one(key)} OR (contains({key}, ':') AND {one(portless)}))"


def page_text(html: str) -> str:
    out = html
    for pattern in (content.COMMENTS, content.SCRIPTS, content.STYLES, content.TAGS):
        out = f"regexp_replace({out}, {_q(pattern)}, ' ', 'g')"
    for entity, char in content.ENTITIES:
        out = f"replace({out}, {_q(entity)}, {_q(char)})"
    return f"trim(regexp_replace({out}, {_q(content.SPACES)}, ' ', 'g'))"


def excluded(url: str) -> str:
    return "(" + " OR ".join(f"regexp_full_match({url}, {_q(p)})" for p in scope.EXCLUDE_PATTERNS) + ")"


def path_of(url: str) -> str:
    return f"regexp_extract({url}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"


def repeated(url: str) -> str:
    """Four equal closed segments in a row, by list positions."""
    parts = f"string_split({path_of(url)}, '/')"
    return (
        f"(len(list_filter(range(2, len({parts}) - 3), lambda i: {parts}[i] = {parts}[i+1] AND {parts}[i] = {parts}[i+2]"
        f" AND {parts}[i] = {parts}[i+3])) > 0)"
    )


def too_deep(url: str) -> str:
    return f"(len(list_filter(string_split({path_of(url)}, '/'), lambda s: s <> '')) > 15)"


# --- derived tables only the check SQL needs -------------------------------------------------

VIEWS: dict[str, str] = {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in SHARED_TEXT.items()}
VIEWS |= {
    "suffix_rules": f"SELECT unnest([{', '.join(map(text_literal, SUFFIX_RULES))}]) AS rule",
    "captures": f"SELECT *, {surt('url')} AS urlkey, {ts14('ts')} AS ts14 FROM crawl_log WHERE status_code BETWEEN 1 AND 600",
    "page_record": f"""SELECT page_id, url, html, {surt('url')} AS urlkey, {host('url')} AS host,
        CASE page_id % 10 WHEN 0 THEN 301 WHEN 1 THEN 404 ELSE 200 END AS status_code,
        CASE WHEN page_id % 7 = 0 THEN 'metadata' ELSE 'response' END AS record_type FROM pages""",
    "surt_prefixes": f"""
        SELECT DISTINCT {reverse_host(f"regexp_replace({host('url')}, '^www[0-9]*[.]', '')")} || ')' AS surt_prefix, 'accept' AS decision FROM pages WHERE page_id % 3 = 0
        UNION ALL
        SELECT DISTINCT {reverse_host(f"regexp_replace({host('url')}, '^www[0-9]*[.]', '')")} || ')/en', 'reject' FROM pages WHERE page_id % 5 = 0""",
    "scope_accept": "SELECT DISTINCT 'uk,co,example,h' || (user_id % 20) || ')' AS surt_prefix FROM events WHERE user_id % 20 < 15",
    "scope_exclude": "SELECT DISTINCT 'uk,co,example,h' || (user_id % 20) || ')/blog/' AS surt_prefix FROM events WHERE user_id % 2 = 0",
    "curated": """SELECT *, CASE WHEN target_id % 17 = 0 THEN NULL
            ELSE TIMESTAMP '2023-01-01 09:30:00' + to_days(CAST(target_id % 300 AS INTEGER)) + to_hours(CAST(target_id % 5 AS INTEGER)) END AS start_date,
        CASE WHEN target_id % 9 = 0 THEN TIMESTAMP '2023-12-31 00:00:00' + to_days(CAST(target_id % 40 AS INTEGER)) END AS end_date
        FROM curated_base""",
    "counter_samples": """SELECT kind, ts, CAST(sum(n) OVER (PARTITION BY kind, date_trunc('day', ts) ORDER BY ts) AS BIGINT) AS value
        FROM (SELECT event_type AS kind, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2)""",
    "offset_samples": """SELECT part, ts, CAST(sum(n) OVER (PARTITION BY part ORDER BY ts) AS BIGINT) AS value
        FROM (SELECT event_id % 4 AS part, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2)""",
    "ip_lists": """SELECT * FROM (VALUES
        (0, 'Main', '192.0.2.0/28, 192.0.2.16/29, 198.51.100.7'),
        (1, 'North', '192.0.2.64/26,192.0.2.32/31,192.0.2.34/32'),
        (2, 'South', '192.0.2.128/25'),
        (3, 'Annex', '192.0.2.200/30, 203.0.113.0/24')) t(location_id, location, ips)""",
}


def with_views(body: str) -> str:
    """Put the derived tables a query names in front of it, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    own = ""
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if match:
        own, body = ", ", body[match.end():]
    if not needed:
        return ("WITH RECURSIVE " if own else "") + body
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed) + (own or " ") + body
