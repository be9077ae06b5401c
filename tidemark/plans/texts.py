"""Page content and text index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import content, urls
from tidemark.operators import filters, suffixes, textindex
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.plans.views import host, page_text, text_literal


@query(
    "page_records",
    "S9",
    """
    SELECT page_id, urlkey, host, status_code, record_type, length(html) AS chars FROM page_record
    """,
)
def page_records(t: Tables):
    return t.page_record.select(
        "page_id", "urlkey", "host", "status_code", "record_type", F.length("html").cast("bigint").alias("chars")
    )


@query(
    "index_records",
    "P9",
    """
    SELECT page_id, url FROM page_record WHERE record_type = 'response' AND starts_with(CAST(status_code AS VARCHAR), '2')
     AND (starts_with(url, 'http:') OR starts_with(url, 'https:')) AND NOT regexp_matches(url, 'utm_source')
    """,
)
def index_records(t: Tables):
    return filters.index_records(t.page_record, url_excludes=["utm_source"]).select("page_id", "url")


@query("page_texts", "F15", f"SELECT page_id, {page_text('html')} AS text FROM pages")
def page_texts(t: Tables):
    return t.pages.select("page_id", content.html_text("html").alias("text"))


@query("payload_digests", "F14", "SELECT page_id, sha1(html) AS digest, CAST(32 AS INTEGER) AS base32_chars FROM pages")
def payload_digests(t: Tables):
    digests = t.pages.select("page_id", content.payload_sha1("html").alias("digest"))
    return digests.withColumn("base32_chars", F.length(content.sha1_base32("digest")))


@query(
    "elements_used",
    "F18",
    f"""
    SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, {text_literal(content.ELEMENT)}, 1), lambda e: lower(e)))), ',') AS elements FROM pages
    """,
)
def elements_used(t: Tables):
    return t.pages.select("page_id", F.array_join(content.elements_used("html"), ",").alias("elements"))


_LINKED = """(SELECT page_id, url, html || '<a class="x" href="http://Other' || (page_id % 5) || '.example.co.uk/a?b">x</a><a href=''//cdn.example.org/y''>y</a><a href="mailto:a@b.example">m</a>' AS html FROM pages)"""


@query(
    "outlink_hosts",
    "F19",
    f"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, {text_literal(content.HREF)}, 1)) AS link FROM {_LINKED}),
    h AS (SELECT DISTINCT page_id, CASE WHEN starts_with(link, 'http') THEN {host('link')} WHEN starts_with(link, '//') THEN split_part(link, '/', 3) ELSE {host('url')} END AS host
      FROM l WHERE NOT starts_with(link, 'mailto:'))
    SELECT page_id, host, CASE WHEN host LIKE '%.co.uk' THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')
      ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain FROM h
    """,
)
def outlink_hosts(t: Tables):
    return _linked_hosts(t).withColumn("domain", urls.registered_domain("host"))


def _linked_hosts(t: Tables) -> DataFrame:
    pages = t.pages.withColumn(
        "html",
        F.expr(
            "concat(html, '<a class=\"x\" href=\"http://Other', page_id % 5, '.example.co.uk/a?b\">x</a>',"
            " \"<a href='//cdn.example.org/y'>y</a>\", '<a href=\"mailto:a@b.example\">m</a>')"
        ),
    )
    return pages.select("page_id", F.explode(content.outlink_hosts("html", "url")).alias("host"))


_SUFFIXED = """(SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN 'a.b' WHEN 1 THEN 'www' WHEN 2 THEN 'shop' ELSE 'x.shop' END,
      CASE page_id % 7 WHEN 0 THEN '.ck' WHEN 1 THEN '.example.net' WHEN 2 THEN '.Site.co.uk' WHEN 3 THEN '.unlisted.zz' WHEN 4 THEN '' WHEN 5 THEN '.uk' ELSE '.net' END) AS host FROM {pages}
    UNION ALL SELECT page_id, host FROM {linked})"""
_DOMAINS = """
    h AS (SELECT DISTINCT host, string_split(lower(host), '.') AS l FROM hosts),
    t AS (SELECT host, l, unnest(range(1, len(l) + 1)) AS n FROM h),
    m AS (SELECT t.host, t.n, r.rule FROM t JOIN suffix_rules r ON r.rule = array_to_string(list_slice(l, len(l) - n + 1, len(l)), '.')
      OR (n > 1 AND r.rule = '*.' || array_to_string(list_slice(l, len(l) - n + 2, len(l)), '.')) OR r.rule = '!' || array_to_string(list_slice(l, len(l) - n + 1, len(l)), '.')),
    b AS (SELECT host, CASE WHEN starts_with(rule, '!') THEN n - 1 ELSE n END AS take FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY starts_with(rule, '!') DESC, n DESC) AS rn FROM m) WHERE rn = 1),
    d AS (SELECT h.host, array_to_string(list_slice(l, len(l) - coalesce(take, 1) + 1, len(l)), '.') AS suffix,
      CASE WHEN len(l) > coalesce(take, 1) THEN array_to_string(list_slice(l, len(l) - coalesce(take, 1), len(l)), '.') END AS domain, take IS NOT NULL AS listed FROM h LEFT JOIN b ON b.host = h.host)
"""


@query(
    "outlink_domains",
    "F19",
    f"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, {text_literal(content.HREF)}, 1)) AS link FROM {_LINKED}),
    linked AS (SELECT DISTINCT page_id, CASE WHEN starts_with(link, 'http') THEN {host('link')} WHEN starts_with(link, '//') THEN split_part(link, '/', 3) ELSE {host('url')} END AS host
      FROM l WHERE NOT starts_with(link, 'mailto:')),
    hosts AS (SELECT * FROM {_SUFFIXED.format(pages='pages', linked='linked')}),
    """
    + _DOMAINS
    + "SELECT hosts.page_id, hosts.host, suffix, domain, listed FROM hosts LEFT JOIN d ON d.host = hosts.host",
)
def outlink_domains(t: Tables):
    """Linked hosts, and some that meet each kind of rule, with their registered domains."""
    hosts = t.spark.sql("SELECT * FROM " + _SUFFIXED, pages=t.pages, linked=_linked_hosts(t))
    return suffixes.with_domains(hosts, "host", t.suffix_rules, "rule").select("page_id", "host", "suffix", "domain", "listed")


@query("first_bytes", "F20", "SELECT page_id, lower(left(hex(encode(html)), 64)) AS first_bytes FROM pages")
def first_bytes(t: Tables):
    return t.pages.select("page_id", content.first_bytes_hex("html").alias("first_bytes"))


_ADDRESS = """concat('Office ', c_name, ', NW', c_nationkey % 9 + 1, ' ', c_custkey % 10, 'DB and LS23 7BQ. Not: ab1 2cd, ZZZ1 1AA. ', CASE WHEN c_custkey % 3 = 0 THEN 'LS23 7BQ' ELSE 'EC1A 1BB' END)"""


@query(
    "postcodes",
    "F16",
    f"""
    SELECT c_custkey, array_to_string(list_sort(list_distinct(regexp_extract_all({_ADDRESS}, {text_literal(content.POSTCODE)}, 1))), ',') AS postcodes FROM customer
    """,
)
def postcodes(t: Tables):
    return t.customer.select("c_custkey", F.array_join(content.postcodes(F.expr(_ADDRESS)), ",").alias("postcodes"))


_WORDS = f"regexp_extract_all(lower(text), {text_literal(textindex.WORD)})"


@query(
    "term_index",
    "F26",
    f"SELECT term, doc_id, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY 1, 2",
)
def term_index(t: Tables):
    return textindex.term_index(t.documents, "doc_id", "text")


@query(
    "documents_with_terms",
    "F26",
    f"""
    SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) WHERE term IN ('the', 'of', 'and')
    GROUP BY 1 HAVING count(DISTINCT term) = 3
    """,
)
def documents_with_terms(t: Tables):
    return textindex.documents_with_all(t.documents, "doc_id", "text", ["the", "of", "and"])


_BANDS = " UNION ALL ".join(
    f"SELECT doc_id, {b} AS band, h{2 * b} || '-' || h{2 * b + 1} AS value FROM m" for b in range(textindex.BANDS)
)
_MINIMA = ", ".join(
    "min((x * {} + {}) % {}) AS h{}".format(*textindex.hash_factors(i), textindex.PRIME, i)
    for i in range(textindex.BANDS * textindex.ROWS_PER_BAND)
)
_EQUAL = " + ".join(f"CAST(p.h{i} = q.h{i} AS INTEGER)" for i in range(textindex.BANDS * textindex.ROWS_PER_BAND))
_PRINTS = f"""
    WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) > 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])
      ELSE [array_to_string(w, ' ')] END) AS s FROM w) WHERE s <> ''),
    d AS (SELECT doc_id, CAST('0x' || left(md5(s), 8) AS BIGINT) AS x FROM s),
    m AS (SELECT doc_id, {_MINIMA} FROM d GROUP BY 1),
    prints AS ({_BANDS})
"""


@query("text_fingerprints", "F17", _PRINTS + "SELECT doc_id, band, value FROM prints")
def text_fingerprints(t: Tables):
    return textindex.fingerprints(t.documents, "doc_id", "text")


@query(
    "near_copy_groups",
    "F17",
    _PRINTS.replace("WITH w AS", "WITH RECURSIVE w AS")
    + f""", shared AS (SELECT DISTINCT p.doc_id AS x, q.doc_id AS y FROM prints p JOIN prints q ON p.band = q.band AND p.value = q.value AND p.doc_id < q.doc_id),
    links AS (SELECT x, y FROM shared JOIN m p ON p.doc_id = x JOIN m q ON q.doc_id = y WHERE {_EQUAL} >= 8),
    pairs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
    SELECT m.doc_id, least(m.doc_id, coalesce(min(y), m.doc_id)) AS "group" FROM m LEFT JOIN reach ON x = m.doc_id GROUP BY 1""",
)
def near_copy_groups(t: Tables):
    return textindex.near_copy_groups(textindex.fingerprints(t.documents, "doc_id", "text"), "doc_id")
