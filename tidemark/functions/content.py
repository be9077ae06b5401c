"""Expressions on page bodies: text, elements, links, postcodes, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.urls import let, url_host, url_scheme

# Markup patterns, valid in Java and RE2 syntax, applied in this order.
COMMENTS = r"(?s)<!--.*?-->"
SCRIPTS = r"(?is)<script[^>]*>.*?</script>"
STYLES = r"(?is)<style[^>]*>.*?</style>"
TAGS = r"(?s)<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
SPACES = r"\s+"
ELEMENT = r"<([a-zA-Z][a-zA-Z0-9]*)"
HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"'#]+)"
POSTCODE = r"\b([A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2})\b"

BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def html_text(html: Column | str, max_chars: int | None = None) -> Column:
    """Visible text of a page, spaces collapsed; whole unless the caller gives an index's own text limit."""
    out = _col(html)
    for pattern in (COMMENTS, SCRIPTS, STYLES, TAGS):
        out = F.regexp_replace(out, pattern, " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.trim(F.regexp_replace(out, SPACES, " "))
    return out if max_chars is None else F.left(out, F.lit(max_chars))


def elements_used(html: Column | str) -> Column:
    found = F.regexp_extract_all(_col(html), F.lit(ELEMENT), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def postcodes(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(POSTCODE), F.lit(1))))


def outlinks(html: Column | str, url: Column | str, max_links: int | None = None) -> Column:
    """Absolute anchor targets, relative ones resolved against the page; the first ``max_links`` if the caller sets a limit."""
    url = _col(url)
    links = F.regexp_extract_all(_col(html), F.lit(HREF), F.lit(1))
    if max_links is not None:
        links = F.slice(links, 1, max_links)
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    base = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    page = F.struct(
        url_scheme(url).alias("scheme"),
        root.alias("root"),
        F.when(base.endswith("/"), base).otherwise(F.concat(root, F.lit("/"))).alias("base"),
    )

    def absolute(link: Column, at: Column) -> Column:
        return (
            F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link)
            .when(link.startswith("//"), F.concat(at["scheme"], F.lit(":"), link))
            .when(link.startswith("/"), F.concat(at["root"], link))
            .otherwise(F.concat(at["base"], link))
        )

    resolved = let(page, lambda at: F.transform(links, lambda link: absolute(link, at)))
    return F.filter(resolved, lambda link: link.rlike(r"(?i)^https?://"))


def outlink_hosts(html: Column | str, url: Column | str, max_links: int | None = None) -> Column:
    return F.array_sort(F.array_distinct(F.transform(outlinks(html, url, max_links), lambda link: url_host(link))))


def first_bytes_hex(body: Column | str, num_bytes: int = 32) -> Column:
    return F.lower(F.hex(F.substring(F.encode(_col(body), "utf-8"), 1, num_bytes)))


def payload_sha1(body: Column | str) -> Column:
    return F.sha1(F.encode(_col(body), "utf-8"))


def sha1_base32(hex_digest: Column | str) -> Column:
    """The 32-character form used in capture indexes: 8 groups of 20 bits, 4 letters each."""
    hex_digest = _col(hex_digest)

    def letters(group: Column) -> Column:
        value = F.conv(F.substring(hex_digest, group * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(
            *[
                F.substring(F.lit(BASE32_ALPHABET), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                for shift in (15, 10, 5, 0)
            ]
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")
