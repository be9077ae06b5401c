"""URL expressions: canonical form, SURT keys, prefixes. All are built-in column expressions.

A SURT key is the host with its labels reversed and joined by commas, a closing bracket, then
the path and query: ``http://www.example.co.uk/a?b=1`` has the key ``uk,co,example)/a?b=1``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lead of a web URL, and the session parameters that do not identify a resource.
# A leading scheme, userinfo and ``www[n].`` go in one step, all session forms in another (one step each keeps generated code
# small). No form takes the separator before it, so neighbours are all found, and a form may have others inside it:
# a second pass finds nothing.
SCHEME = r"^[a-z][a-z0-9+.\-]*://"
LEAD = r"^(https?://)(?:[^/?#@]*@)?(?:www[0-9]*\.)?"
_PATH_SESSION = r";jsessionid=[0-9a-z]{32}"
_PARAMETER = rf"(?:(?:jsessionid|phpsessid|sid)=[0-9a-z]{{32}}|aspsessionid[a-z]{{8}}=[a-z]{{24}})(?:{_PATH_SESSION})*"
SESSION = (
    rf"{_PATH_SESSION}|(?<=[?&])(?:{_PARAMETER}"
    rf"|cfid=[0-9]+(?:{_PATH_SESSION})*&(?:{_PARAMETER}&)*cftoken=[0-9a-z\-]+(?:{_PATH_SESSION})*)(?:&|$)"
)

# Second-level labels under which names are registered (a short list; pass your own).
SECOND_LEVEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "nhs.uk")

SURT_BOUNDARIES = ",)/?"
# a port in the authority part of a key
KEY_PORT = r"^([^:)]*):[0-9]+\)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row; inside a lambda an expression would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_url(url: Column | str) -> Column:
    """Lower case, no userinfo, no ``www[n].``, no session ids, no empty query, no fragment."""
    out = F.substring_index(F.lower(F.trim(_col(url))), "#", 1)
    out = F.regexp_replace(out, LEAD, "$1")
    out = F.regexp_replace(out, SESSION, "")
    return F.rtrim(out, F.lit("?&"))


def _without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, SCHEME, "")


def _host_and_port(url: Column) -> Column:
    """``host[:port]`` of a lower-case URL, userinfo dropped."""
    return F.substring_index(F.regexp_extract(_without_scheme(url), r"^[^/?#]*", 0), "@", -1)


def url_scheme(url: Column | str) -> Column:
    return F.regexp_extract(F.lower(_col(url)), r"^([a-z][a-z0-9+.\-]*)://", 1)


def url_host(url: Column | str) -> Column:
    return F.substring_index(_host_and_port(F.lower(_col(url))), ":", 1)


def _port(scheme: Column, host_and_port: Column) -> Column:
    stated = F.regexp_extract(host_and_port, r":([0-9]+)$", 1)
    own = F.when(scheme == "http", "80").when(scheme == "https", "443").otherwise("0")
    return F.when(stated != "", stated).otherwise(own)


def url_port(url: Column | str) -> Column:
    """Stated port, else the scheme's own; 0 when neither is known."""
    return _port(url_scheme(url), _host_and_port(F.lower(_col(url)))).cast("int")


def url_path(url: Column | str) -> Column:
    """Path with the case kept; the root path for a bare host."""
    path = F.regexp_extract(_col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://)?+[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def url_server(url: Column | str) -> Column:
    """``scheme://host:port``, the unit a download quota applies to."""
    lowered = F.lower(_col(url))
    where = _host_and_port(lowered)
    scheme = url_scheme(lowered)
    return F.concat(scheme, F.lit("://"), F.substring_index(where, ":", 1), F.lit(":"), _port(scheme, where))


def reversed_host(host: Column | str) -> Column:
    return F.array_join(F.reverse(F.split(_col(host), r"\.")), ",")


def host_key(host: Column | str) -> Column:
    """SURT key part of a host, closed: ``uk,co,example)``."""
    return F.concat(reversed_host(F.regexp_replace(F.lower(_col(host)), r"^www[0-9]*\.", "")), F.lit(")"))


def _key_authority(scheme: Column, host_and_port: Column) -> Column:
    port = F.regexp_extract(host_and_port, r":([0-9]+)$", 1)
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.concat(
        reversed_host(F.substring_index(host_and_port, ":", 1)),
        F.when(own, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
    )


def surt_authority(url: Column | str) -> Column:
    """The authority part of the key; a port other than the scheme's own is kept."""
    canonical = canonical_url(url)
    return _key_authority(url_scheme(canonical), _host_and_port(canonical))


def surt_key(url: Column | str) -> Column:
    """Key of the URL's canonical form; empty for a missing URL.

    Never null on purpose: for a key that may be null, Spark repeats the whole expression in a null test before
    every join on it.
    """
    canonical = canonical_url(url)
    rest = _without_scheme(canonical)
    where = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(where) + 1)
    key = F.concat(
        _key_authority(url_scheme(canonical), F.substring_index(where, "@", -1)),
        F.lit(")"),
        F.when(F.startswith(tail, F.lit("/")), F.lit("")).otherwise(F.lit("/")),
        tail,
    )
    return F.coalesce(key, F.lit(""))


def registered_domain(host: Column | str, suffixes: tuple[str, ...] = SECOND_LEVEL_SUFFIXES) -> Column:
    """Last two labels of a host, or three below a known second-level suffix."""
    host = F.lower(_col(host))
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def key_prefixes(key: Column | str) -> Column:
    """Every prefix of a SURT key that ends at a boundary, and the key itself.

    ``uk,co,x)/a/b`` gives ``uk,``, ``uk,co,``, ``uk,co,x)``, ``uk,co,x)/``, ``uk,co,x)/a/`` and the key. A key
    with a port also gives the prefixes of the key without it: a prefix that names no port covers them all.
    """

    def grown(text: Column) -> Column:
        return F.aggregate(
            F.split(text, r"(?<=[,)/?])"),
            F.array(F.lit("")),
            lambda seen, piece: F.array_append(seen, F.concat(F.element_at(seen, -1), piece)),
        )

    key = _col(key)
    both = F.when(key.contains(":"), F.concat(grown(key), grown(F.regexp_replace(key, KEY_PORT, "$1)")))).otherwise(grown(key))
    # the text after a closing boundary is empty and repeats the last prefix
    return let(both, lambda found: F.array_distinct(F.when(key == "", found).otherwise(F.array_remove(found, ""))))


def prefix_line_key(line: Column | str) -> Column:
    """One line of a prefix list as a SURT prefix.

    ``+`` marks a line that is a SURT prefix already (the ``http://(`` lead-in is optional); any
    other line is a host or URL prefix. A bare host covers the host and its subdomains.
    """
    line = F.trim(_col(line))
    surt = F.regexp_replace(F.lower(F.substr(line, F.lit(2))), r"^https?://\(?|^\(", "")
    bare = F.regexp_replace(F.lower(line), r"^[a-z][a-z0-9+.\-]*://", "")
    is_host = ~bare.rlike(r"[/?]")
    return (
        F.when(line.startswith("+"), surt)
        .when(is_host, reversed_host(F.regexp_replace(bare, r"^www[0-9]*\.", "")))
        .otherwise(surt_key(F.concat(F.lit("http://"), bare)))
    )


def document_filename(url: Column | str) -> Column:
    """Last path segment, percent-decoded where valid; ``index`` for a folder."""
    last = F.regexp_extract(url_path(url), r"([^/]*)$", 1)
    decoded = F.coalesce(F.try_url_decode(last), last)
    return F.when(last == "", F.lit("index")).otherwise(decoded)


def access_url(base: str, ts14: Column | str, url: Column | str) -> Column:
    return F.concat(F.lit(base), _col(ts14), F.lit("/"), _col(url))


def path_segments(url: Column | str) -> Column:
    """Path split at ``/`` (text before the query), empty segments kept."""
    return F.split(F.regexp_extract(_col(url), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/")
