"""Crawl scope: URL rules and the ordered decision chain."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import let, path_segments
from tidemark.operators.captures import YEAR_SECONDS, recently_seen
from tidemark.operators.network import lookup_ranges
from tidemark.operators.prefixes import flag_covered
from tidemark.operators.suffixes import suffixes_of
from tidemark.session import use_checkpoints

ACCEPT, REJECT = "ACCEPT", "REJECT"

# URLs the crawl leaves out; each pattern must match the whole URL.
EXCLUDE_PATTERNS = (
    r"^.+ProductCats\.asp\?Keywords=.+xargs=.+$",
    r"^.+index\.php\?Keywords=.+xargs=.+$",
    r"^.+\.uk/.*\bcheckout\b.*$",
    r"^.+GetSearchResults\.php\?Query=.*%5C.*$",
    r"^.+index\.php.+index\.php.*$",
    r"^.{512,}$",
    r"^.+camcycle\.org.+camcycle\.org.*$",
    r"^.+/cart/add/.+$",
    r"^.+jobs\.staffs\.ac\.uk/[A-Za-z0-9+/]{20,}.+$",
    r"^.+%20%20%20.+$",
    r"^.+/cms/events/calendar/.+/2014/.+$",
    r"^.+/cms/events/calendar/.+/2012/.+$",
    r"^.+ncl\.ac\.uk.+https%3.+$",
    r"^https?://[^/]+/catalog/product_compare/(add|remove)/.+$",
    r"^.+index\.php\?qs=06oENya.+$",
    r"^https?://[^/]+\.bbc\.co\.uk/iplayer/.*$",
    r"^.+action=buy_now.*$",
    r"^.+?mobile_switch=mobile",
    r"^https?://twitter\.com/.+\?lang=.+$",
    r".*\?(?:.*&)?replytocom=\d+",
    r"https?://[^/]+/wp-admin/.*",
    r"https?://[^/]+/wp-config\.php.*",
    r"https?://[^/]+/humans.txt",
    r"https?://[^/]+/sellers.json",
    r"https?://[^/]+/.well-known/security.txt",
    r"https?://[^/]+/.well-known/host-meta.json",
    r"https?://[^/]+/.well-known/dat",
)

# Endings of helper files (scripts, styles, images, audio, video, fonts).
ASSET_EXTENSIONS = (
    "js|css|bmp|gif|jpe?g|[pm]ng|svg|tiff?|ico|web[pm]|aac|aiff?|m3u|m4[av]|midi?|mp[1234acu]|og[agm]|ra?m?|cda|"
    "alac|ac3|flac|wav|wm[av]|as[fx]|avi|flv|mov|mpe?g|qt|smil|swf|woff|eot|ttf"
)

# Hop-path patterns and limits.
EMBED_OR_REDIRECT = r"^.*[ER]+$"
FIVE_REDIRECTS = r"^.*RRRRR$"
PREREQUISITE_HOPS = r"^PR*$"
REDIRECTS_ONLY = r"^R+$"
MAX_HOPS = 20
MAX_PATH_DEPTH = 15
MAX_REPETITIONS = 3


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def full_match_any(patterns: Sequence[str]) -> str:
    """One alternation that matches the whole text if any of the patterns does."""
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"


def is_excluded(url: Column | str, patterns: Sequence[str] = EXCLUDE_PATTERNS) -> Column:
    """Some pattern matches the whole URL."""
    return _col(url).rlike(full_match_any(patterns)) if patterns else F.lit(False)


def is_helper_asset(url: Column | str) -> Column:
    return _col(url).rlike(rf"^https?://[^/]+/.+(?i:\.(?:{ASSET_EXTENSIONS}))\b.*$")


def ends_in_embed_or_redirect(hop_path: Column | str) -> Column:
    return F.coalesce(_col(hop_path), F.lit("")).rlike(EMBED_OR_REDIRECT)


def ends_in_five_redirects(hop_path: Column | str) -> Column:
    return F.coalesce(_col(hop_path), F.lit("")).rlike(FIVE_REDIRECTS)


def is_prerequisite(hop_path: Column | str) -> Column:
    """The last hop fetched something another URL needs first, such as a robots file."""
    return F.coalesce(_col(hop_path), F.lit("")).endswith("P")


def bypasses_quota(hop_path: Column | str) -> Column:
    return F.coalesce(_col(hop_path), F.lit("")).rlike(PREREQUISITE_HOPS)


def too_many_hops(hop_path: Column | str, max_hops: int = MAX_HOPS) -> Column:
    return F.length(F.coalesce(_col(hop_path), F.lit(""))) > max_hops


def repeats_segment(url: Column | str, max_repetitions: int = MAX_REPETITIONS) -> Column:
    """A path segment occurs more than ``max_repetitions`` times in a row (the open last segment does not count)."""
    # the lead-in of the path is empty and the text after the last slash is not a closed segment
    run = max_repetitions + 1

    def has_run(parts: Column) -> Column:
        last = F.size(parts) - run
        starts = F.when(last >= 2, F.sequence(F.lit(2), last)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: F.size(F.array_distinct(F.slice(parts, i, F.lit(run)))) == 1)

    return let(path_segments(url), has_run)


def path_too_deep(url: Column | str, max_depth: int = MAX_PATH_DEPTH) -> Column:
    return F.size(F.filter(path_segments(url), lambda s: s != "")) > max_depth


def is_redirected_seed(hop_path: Column | str) -> Column:
    """A URL reached from a seed through redirects alone counts as a seed itself."""
    return F.coalesce(_col(hop_path), F.lit("")).rlike(REDIRECTS_ONLY)


@dataclass(frozen=True)
class Rule:
    """``decision`` applies where ``applies`` is true; null counts as false."""

    name: str
    applies: Column
    decision: str


def decide(rules: Sequence[Rule], start: str = REJECT) -> Column:
    """Struct (decision, rule): the last rule that applies wins, ``start`` if none does.

    One expression for both, tried from the last rule backwards, so a rule is only evaluated where no
    later one has decided.
    """

    def verdict(decision: str, rule: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(rule).alias("rule"))

    return F.coalesce(*[F.when(r.applies, verdict(r.decision, r.name)) for r in reversed(rules)], verdict(start, "start"))


@dataclass(frozen=True)
class Lookup:
    """A rule that needs a join. ``find`` gets the rows that are asked about and returns them with a boolean column ``_applies``."""

    name: str
    find: Callable[[DataFrame], DataFrame]
    decision: str


def decide_in_stages(df: DataFrame, chain: Sequence[Rule | Lookup], start: str = REJECT) -> DataFrame:
    """``df`` with ``decision`` and ``rule``; the last rule that applies wins, and lookups are made only where they matter.

    Rules without a join are worked out for all rows at once. A lookup then sees a row only if no later such rule decides it
    anyway and if the verdict so far is not the lookup's own decision; a lookup that would repeat the verdict leaves the earlier rule's
    name. Rows asked and rows passed by are put together again before the next lookup, each time from a checkpoint, so that nothing is
    worked out twice.
    """
    use_checkpoints(df.sparkSession)
    runs: list[list[tuple[int, Rule]]] = [[]]
    lookups: list[tuple[int, Lookup]] = []
    for place, step in enumerate(chain):
        if isinstance(step, Lookup):
            lookups.append((place, step))
            runs.append([])
        else:
            runs[-1].append((place, step))

    def verdict(place: int, decision: str, rule: str) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(decision).alias("decision"), F.lit(rule).alias("rule"))

    none = F.lit(None).cast("struct<place:int,decision:string,rule:string>")

    def last_of(run: list[tuple[int, Rule]]) -> Column:
        found = [F.when(rule.applies, verdict(place, rule.decision, rule.name)) for place, rule in reversed(run)]
        return F.coalesce(*found, none)

    own = df.columns
    rows = df.withColumns({f"_run{i}": last_of(run) for i, run in enumerate(runs)})
    rows = rows.withColumn("_verdict", F.coalesce("_run0", verdict(-1, start, "start"))).drop("_run0")
    for i, (place, lookup) in enumerate(lookups):
        later = [f"_run{j}" for j in range(i + 1, len(runs))]
        rows = rows.checkpoint()
        open_ = F.col("_verdict.decision") != lookup.decision
        for name in later:
            open_ = open_ & F.col(name).isNull()
        kept = rows.columns
        asked = lookup.find(rows.where(open_))
        changed = F.when(F.col("_applies"), verdict(place, lookup.decision, lookup.name)).otherwise(F.col("_verdict"))
        asked = asked.withColumn("_verdict", changed).select(*kept)
        rows = rows.where(~open_).unionByName(asked)
        rows = rows.withColumn("_verdict", F.coalesce(f"_run{i + 1}", "_verdict")).drop(f"_run{i + 1}")
    return rows.select(*own, F.col("_verdict.decision").alias("decision"), F.col("_verdict.rule").alias("rule"))


def prefix_lookup(name: str, key: str, listed: DataFrame, prefix: str, decision: str) -> Lookup:
    """Applies to keys that some listed prefix covers."""
    return Lookup(name, lambda rows: flag_covered(rows, key, listed, prefix, "_applies"), decision)


def country_lookup(name: str, ip: str, ranges: DataFrame, countries: Sequence[str], decision: str = ACCEPT) -> Lookup:
    """Applies to addresses in one of the countries. ``ranges`` has (lo, hi, country)."""

    def find(rows: DataFrame) -> DataFrame:
        located = lookup_ranges(rows, ip, ranges.withColumnRenamed("country", "_country"), ["_country"])
        return located.withColumn("_applies", F.coalesce(F.col("_country").isin(*countries), F.lit(False)))

    return Lookup(name, find, decision)


def domain_lookup(name: str, host: str, seed_hosts: DataFrame, seed_host: str, suffix_rules: DataFrame, rule: str, decision: str = ACCEPT) -> Lookup:
    """Applies to hosts whose registered domain is that of a seed."""
    seeds = suffixes_of(seed_hosts, seed_host, suffix_rules, rule).where("domain is not null").select("domain").distinct()

    def find(rows: DataFrame) -> DataFrame:
        known = suffixes_of(rows, host, suffix_rules, rule).join(seeds, "domain", "left_semi").select(host, F.lit(True).alias("_applies"))
        return rows.join(known, host, "left").withColumn("_applies", F.coalesce("_applies", F.lit(False)))

    return Lookup(name, find, decision)


def seen_lookup(
    name: str, key: str, now: str, captures: DataFrame, captured_at: str, interval_seconds: int = YEAR_SECONDS, launch: str | None = None
) -> Lookup:
    """Rejects keys that were captured less than ``interval_seconds`` before ``now`` (and not before their ``launch``)."""

    def find(rows: DataFrame) -> DataFrame:
        return recently_seen(rows, captures, key, now, captured_at, interval_seconds, launch, "_applies")

    return Lookup(name, find, REJECT)


def staged_rules(
    url: str,
    hop_path: str,
    in_scope: Lookup,
    on_domain: Lookup,
    in_country: Lookup,
    shortener: Lookup,
    excluded_prefix: Lookup,
    seen_recently: Lookup,
    exclude_patterns: Sequence[str] = EXCLUDE_PATTERNS,
    max_hops: int = MAX_HOPS,
) -> list[Rule | Lookup]:
    """The default chain in its order, with its joins as lookups."""
    filled = {
        "seed_prefix": in_scope, "on_domain": on_domain, "in_country": in_country, "url_shortener": shortener,
        "excluded_prefix": excluded_prefix, "seen_recently": seen_recently,
    }
    plain = standard_rules(url, hop_path, F.lit(False), F.lit(False), exclude_patterns=exclude_patterns, max_hops=max_hops)
    return [filled.get(rule.name, rule) for rule in plain]


def standard_rules(
    url: str,
    hop_path: str,
    in_scope: Column,
    excluded_prefix: Column,
    seen_recently: Column | None = None,
    in_country: Column | None = None,
    on_domain: Column | None = None,
    shortener: Column | None = None,
    exclude_patterns: Sequence[str] = EXCLUDE_PATTERNS,
    max_hops: int = MAX_HOPS,
) -> list[Rule]:
    """The default chain in its order; the optional rules are off unless a column is given."""
    off = F.lit(False)

    def given(column: Column | None) -> Column:
        return off if column is None else column

    return [
        Rule("seed_prefix", in_scope, ACCEPT),
        Rule("helper_asset", is_helper_asset(url), ACCEPT),
        Rule("embed_or_redirect", ends_in_embed_or_redirect(hop_path), ACCEPT),
        Rule("on_domain", given(on_domain), ACCEPT),
        Rule("in_country", given(in_country), ACCEPT),
        Rule("url_shortener", given(shortener), ACCEPT),
        Rule("too_many_hops", too_many_hops(hop_path, max_hops), REJECT),
        Rule("five_redirects", ends_in_five_redirects(hop_path), REJECT),
        Rule("excluded_pattern", is_excluded(url, exclude_patterns), REJECT),
        Rule("repeated_segment", repeats_segment(url), REJECT),
        Rule("path_too_deep", path_too_deep(url), REJECT),
        Rule("excluded_prefix", excluded_prefix, REJECT),
        Rule("seen_recently", given(seen_recently), REJECT),
        Rule("prerequisite", is_prerequisite(hop_path), ACCEPT),
    ]
