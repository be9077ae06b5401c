"""Public suffixes: the longest rule that matches a host's last labels, found by equality joins.

Rules come as text, one per row: ``co.uk``, ``*.ck`` (any one label before ``ck``) and ``!www.ck`` (an exception: here the suffix is
``ck``). Each distinct host is turned into the tails of its labels, plain and with the first label as a wildcard; a tail meets a rule by
equality, and the best rule of a host is an aggregate that combines before its shuffle. Rules are one row each, so a tail
that most hosts share meets one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.network import IPV4


def _plain_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r"\.+$", "")


def parsed_rules(rules: DataFrame, rule: str) -> DataFrame:
    """(tail, kind) of each rule: 0 plain, 1 wildcard, 2 exception. Blank lines, comments (``//``) and repeats are dropped."""
    text = F.lower(F.trim(F.substring_index(F.trim(rule), " ", 1)))
    bare = F.regexp_replace(text, r"^!", "")
    kind = F.when(text.startswith("!"), 2).when(text.startswith("*."), 1).otherwise(0)
    return rules.where(text.isNotNull() & (text != "") & ~text.startswith("//")).select(bare.alias("tail"), kind.alias("kind")).distinct()


def suffixes_of(hosts: DataFrame, host: str, rules: DataFrame, rule: str) -> DataFrame:
    """(host, suffix, domain, listed) of each distinct host: its public suffix, the suffix with one label more, and whether a rule is listed.

    An exception wins over all; else the rule with most labels. Without a rule the last label is the suffix and ``listed`` is false.
    ``domain`` is null for a host that is a suffix itself; an address or an empty host has neither.
    """
    named = hosts.select(host).where(F.col(host).isNotNull()).distinct().withColumn("_labels", F.split(_plain_host(F.col(host)), r"\."))
    named = named.where((F.col("_labels")[0] != "") & ~_plain_host(F.col(host)).rlike(IPV4)).withColumn("_size", F.size("_labels"))
    tails = named.select(host, "_size", "_labels", F.explode(F.sequence(F.lit(1), F.col("_size"))).alias("_n"))
    last = F.slice("_labels", -F.col("_n"), F.col("_n"))
    wild = F.concat_ws(".", F.lit("*"), F.slice("_labels", 1 - F.col("_n"), F.col("_n") - 1))
    forms = F.when(F.col("_n") > 1, F.array(F.concat_ws(".", last), wild)).otherwise(F.array(F.concat_ws(".", last)))
    met = tails.select(host, "_n", F.explode(forms).alias("tail")).join(parsed_rules(rules, rule), "tail")
    # an exception's suffix is one label shorter than the exception
    length = F.when(F.col("kind") == 2, F.col("_n") - 1).otherwise(F.col("_n"))
    best = met.groupBy(host).agg(F.max_by(length, F.struct(F.col("kind") == 2, F.col("_n"))).alias("_best"))
    found = named.join(best, host, "left").withColumn("_take", F.coalesce("_best", F.lit(1)))
    domain = F.when(F.col("_size") > F.col("_take"), F.concat_ws(".", F.slice("_labels", -(F.col("_take") + 1), F.col("_take") + 1)))
    return found.select(
        host,
        F.concat_ws(".", F.slice("_labels", -F.col("_take"), F.col("_take"))).alias("suffix"),
        domain.alias("domain"),
        F.col("_best").isNotNull().alias("listed"),
    )


def with_domains(df: DataFrame, host: str, rules: DataFrame, rule: str) -> DataFrame:
    """``df`` with ``suffix``, ``domain`` and ``listed`` of its host; all three are null for a row without a host name."""
    return df.join(suffixes_of(df, host, rules, rule), host, "left")
