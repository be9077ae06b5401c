"""Bounded filters, alerts on silence, public suffixes and alias chains."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bloom, captures, network, scope, suffixes
from tidemark.streaming import gates, intake

BASE = datetime(2024, 1, 1)


def in_parts(spark, folder, parts, schema):
    """A stream that gets one part per batch."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return intake.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, max_files=1)


@pytest.mark.parametrize("rate", [0.05, 0.001])
def test_rate_of_a_full_filter(spark, rate):
    capacity = 100_000
    shape = bloom.Shape.of(capacity, rate)
    assert shape.bytes <= 2.5 * capacity * -np.log(rate) / np.log(2) ** 2 / 8 + bloom.BLOCK_BYTES
    known = bloom.build_filter(spark.range(capacity).selectExpr("concat('in', id) AS k"), "k", shape).cache()
    assert known.count() <= shape.blocks
    assert bloom.not_in_filter(spark.range(capacity).selectExpr("concat('in', id) AS k"), "k", known, shape).isEmpty()
    probes = 200_000
    missed = probes - bloom.not_in_filter(spark.range(probes).selectExpr("concat('out', id) AS k"), "k", known, shape).count()
    assert missed <= rate * probes * 1.1 + 3


def test_merged_filters_know_both(spark):
    shape = bloom.Shape.of(50_000, 1e-6)
    sides = [spark.range(a, b).selectExpr("CAST(id AS STRING) AS k") for a, b in ((0, 3000), (2000, 5000))]
    one, other = (bloom.build_filter(side, "k", shape) for side in sides)
    both = bloom.merge_filters(one, other)
    assert bloom.not_in_filter(sides[0].union(sides[1]), "k", both, shape).isEmpty()
    asked = spark.range(4990, 5010).selectExpr("CAST(id AS STRING) AS k").union(spark.createDataFrame([(None,)], "k string"))
    assert sorted(r["k"] for r in bloom.not_in_filter(asked, "k", both, shape).collect()) == [str(i) for i in range(5000, 5010)]
    empty = bloom.build_filter(sides[0].limit(0), "k", shape)
    assert bloom.not_in_filter(sides[0], "k", empty, shape).count() == 3000


def test_stream_names_a_key_once(spark, tmp_path):
    gates.use_rocksdb(spark)
    draw = random.Random(1)
    parts = [[(f"u{draw.randrange(3000)}",) for _ in range(2000)] + [("hot",)] * 500 + [(None,)] for _ in range(3)]
    shape = bloom.Shape.of(20_000, 1e-7)
    seen = gates.first_seen_bounded(in_parts(spark, tmp_path, parts, "url string"), "url", shape, shards=2)
    query = intake.append_to(seen, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True)
    query.awaitTermination()
    got = [r["url"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == {u for part in parts for (u,) in part if u}
    # the state holds the filter's blocks and nothing else
    state = spark.read.format("statestore").option("stateVarName", "blocks").load(f"{tmp_path}/cp")
    assert state.count() <= shape.blocks


def plain_alerts(hours, first, last, below=10, hold=3600):
    out, since, samples, fired = [], None, 0, False
    at = first
    while at <= last:
        if sum(hours.get(at - timedelta(hours=i), 0) for i in range(4)) < below:
            since, samples = since or at, samples + 1
            if not fired and (at - since).total_seconds() >= hold:
                fired = True
                out.append(("firing", since, at, samples))
        else:
            if fired:
                out.append(("resolved", since, at - timedelta(hours=1), samples))
            since, samples, fired = None, 0, False
        at += timedelta(hours=1)
    return out


def test_silence_is_noticed_while_the_stream_runs(spark, tmp_path):
    gates.use_rocksdb(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    watched = [0, 1, 2, 3, 4, 5, 30, 31, 32, 33, 34, 60]  # hours with 20 rows; none between
    rows = [("a", BASE + timedelta(hours=h, minutes=2 * i), True) for h in watched for i in range(20)]
    rows += [("a", BASE + timedelta(hours=h, minutes=30), False) for h in range(72)]  # keeps time going
    rows.sort(key=lambda r: r[1])
    edges = [BASE + timedelta(hours=h) for h in (0, 4, 12, 20, 40, 72)]
    parts = [[r for r in rows if a <= r[1] < b] for a, b in zip(edges, edges[1:], strict=False)]
    stream = in_parts(spark, tmp_path, parts, "series string, ts timestamp_ntz, watched boolean")
    alerts = gates.silence_alerts(stream, "ts", F.col("series"), F.col("watched"), "0 seconds")
    seen = []

    def note(batch, batch_id):
        seen.append([(r["state"], r["since"], r["reached"], r["samples"]) for r in batch.collect()])

    intake.each_batch(alerts, note, f"{tmp_path}/cp", available_now=True).awaitTermination()
    hours = {BASE + timedelta(hours=h): 20 for h in watched}
    want = plain_alerts(hours, BASE, BASE + timedelta(hours=70))
    assert sorted(r for batch in seen for r in batch) == sorted(want) and len(want) == 5
    # the first alert leaves the query while later input is still to come
    firing = next(i for i, batch in enumerate(seen) if batch)
    assert firing < len(seen) - 2 and seen[firing][0][0] == "firing"


def test_suffix_rules(spark):
    rules = ["// list", "", "uk", "co.uk", "*.ck", "!www.ck", "com", "com", "blog.com comment"]
    cases = {
        "www.bl.co.uk": ("co.uk", "bl.co.uk", True), "CO.UK": ("co.uk", None, True), "bl.uk.": ("uk", "bl.uk", True),
        "a.b.c.ck": ("c.ck", "b.c.ck", True), "c.ck": ("c.ck", None, True), "ck": ("ck", None, False), "www.ck": ("ck", "www.ck", True),
        "x.www.ck": ("ck", "www.ck", True), "me.blog.com": ("blog.com", "me.blog.com", True), "a.b.zz": ("zz", "b.zz", False),
        "192.0.2.1": (None, None, None), "": (None, None, None),
    }
    hosts = spark.createDataFrame([(h,) for h in [*cases, "www.ck", None]], "host string")
    rows = suffixes.with_domains(hosts, "host", spark.createDataFrame([(r,) for r in [*rules, None]], "rule string"), "rule").collect()
    assert len(rows) == len(cases) + 2
    assert {r["host"]: tuple(r)[1:] for r in rows if r["host"] is not None} == cases
    none = suffixes.suffixes_of(hosts, "host", spark.createDataFrame([], "rule string"), "rule").where("host = 'a.b.zz'").collect()
    assert [tuple(r) for r in none] == [("a.b.zz", "zz", "b.zz", False)]


def test_alias_chains_and_loops(spark):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("x", "y"), ("y", "z"), ("z", "x"), ("lead", "in"), ("in", "z"), ("two", "b"), ("two", "a"), ("own", "own"), (None, "q"), ("q", None), ("s1", "s2"), ("s2", "s1")]
    found = captures.resolved_aliases(spark.createDataFrame(pairs, "old string, new string"), "old", "new")
    got = {r["old"]: (r["final"], r["steps"]) for r in found.collect()}
    want = {f"c{i}": ("c9", 9 - i) for i in range(9)} | dict.fromkeys(("x", "y", "z", "lead", "in"), ("x", None))
    assert got == want | {"two": ("a", 1), "s1": ("s1", None), "s2": ("s1", None)}
    urls = spark.createDataFrame([("c3",), ("lead",), ("other",), (None,)], "k string")
    moved = captures.apply_aliases(urls, "k", spark.createDataFrame(pairs, "old string, new string"), "old", "new", "now").collect()
    assert {r["k"]: r["now"] for r in moved} == {"c3": "c9", "lead": "x", "other": "other", None: None}
    assert captures.resolved_aliases(spark.createDataFrame([], "old string, new string"), "old", "new").collect() == []


def test_lookups_see_only_rows_they_can_change(spark):
    rows = [  # url, hop path, key
        (1, "http://a.example/x", "P", "decided by its hops"), (2, "http://a.example/x", "E", "accepted by its hops"),
        (3, "http://a.example/x", "L" * 21, "too far"), (4, "http://a.example/x", "L", "open"), (5, "http://b.example/x", "L", "open too"),
        (6, "http://b.example/x.css", "L", "a helper"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, url string, hop_path string")
    asked = {}

    def lookup(name, decision, ids):
        def find(part):
            asked[name] = sorted(r["id"] for r in part.select("id").collect())
            return part.withColumn("_applies", F.col("id").isin(*ids))

        return scope.Lookup(name, find, decision)

    chain = scope.staged_rules(
        "url", "hop_path", lookup("seed_prefix", "ACCEPT", [4]), lookup("on_domain", "ACCEPT", [4, 5]), lookup("in_country", "ACCEPT", [-1]),
        lookup("url_shortener", "ACCEPT", [-1]), lookup("excluded_prefix", "REJECT", [5]), lookup("seen_recently", "REJECT", [6]),
    )
    got = {r["id"]: (r["decision"], r["rule"]) for r in scope.decide_in_stages(df, chain).collect()}
    assert got == {
        1: ("ACCEPT", "prerequisite"), 2: ("ACCEPT", "embed_or_redirect"), 3: ("REJECT", "too_many_hops"), 4: ("ACCEPT", "seed_prefix"),
        5: ("REJECT", "excluded_prefix"), 6: ("REJECT", "seen_recently"),
    }
    assert asked == {
        "seed_prefix": [4, 5], "on_domain": [5], "in_country": [], "url_shortener": [], "excluded_prefix": [2, 4, 5, 6], "seen_recently": [2, 4, 6],
    }


def test_staged_lookups_with_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "L", "", None), (3, "http://x.co.uk/a", None, "x.co.uk", "999.1.1.1"), (3, "http://x.co.uk/a", None, "x.co.uk", "192.0.2.9")]
    df = spark.createDataFrame(rows, "id int, url string, hop_path string, host string, ip string")
    rules = spark.createDataFrame([("co.uk",)], "rule string")
    nets = network.cidr_ranges(spark.createDataFrame([("GB", "192.0.2.0/24")], "country string, nets string"), "nets", ["country"])
    seeds = spark.createDataFrame([("www.x.co.uk",), (None,)], "seed string")
    chain = [scope.country_lookup("in_country", "ip", nets, ["GB"]), scope.domain_lookup("on_domain", "host", seeds, "seed", rules, "rule")]
    got = sorted(tuple(r) for r in scope.decide_in_stages(df, chain).select("id", "decision", "rule").collect())
    assert got == [(1, "REJECT", "start"), (2, "REJECT", "start"), (3, "ACCEPT", "in_country"), (3, "ACCEPT", "on_domain")]
    assert scope.decide_in_stages(df.limit(0), chain).collect() == []
