"""Results that must not hang on ids or on one bad row: near-copy groups, counts over time."""

import itertools
import random
import re
from datetime import datetime, timedelta

import pytest

from tidemark.functions import storage_paths
from tidemark.operators import histograms, textindex, tracking

PLACES = textindex.BANDS * textindex.ROWS_PER_BAND


def prints_of(spark, signatures):
    rows = []
    for doc, minima in signatures.items():
        for b in range(textindex.BANDS):
            pair = minima[b * textindex.ROWS_PER_BAND : (b + 1) * textindex.ROWS_PER_BAND]
            rows.append((doc, b, "-".join(map(str, pair))))
    return spark.createDataFrame(rows, "doc bigint, band int, value string")


def plain_groups(signatures):
    group = {d: d for d in signatures}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for x, y in itertools.combinations(sorted(signatures), 2):
        a, b = signatures[x], signatures[y]
        band = any(a[i : i + 2] == b[i : i + 2] for i in range(0, PLACES, 2))
        if band and sum(p == q for p, q in zip(a, b, strict=True)) >= PLACES / 2:
            x, y = sorted((root(x), root(y)))
            group[y] = x
    return {d: root(d) for d in signatures}


def test_equal_documents_stay_together_behind_strangers(spark):
    twin = list(range(100, 100 + PLACES))
    docs = {50: twin, 51: list(twin)}
    for b in range(textindex.BANDS):  # in each band a stranger with a smaller id
        stranger = [1000 * (b + 1) + i for i in range(PLACES)]
        stranger[2 * b : 2 * b + 2] = twin[2 * b : 2 * b + 2]
        docs[b] = stranger
    near = list(twin)
    near[:8] = range(900, 908)
    docs[60] = near
    got = {r["doc"]: r["group"] for r in textindex.near_copy_groups(prints_of(spark, docs), "doc").collect()}
    assert got == plain_groups(docs) and got[50] == got[51] == got[60] == 50


@pytest.mark.parametrize("seed", range(3))
def test_groups_are_all_pairs_of_a_band(spark, seed, monkeypatch):
    monkeypatch.setattr(textindex, "TILE_ROWS", 3)
    draw = random.Random(seed)
    bases = [[draw.randrange(10**6) for _ in range(PLACES)] for _ in range(4)]
    docs = {}
    for d in draw.sample(range(1000), 70):
        minima = list(draw.choice(bases))
        for i in draw.sample(range(PLACES), draw.choice([0, 3, 6, 8, 9, 12])):
            minima[i] = draw.randrange(3)
        docs[d] = minima
    got = {r["doc"]: r["group"] for r in textindex.near_copy_groups(prints_of(spark, docs), "doc").collect()}
    assert got == plain_groups(docs)
    assert textindex.near_copy_groups(prints_of(spark, {1: bases[0]}), "doc").collect()[0]["group"] == 1


def test_one_stray_time_does_not_fill_eight_thousand_years(spark):
    base = datetime(2024, 1, 1)
    rows = [("a", base), ("a", base + timedelta(minutes=3)), ("b", base + timedelta(minutes=1)), ("a", datetime(9999, 12, 31)), (None, base), ("a", None)]
    df = spark.createDataFrame(rows, "term string, ts timestamp_ntz")
    got = {(r["term"], r["bucket"]): r["n"] for r in histograms.counts_over_time(df, "ts", 60, ["term"]).collect()}
    near = [base + timedelta(minutes=i) for i in range(4)]
    counted = {("a", near[0]): 1, ("a", near[3]): 1, ("b", near[1]): 1, (None, near[0]): 1, ("a", datetime(9999, 12, 31)): 1}
    assert got == {(t, at): counted.get((t, at), 0) for t in ("a", "b", None) for at in [*near, datetime(9999, 12, 31)]}
    asked = histograms.counts_over_time(df, "ts", 60, start=base, end=base + timedelta(minutes=5)).collect()
    assert sorted((r["bucket"], r["n"]) for r in asked) == [(base + timedelta(minutes=i), n) for i, n in enumerate((2, 1, 0, 1, 0, 0))]
    assert histograms.counts_over_time(df.limit(0), "ts", 60, ["term"]).collect() == []
    assert histograms.counts_over_time(df, "ts", 60, start=base, end=base - timedelta(days=1)).collect() == []


def test_long_gaps_are_filled_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(histograms, "MAX_GAP", 50)
    monkeypatch.setattr(histograms, "STRETCH", 7)
    base = datetime(2024, 1, 1)
    at = [0, 1, 40, 90, 141, 200]  # in minutes; the gaps of 51 and 59 stay empty
    df = spark.createDataFrame([(base + timedelta(minutes=m),) for m in at], "ts timestamp_ntz")
    got = sorted((r["bucket"] - base) // timedelta(minutes=1) for r in histograms.counts_over_time(df, "ts", 60).collect())
    assert got == [*range(91), 141, 200]


def test_output_paths_by_one_pattern(spark):
    """Output folder, job, launch of 14 digits, known folder and a name, whatever else the path holds."""
    good = "20230101000000"
    launches = [good, good + "\n", good + "\r\n", good + " ", good + "0", good[:-1], "x" + good, good + " ", ""]
    paths = [f"{head}output/{job}/{launch}/{folder}/{name}" for head in ("", "/", "/a/", "/output/", "x", "a/output/b/")
        for job in ("", "dc2023", "output", "frequent-npld") for launch in launches for folder in ("warcs", "logs", "log", "logs2", "")
        for name in ("", "x", "\n", "crawl.log.cp1", "a/b")]
    paths += ["", "/", "output", "/output/", f"output/{good}/logs/x", f"/output/{good}/logs/x", f"/output/j/{good}/logs"]

    def known(path):
        parts = path.split("/")
        if "/output/" not in path or len(parts) < 5 or parts[-5] != "output" or parts[-2] not in storage_paths.OUTPUT_FOLDERS:
            return None
        return parts[-4] if re.search("^[0-9]{14}(\r\n|[\n\r ])?\\Z", parts[-3]) and parts[-1] else None

    rows = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    got = rows.select("p", storage_paths.path_parts("p")["job"].alias("job"), storage_paths.path_parts("p")["kind"].alias("kind")).collect()
    assert {r["p"]: r["job"] for r in got} == {p: known(p) for p in paths} | {None: None}
    assert all((r["kind"] == "other") <= (known(r["p"]) is None or "/warcs/" in r["p"]) for r in got if r["p"] is not None)


def test_files_that_are_no_logs_are_not_parsed(spark):
    files = spark.range(9).selectExpr("concat('/output/dc2023/20230101000000/logs/crawl.log.cp', id) AS p", "id AS size", "id AS at")
    grown = tracking.log_growth(files, spark.createDataFrame([("dc2023",)], "job string"), "p", "size", "at")
    for df in (grown, tracking.checkpoint_gaps(files, "p")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        tests = [x for x in plan.splitlines() if "Filter" in x and "concat(" in x]
        assert tests and all("Contains(" in x or "contains(" in x.lower() for x in tests)
        # the computed path is put in for every place that names it
        assert all(x.count("concat(") <= 6 for x in tests), tests
    assert grown.select("logs").collect() == [(9,)]
