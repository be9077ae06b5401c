"""Runs that commit as a whole, remembered checksums, an index read by blocks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import tracking
from tidemark.sinks import blocks, committed

BASE = datetime(2024, 1, 1)


def log_tables(spark):
    rows = [
        (i, f"log{i % 4}", f"http://h.example.co.uk/d/{i % 6}.pdf", BASE + timedelta(hours=i), "application/pdf", 10, None if i == 3 else "http://h.example.co.uk/d/", "L")
        for i in range(12)
    ]
    schema = "event_id bigint, file_path string, url string, ts timestamp_ntz, mimetype string, size bigint, landing_page_url string, source string"
    events = spark.createDataFrame(rows, schema)
    files = spark.createDataFrame([(f"log{i}", BASE + timedelta(days=i)) for i in range(4)], "file_path string, modified_at timestamp_ntz")
    feed = spark.createDataFrame([("uk,co,example,h)/d/", 7)], "surt_prefix string, target_id bigint")
    return files, events, feed


def seen(spark, root):
    names = {"findings": jobs.DOCUMENT_ROW, "marks": jobs.LOG_MARK, "metrics": jobs.METRIC_ROW, "invalid": jobs.DOCUMENT_ROW}
    return {name: committed.read_committed(spark, root, name, schema) for name, schema in names.items()}


def test_findings_marks_and_metrics_come_together(spark, tmp_path, monkeypatch):
    files, events, feed = log_tables(spark)
    root = str(tmp_path)
    assert all(df.isEmpty() for df in seen(spark, root).values())
    write = committed.commit_run

    def broken(outputs, folder):
        kept = dict(list(outputs.items())[:3])
        for name, df in kept.items():  # the run ends before its metrics
            df.write.parquet(f"{folder}/{name}/run=broken")
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs.committed, "commit_run", broken)
    with pytest.raises(RuntimeError, match="lost"):
        jobs.analyse_waiting_logs(files, events, feed, "daily", root, 2)
    assert all(df.isEmpty() for df in seen(spark, root).values())
    monkeypatch.setattr(jobs.committed, "commit_run", write)
    first = jobs.analyse_waiting_logs(files, events, feed, "daily", root, 2)
    now = seen(spark, root)
    assert sorted(r["file_path"] for r in now["marks"].collect()) == ["log2", "log3"]
    assert sorted(r["document_url"][-5:] for r in now["findings"].collect()) == sorted(
        f"{i}.pdf" for i in (2, 4, 0, 1, 5)
    )
    assert [r["document_url"][-5:] for r in now["invalid"].collect()] == ["3.pdf"]  # no landing page
    jobs.analyse_waiting_logs(files, events, feed, "daily", root, 5)
    jobs.analyse_waiting_logs(files, events, feed, "daily", root, 5)  # nothing waits any more
    now = seen(spark, root)
    assert sorted(r["file_path"] for r in now["marks"].collect()) == ["log0", "log1", "log2", "log3"]
    assert now["findings"].count() == now["findings"].select("document_url").distinct().count()
    counted = {(r["run"] == first, r["kind"]): r["value"] for r in now["metrics"].where("value > 0").collect()}
    assert counted[True, "logs"] == 2 and counted[False, "logs"] == 2 and counted[True, "findings"] == 5 and counted[True, "invalid"] == 1


def test_unchanged_files_are_not_hashed_again(spark):
    schema = "file_path string, size bigint, modified_at timestamp_ntz"
    rows = [("a", 1, BASE), ("b", 2, BASE), ("c", 3, BASE), ("c", 3, BASE)]
    asked = []

    def hashed(part):
        asked.append(sorted(r["file_path"] for r in part.collect()))
        return part.withColumn("checksum", F.when(F.col("file_path") != "b", F.concat("file_path", "size")))

    known = spark.createDataFrame([], schema + ", checksum string")
    known = tracking.refreshed_sums(spark.createDataFrame(rows, schema), known, hashed)
    assert {r["file_path"]: r["checksum"] for r in known.collect()} == {"a": "a1", "b": None, "c": "c3"}
    known = tracking.refreshed_sums(spark.createDataFrame(rows, schema), known.drop("fresh"), hashed)
    changed = [("a", 1, BASE + timedelta(days=1)), ("c", 3, BASE), ("d", 1, None)]
    known = tracking.refreshed_sums(spark.createDataFrame(changed, schema), known.drop("fresh"), hashed)
    assert asked == [["a", "b", "c"], ["b"], ["a", "d"]]
    assert {(r["file_path"], r["checksum"], r["fresh"]) for r in known.collect()} == {("a", "a1", True), ("c", "c3", False), ("d", "d1", True)}


def test_lookups_read_the_blocks_of_their_keys(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('uk,co,h', lpad(id % 200, 3, '0'), ')/p/', id) AS k", "CAST(id AS STRING) AS t")
    folder = str(tmp_path)
    blocks.write_index(rows.where("t % 2 = 0").union(spark.createDataFrame([(None, "x")], "k string, t string")), "k", "t", folder, 10)
    blocks.append_index(rows.where("t % 2 = 1"), "k", "t", folder, 10)
    assert blocks.manifest(spark, folder).count() == 20
    for value, kind, n in (("uk,co,h007)", "prefix", 20), ("uk,co,h007", "host", 20), ("uk,co,h007)/p/7", "exact", 1), ("uk,co,zz", "domain", 0), ("uk,", "prefix", 4000)):
        got = blocks.lookup(spark, folder, "k", value, kind)
        assert got.count() == n
        assert n in (0, 4000) or len(blocks.files_of(spark, folder, value, kind)) <= 4  # of 20: both halves, a border at most
    assert blocks.files_of(spark, folder, "uk,co,zz") == []
    before = set(blocks.files_of(spark, folder, "uk,"))
    blocks.merge_index(spark, "k", "t", folder, 10)
    assert blocks.manifest(spark, folder).count() == 10 and len(blocks.files_of(spark, folder, "uk,co,h007)")) <= 2
    assert before.isdisjoint(blocks.files_of(spark, folder, "uk,")) and blocks.lookup(spark, folder, "k", "uk,").count() == 4000
    blocks.append_index(spark.createDataFrame([("uk,co,h007)/p/x", "0")], "k string, t string"), "k", "t", folder, 1)
    assert blocks.lookup(spark, folder, "k", "uk,co,h007)").count() == 21
