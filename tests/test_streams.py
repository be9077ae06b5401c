import re
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import quota, textindex
from tidemark.streaming import feeds, gates, intake, versions

BASE = datetime(2024, 1, 1)


def files(spark, folder, rows, schema, parts):
    """One input file per part, so that the stream runs in several batches."""
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return intake.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, max_files=1)


def test_quota_gate_over_batches_equals_batch(spark, tmp_path):
    rows = []
    for i in range(60):
        rows.append((i, f"h{i % 2}", BASE + timedelta(minutes=7 * i), 200 if i % 5 else 404, 700, "P" if i % 11 == 0 else "L", i in (0, 1, 24, 41)))
    schema = "event_id bigint, host string, ts timestamp_ntz, status_code int, size bigint, hop_path string, launched boolean"
    stream = files(spark, str(tmp_path), rows, schema, 4)
    out = f"{tmp_path}/out"
    gates.quota_gate(stream, 4, out, f"{tmp_path}/state", f"{tmp_path}/cp", available_now=True).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("event_id", "used_bytes", "capped").collect())
    batch = quota.running_quota(
        spark.createDataFrame(rows, schema), "host", "ts", "event_id", "status_code", "size", "hop_path", "launched", max_kb=4
    )
    want = sorted(tuple(r) for r in batch.select("event_id", "used_bytes", "capped").collect())
    assert got == want and any(r[2] for r in got) and not all(r[2] for r in got)


def test_recrawl_gate_over_batches(spark, tmp_path):
    gates.use_rocksdb(spark)
    rows = [(i, f"k{i % 3}", BASE + timedelta(hours=5 * i)) for i in range(40)]
    stream = intake.event_time(files(spark, str(tmp_path), rows, "event_id bigint, urlkey string, ts timestamp_ntz", 3))
    passed = gates.recrawl_gate(stream, 2 * 86_400)
    intake.append_to(passed, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True).awaitTermination()
    got = {r["event_id"]: r["passed"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last, want = {}, {}
    for i, key, ts in rows:
        want[i] = key not in last or ts - last[key] >= timedelta(days=2)
        if want[i]:
            last[key] = ts
    assert got == want


def test_restart_adds_nothing(spark, tmp_path):
    rows = [(i, BASE + timedelta(hours=i)) for i in range(30)]
    stream = files(spark, str(tmp_path), rows, "event_id bigint, ts timestamp_ntz", 2)
    for _ in range(2):
        intake.tail_to_days(stream, "ts", f"{tmp_path}/days", f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/days").count() == 30


def test_summary_over_batches(spark, tmp_path):
    rows = [(i, f"h{i % 3}", BASE + timedelta(minutes=i), 10) for i in range(90)]
    stream = files(spark, str(tmp_path), rows, "event_id bigint, host string, ts timestamp_ntz, size bigint", 3)
    feeds.rolling_summary(stream, "ts", ["host"], "size", 3600, f"{tmp_path}/p", f"{tmp_path}/s", f"{tmp_path}/cp", available_now=True).awaitTermination()
    got = {(r["dimension"], r["value"]): (r["n"], r["bytes"]) for r in feeds.read_summary(f"{tmp_path}/s", spark).collect()}
    assert got[("total", None)] == (60, 600) and got[("host", "h0")] == (20, 200)


def test_empty_hours_count_as_low_activity(spark):
    hourly = spark.createDataFrame([(BASE, 50), (BASE + timedelta(hours=9), 50)], "ts timestamp_ntz, n bigint")
    first, last = (F.lit(BASE + timedelta(hours=h)).cast("timestamp_ntz") for h in (0, 9))
    got = feeds.activity_alerts(hourly, "ts", "n", first, last).collect()
    assert [(r["since"], r["until"]) for r in got] == [(BASE + timedelta(hours=4), BASE + timedelta(hours=8))]


def test_retention_drops_whole_days(spark, tmp_path):
    df = spark.createDataFrame([(i, str(date(2024, 1, 1) + timedelta(days=i))) for i in range(5)], "id int, d string")
    df.select("id", F.to_date("d").alias("day")).write.partitionBy("day").option("path", f"{tmp_path}/t").saveAsTable("kept_days")
    try:
        assert intake.drop_old_days(spark, "kept_days", date(2024, 1, 5), 2) == ["2024-01-01", "2024-01-02", "2024-01-03"]
        assert sorted(r["id"] for r in spark.table("kept_days").collect()) == [3, 4]
    finally:
        spark.sql("DROP TABLE kept_days")


def test_near_copies_share_a_group(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [(1, base), (2, base + " end"), (3, base.replace("word7 ", "other ")), (4, " ".join(f"x{i}" for i in range(300))), (5, ""), (6, "word1")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    groups = {r["doc_id"]: r["group"] for r in textindex.near_copy_groups(textindex.fingerprints(df, "doc_id", "text"), "doc_id").collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 6: 6}


def test_no_group_without_similarity(spark, small):
    """Documents that share a band by chance are not linked: every group hangs together by pairs of real overlap."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: textindex_words(r["text"]) for r in docs.collect()}
    groups = {}
    for r in textindex.near_copy_groups(textindex.fingerprints(docs, "doc_id", "text"), "doc_id").collect():
        groups.setdefault(r["group"], []).append(r["doc_id"])
    assert any(len(g) > 1 for g in groups.values())
    for members in groups.values():
        for doc in members:
            others = [texts[o] for o in members if o != doc]
            assert not others or max(len(texts[doc] & o) / len(texts[doc] | o) for o in others) >= 0.25


def textindex_words(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def test_hash_minima_estimate_jaccard(spark):
    """Equal minima are about as frequent as the texts' shingle overlap."""
    a = [f"w{i}" for i in range(400)]
    b = a[:300] + [f"v{i}" for i in range(100)]
    sets = [{" ".join(t[i : i + 3]) for i in range(398)} for t in (a, b)]
    jaccard = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id bigint, text string")
    values = textindex.fingerprints(df, "doc_id", "text").groupBy("band").agg(F.collect_list("value").alias("v")).collect()
    pairs = [(x.split("-"), y.split("-")) for x, y in (r["v"] for r in values)]
    equal = sum(p == q for x, y in pairs for p, q in zip(x, y)) / 16
    assert abs(equal - jaccard) < 0.3


def test_late_rows_and_launches_get_the_verdict_of_their_time(spark, tmp_path):
    gates.use_rocksdb(spark)
    rows = []
    for i in range(120):
        rows.append((i, f"h{i % 3}", BASE + timedelta(minutes=7 * i), 200 if i % 5 else None, 700, "P" if i % 11 == 0 else "L", i in (0, 1, 2, 43, 80)))
    arrival = sorted(rows, key=lambda r: r[0] + (9 if r[0] % 7 == 0 else 0))  # some come an hour late, launches among them
    schema = "event_id bigint, host string, ts timestamp_ntz, status_code int, size bigint, hop_path string, launched boolean"
    stream = files(spark, str(tmp_path), arrival, schema, 6)
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    gates.quota_gate(stream, 4, out, state, f"{tmp_path}/cp", available_now=True, delay="90 minutes").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("event_id", "used_bytes", "capped").collect())
    batch = quota.running_quota(
        spark.createDataFrame(rows, schema), "host", "ts", "event_id", "status_code", "size", "hop_path", "launched", max_kb=4
    )
    closed = rows[-1][2] - timedelta(minutes=90)
    closed = closed.replace(minute=0)
    want = sorted(tuple(r) for r in batch.where(F.col("ts") < F.lit(closed)).select("event_id", "used_bytes", "capped").collect())
    assert got == want and len(want) > 90 and any(r[2] for r in got)


def test_state_writes_touched_keys_only(spark, tmp_path):
    state = versions.KeyedState(str(tmp_path), ["host"], gates.QUOTA_STATE, whole_every=3)
    known = {}
    for b in range(11):
        touched = {f"h{b % 4}": b * 10, "h9": b} if b != 5 else {}
        known |= touched
        state.write(spark.createDataFrame(list(touched.items()), gates.QUOTA_STATE), b)
        assert spark.read.parquet(f"{tmp_path}/changes/batch={b}").count() == len(touched)
        for again in (b, b + 1):  # also for a batch that is repeated
            assert state.read(spark, again).count() <= len(known)
        assert {r["host"]: r["used"] for r in state.read(spark, b + 1).collect()} == known
    assert len(list(tmp_path.glob("changes/*"))) <= 8 and len(list(tmp_path.glob("whole/*"))) <= 2


def test_summary_writes_its_batch_and_removes_what_is_behind(spark, tmp_path):
    rows = [(i, f"h{i % 3}", BASE + timedelta(minutes=10 * i), 10) for i in range(90)]
    stream = files(spark, str(tmp_path), rows, "event_id bigint, host string, ts timestamp_ntz, size bigint", 6)
    partials = f"{tmp_path}/p"
    feeds.rolling_summary(stream, "ts", ["host"], "size", 7200, partials, f"{tmp_path}/s", f"{tmp_path}/cp", available_now=True).awaitTermination()
    got = {(r["dimension"], r["value"]): (r["n"], r["bytes"]) for r in feeds.read_summary(f"{tmp_path}/s", spark).collect()}
    assert got == {("total", None): (12, 120), ("host", "h0"): (4, 40), ("host", "h1"): (4, 40), ("host", "h2"): (4, 40)}
    left = spark.read.parquet(partials)
    assert left.select("pane").distinct().count() <= 3 and left.where("dimension = 'total'").count() <= 18
    assert len(list(tmp_path.glob("s/version=*"))) <= 2


def test_held_rows_are_one_state_value_per_chunk():
    class Handle:
        values, timers = [], []

        def getListState(self, name, schema):
            return self

        def appendValue(self, value):
            self.values.append(value)

        def get(self):
            return iter(self.values)

        def clear(self):
            self.values.clear()

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers.append(at)

    held, handle = gates.HeldBuckets(["id", "name", "done"], ["id"], 3600), Handle()
    held.init(handle)
    chunks = [
        pd.DataFrame({"id": [1.0, None, 3.0], "name": ["a", None, "c"], "done": [True, None, False]}),
        pd.DataFrame({"id": range(10, 10 + gates.HELD_AT_ONCE), "name": "x", "done": None}),
    ]
    assert list(held.handleInputRows(("h", 2), iter(chunks), None)) == []
    assert len(handle.values) == 2 and handle.timers == [3 * 3600 * 1000]
    given = list(held.handleExpiredTimer(("h", 2), None, None))
    assert [len(g) for g in given] == [gates.HELD_AT_ONCE, 3] and not handle.values
    rows = [tuple(None if pd.isna(v) else v for v in r) for g in given for r in g.itertuples(index=False, name=None)]
    assert rows[:3] == [(1, "a", True), (None, None, None), (3, "c", False)]
    assert rows[3:] == [(10 + i, "x", None) for i in range(gates.HELD_AT_ONCE)]


def test_held_rows_leave_state_once_per_batch(spark, tmp_path, monkeypatch):
    gates.use_rocksdb(spark)
    kept = []

    def watched(batch, *args, **options):
        kept.append(batch.is_cached)
        return quota.running_quota(batch, *args, **options)

    monkeypatch.setattr(gates, "running_quota", watched)
    rows = [(i, "h", BASE + timedelta(minutes=40 * i), 200, 700, "L", i == 0) for i in range(12)]
    schema = "event_id bigint, host string, ts timestamp_ntz, status_code int, size bigint, hop_path string, launched boolean"
    stream = files(spark, str(tmp_path), rows, schema, 1)
    folders = [f"{tmp_path}/{name}" for name in ("out", "state", "cp")]
    gates.quota_gate(stream, 4, *folders, available_now=True, delay="1 hour").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(folders[0]).select("event_id", "used_bytes").collect())
    assert got == [(i, 700 * i) for i in range(len(got))] and len(got) > 5 and kept and all(kept)
