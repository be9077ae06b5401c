from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import content, crawl_fields as cf, storage_paths as sp
from tidemark.operators import curation, documents, filters, network
from tidemark.sinks import exports, publish
from tidemark.sources import crawl_log, feeds, listings, tables, topics


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_crawl_log_file(spark, tmp_path):
    (tmp_path / "crawl.log.cp00001").write_text(
        "2023-01-02T03:04:05.678Z   200       1234 https://www.example.co.uk/a.pdf LLE https://www.example.co.uk/ application/pdf #012"
        ' 20230102030405123+456 sha1:ABC https://www.example.co.uk/ Q:serverMaxSuccessKb,launchTimestamp:20230101000000 {"warcFilename":"a b.warc.gz","warcFileOffset":77,"scopeDecision":"ACCEPT by rule"}\n'
        "2023-01-02T03:04:06Z -5003 - http://example.co.uk/ - - unknown #001 - - - -\n"
        "\n"
        "this line is broken\n"
    )
    rows = crawl_log.read_crawl_log(spark, str(tmp_path / "crawl.log*"), "frequent").orderBy("timestamp").collect()
    bad, good, failed = rows
    assert bad["_corrupt"] == "this line is broken" and bad["url"] is None
    assert good["timestamp"] == datetime(2023, 1, 2, 3, 4, 5, 678000)
    assert (good["host"], good["status_code"], good["hop_path"], good["duration"]) == ("www.example.co.uk", 200, "LLE", 456)
    assert good["start_time"] == datetime(2023, 1, 2, 3, 4, 5, 123000)
    assert good["annotations"] == ["Q:serverMaxSuccessKb", "launchTimestamp:20230101000000"]
    assert (good["warc_filename"], good["warc_offset"]) == ("a b.warc.gz", 77)
    assert good["extra_info"]["scopeDecision"] == "ACCEPT by rule"
    assert (failed["status_code"], failed["size"], failed["hop_path"], failed["via"]) == (-5003, None, "", None)
    assert failed["annotations"] == [] and failed["_corrupt"] is None
    assert len(crawl_log.EVENT_SCHEMA.fields) == 27


def test_listing(spark):
    got = listings.parse_listing(
        lines(
            spark,
            "-rw-r--r--   3 access supergroup   1006632 2023-01-02 03:04 /heritrix/output/j/20230101000000/logs/crawl log",
            "drwxr-xr-x   - access supergroup         0 2023-01-02 03:04 /heritrix/output",
            "lsr: DEPRECATED: Please use 'ls -R' instead.",
            "-rw-r--r--   3 access supergr",
        )
    ).collect()
    assert [r["_corrupt"] for r in got if r["file_path"] is None] == [
        "lsr: DEPRECATED: Please use 'ls -R' instead.", "-rw-r--r--   3 access supergr",
    ]
    assert [(r["size"], r["file_path"], r["modified_at"]) for r in got if r["_corrupt"] is None] == [
        (1006632, "/heritrix/output/j/20230101000000/logs/crawl log", datetime(2023, 1, 2, 3, 4))
    ]


def test_capture_index_lines(spark):
    text = (
        "uk,example)/a/b.html 20230102030405 https://www.example.uk/a/b.html text/html 301 " + "A" * 32
        + " - - 681 1024 /heritrix/output/frequent-npld/20230101000000/warcs/ARC-NPLD-20230101000000000-00001-80~host~8443.warc.gz"
    )
    back = listings.parse_index_lines(lines(spark, text, " CDX N b a", "x y"))
    assert [r["_corrupt"] for r in back.where("urlkey IS NULL").collect()] == ["x y"]
    back = back.where("_corrupt IS NULL").drop("_corrupt")
    row = back.first()
    assert back.count() == 1 and row["redirect"] is None and row["offset"] == 1024 and row["status"] == 301
    assert listings.index_lines(back).first()["value"] == text
    parts = back.select(
        sp.job_name("filename").alias("job"), sp.stream("filename").alias("stream"), sp.file_kind("filename").alias("kind"),
        sp.archive_ts17(sp.file_name("filename")).alias("ts17"), sp.archive_port(sp.file_name("filename")).alias("port"),
    ).first()
    assert tuple(parts) == ("frequent-npld", "frequent", "warcs", "20230101000000000", 8443)


def test_feed_and_corrupt_line(spark, tmp_path):
    (tmp_path / "feed.jsonl").write_text(
        '{"id": 1, "title": "T", "seeds": ["http://a.uk/", "http://b.uk/x"], "schedules": [{"frequency": "DAILY", "start": "2024-01-01T09:00:00"}], "hidden": false}\n'
        "{broken\n"
    )
    feed = feeds.read_feed(spark, str(tmp_path / "feed.jsonl"))
    assert feed.where("_corrupt is not null").count() == 1
    seeds = feeds.feed_seeds(feed).orderBy("url").collect()
    assert [(s["url"], s["urlkey"], s["frequency"]) for s in seeds] == [
        ("http://a.uk/", "uk,a)/", "DAILY"), ("http://b.uk/x", "uk,b)/x", "DAILY"),
    ]


def test_tracked_export(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id":"1","file_path_s":"/a","kind_s":"warcs","cdx_index_ss":["main"],"modified_at_dt":"2024-01-01T00:00:00","size":5}\n')
    row = listings.read_tracked(spark, str(tmp_path / "t.jsonl")).first()
    assert (row["file_path"], row["cdx_index"], row["size"]) == ("/a", ["main"], 5)


def test_newest_domain_list(spark, tmp_path):
    (tmp_path / "names-2024-01.csv").write_text("old.uk\n")
    (tmp_path / "names-2024-02.csv").write_text("a.uk\nb.uk\n")
    got = tables.latest_domain_list(spark, str(tmp_path / "names-*.csv")).orderBy("domain").collect()
    assert [tuple(r) for r in got] == [("a.uk", "2024-02"), ("b.uk", "2024-02")]


def test_option_builders():
    options = tables.jdbc_options("jdbc:postgresql://db/x", "documents_found", "viewer", "target_id", 0, 100, 4)
    assert options["numPartitions"] == "4" and "password" not in options
    with pytest.raises(ValueError):
        tables.jdbc_options("u", "t", "v", "c", 5, 5, 4)
    assert topics.read_options("k:9092", "fc.crawled")["startingOffsets"] == "earliest"
    assert topics.read_options("k:9092", "fc.crawled", from_start=False)["startingOffsets"] == "latest"
    assert topics.write_options("k:9092", "t")["topic"] == "t"


def test_messages_that_do_not_parse(spark):
    from pyspark.sql import types as T

    raw = lines(spark, '{"a": 1}', "nonsense")
    got = topics.parse_messages(raw, T.StructType.fromDDL("a int")).collect()
    assert sorted((r["a"], r["_corrupt"]) for r in got if r["a"]) == [(1, None)]
    assert [r["_corrupt"] for r in got if r["a"] is None] == ["nonsense"]


def test_addresses(spark):
    lists = spark.createDataFrame([("wide", "192.0.2.0/24"), ("pair", "192.0.2.10/31"), ("one", "192.0.2.12, 198.51.100.0/22")], "name string, ips string")
    ranges = network.cidr_ranges(lists, "ips", ["name"])
    ips = ["192.0.2.9", "192.0.2.10", "192.0.2.11", "192.0.2.12", "192.0.3.1", "198.51.103.255", "300.1.1.1", "x"]
    clients = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r["ip"]: r["name"] for r in network.lookup_ranges(clients, "ip", ranges, ["name"]).collect()}
    assert [got[i] for i in ips] == ["wide", "pair", "pair", "one", None, "one", None, None]


def test_content(spark):
    html = (
        "<html><!-- no --><script>x='<b>'</script><p>A &amp; B&nbsp;&lt;c&gt;</p> <a href='../up'>u</a>"
        '<A HREF="//cdn.example.org/x">c</A><a href="mailto:a@b">m</a> LS23 7BQ</html>'
    )
    df = spark.createDataFrame([(html, "http://www.example.co.uk/d/e?q")], "html string, url string")
    row = df.select(
        content.html_text("html").alias("text"), content.outlinks("html", "url").alias("links"),
        content.elements_used("html").alias("elements"), content.postcodes(content.html_text("html")).alias("postcodes"),
        content.sha1_base32(F.lit("da39a3ee5e6b4b0d3255bfef95601890afd80709")).alias("b32"),
        content.first_bytes_hex("html", 3).alias("first"),
    ).first()
    assert row["text"] == "A & B <c> u c m LS23 7BQ"
    assert row["links"] == ["http://www.example.co.uk/d/../up", "http://cdn.example.org/x"]
    assert row["elements"] == ["a", "b", "html", "p", "script"]
    assert row["postcodes"] == ["LS23 7BQ"]
    assert row["b32"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert row["first"] == "3c6874"


def test_field_expressions(spark):
    df = spark.createDataFrame([("a, b ,,-", "Text/HTML; x", 200), (None, "-", -5003)], "a string, m string, s int")
    got = df.select(cf.annotation_list("a").alias("a"), cf.mime_type("m").alias("m"), cf.status_class("s").alias("s")).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], "text/html", "2xx"), ([], None, "internal")]


def test_landing_page(spark):
    df = spark.createDataFrame([('<https://g.uk/p>; rel="up"', "v"), ("<https://g.uk/p>; rel=up", "v"), (None, "v")], "h string, via string")
    assert [r[0] for r in df.select(documents.landing_page("h", "via")).collect()] == ["https://g.uk/p", "https://g.uk/p", "v"]


def test_ad_hoc_refuses_unknown_names(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        filters.ad_hoc(df, [("b", "=", 1)])
    with pytest.raises(ValueError):
        filters.ad_hoc(df, [("a", "; drop", 1)])


def test_unknown_status_drops_out(spark):
    docs = spark.createDataFrame([(1, 0), (2, 9), (None, 0)], "id int, status int")
    from tidemark.operators.histograms import status_totals

    got = status_totals(docs, "status", curation.status_names(spark), "code", "status_name", "id").collect()
    assert [tuple(r) for r in got] == [("New", 1)]


def test_schedules(spark):
    from tidemark.functions.schedules import is_due

    cases = [
        ("DAILY", datetime(2024, 1, 1, 9, 30), None, datetime(2024, 1, 5, 9), True),
        ("DAILY", datetime(2024, 1, 1, 9, 30), None, datetime(2024, 1, 5, 10), False),
        ("DAILY", datetime(2024, 1, 1, 9, 30), datetime(2024, 1, 4), datetime(2024, 1, 5, 9), False),
        ("WEEKLY", datetime(2024, 1, 1, 9), None, datetime(2024, 1, 15, 9), True),
        ("MONTHLY", datetime(2024, 1, 31, 9), None, datetime(2024, 2, 29, 9), True),
        ("MONTHLY", datetime(2024, 1, 31, 9), None, datetime(2024, 3, 29, 9), False),
        ("QUARTERLY", datetime(2024, 1, 10, 9), None, datetime(2024, 4, 10, 9), True),
        ("QUARTERLY", datetime(2024, 1, 10, 9), None, datetime(2024, 3, 10, 9), False),
        ("ANNUAL", datetime(2023, 1, 10, 9), None, datetime(2024, 1, 10, 9), True),
        ("NEVERCRAWL", datetime(2024, 1, 1, 9), None, datetime(2024, 1, 1, 9), False),
        ("DAILY", datetime(2024, 1, 10, 9), None, datetime(2024, 1, 9, 9), False),
        ("DAILY", None, None, datetime(2024, 1, 9, 9), False),
    ]
    df = spark.createDataFrame(cases, "f string, s timestamp_ntz, e timestamp_ntz, h timestamp_ntz, due boolean")
    for row in df.withColumn("got", is_due("f", "s", "e", F.col("h"))).collect():
        assert row["got"] == row["due"], row


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    a, b = spark.range(5), spark.range(3)
    publish.publish_all({"a": a, "b": b}, root)
    assert {r["output"]: r["rows"] for r in publish.current_version(spark, root).collect()} == {"a": 5, "b": 3}
    with pytest.raises(ValueError):
        publish.publish_all({"a": spark.range(9), "b": spark.range(0)}, root, minimum_rows={"b": 1})
    # the failed run is invisible
    assert publish.read_published(spark, root, "a").count() == 5
    publish.publish_all({"a": spark.range(7), "b": b}, root)
    assert publish.read_published(spark, root, "a").count() == 7


def test_access_list_is_written_most_specific_first(spark, tmp_path):
    rules = spark.createDataFrame([("uk,a)", "allow"), ("uk,a)/x", "block")], "p string, access string")
    folder = str(tmp_path / "acl")
    exports.write_access_list(rules.repartition(2), "p", "access", folder)
    text = [line for part in sorted((tmp_path / "acl").glob("part-*")) for line in part.read_text().splitlines()]
    assert text == ['uk,a)/x - {"access":"block","url":"uk,a)/x"}', 'uk,a) - {"access":"allow","url":"uk,a)"}']


def test_upsert_rewrites_only_touched_days(spark, tmp_path):
    folder = str(tmp_path / "days")
    old = spark.createDataFrame(
        [("2024-01-01", "a", 1, 200, None), ("2024-01-02", "b", 1, 404, "x")], "day string, url string, v int, status int, thread string"
    ).withColumn("day", F.to_date("day"))
    old.write.partitionBy("day").parquet(folder)
    untouched = sorted(p.name for p in (tmp_path / "days" / "day=2024-01-02").glob("*.parquet"))
    new = spark.createDataFrame([("2024-01-01", "a", 2, None, "t")], "day string, url string, v int, status int, thread string").withColumn("day", F.to_date("day"))
    for _ in range(2):
        exports.upsert_into_days(new, "day", ["url"], ["v"], ["status", "thread"], folder)
        rows = sorted((r["url"], r["v"], r["status"], r["thread"]) for r in spark.read.parquet(folder).collect())
        assert rows == [("a", 2, 200, "t"), ("b", 1, 404, "x")]
    assert sorted(p.name for p in (tmp_path / "days" / "day=2024-01-02").glob("*.parquet")) == untouched
