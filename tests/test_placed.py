"""Partition numbers of published messages."""

import hashlib

from tidemark.sources import topics


def test_partition_follows_the_key_alone(spark):
    rows = [("http://a.example.co.uk/1", 1), ("https://A.example.co.uk/2?x", 2), ("http://b.example.org/", 3), (None, 4), ("", 5)]
    df = spark.createDataFrame(rows, "url string, n long").repartition(3)
    got = [(r["key"], r["partition"]) for r in topics.placed_messages(df, "url", ["n"]).collect()]
    assert len(got) == 5
    for key, number in got:
        assert number == int(hashlib.md5((key or "").encode()).hexdigest()[:8], 16) % topics.PARTITIONS
    assert topics.placed_messages(df.limit(0), "url", ["n"]).collect() == []
