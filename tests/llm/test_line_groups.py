"""Pairs that the lines of a band still meet after some of them are joined."""

from pyspark.sql import functions as F

from tidemark.llm import line_dedup

MET = "key long, h long, sketch long, open boolean, group long"


def test_joined_lines_do_not_meet_again(spark, monkeypatch):
    """200 open lines of one group and three strangers: 603 pairs, not 20,503."""
    monkeypatch.setattr(line_dedup, "PAIRED_ROWS", 32)
    rows = [(1, i, 7, True, 0 if i < 200 else i) for i in range(203)]
    pairs = line_dedup._tiled(spark.createDataFrame(rows, MET)).collect()
    assert len(pairs) == len(set(map(frozenset, pairs))) == 200 * 3 + 3
    assert all(max(p) >= 200 for p in pairs)


def test_middle_row_meets_other_groups_once(spark):
    """Each variant differs from row 50 in one place and from the others in two; bands stay until one group is left."""
    rows = [(1, i, 1 << i if i != 50 else 0, True, i) for i in range(60)]
    met = spark.createDataFrame(rows, MET)
    spokes = line_dedup._middle_spokes(met)
    assert sorted(map(tuple, spokes.collect())) == [(50, i) for i in range(60) if i != 50]
    assert line_dedup._regrouped(met, spokes).isEmpty()
    left = line_dedup._regrouped(met, spokes.where("b <> 3"))
    assert left.groupBy("group").count().orderBy("group").collect() == [(0, 59), (3, 1)]
    assert line_dedup._tiled(left).count() == 59 and line_dedup._tiled(left.withColumn("open", F.col("h") == 3)).count() == 59
