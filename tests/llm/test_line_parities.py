"""Pairs that the parities of shingles exclude, and rows of a band that meet no other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_line_signatures import drawn, jaccard, shingles
from tidemark.llm import line_dedup

MET = "key long, h long, sketch long, open boolean, group long"


def family(n=60):
    """Variants of one line, about 0.6 similar to each other, and two that are 0.8 similar to the first."""
    draw = np.random.default_rng(8)
    base = [chr(c) for c in draw.integers(97, 123, 400)]
    lines = []
    for _ in range(n):
        line = list(base)
        for at in draw.integers(0, 400, 10):
            line[at] = "#"
        lines.append("".join(line))
    return lines + [lines[0] + " and more", "more and " + lines[0]]


def test_parities_bound_the_shingles_of_one_line_alone(spark):
    lines = sorted({x for pair in drawn(5, 150) for x in pair})
    rows = line_dedup._parities(spark.createDataFrame(list(enumerate(lines)), "h long, line string")).collect()
    assert sorted(r["h"] for r in rows) == list(range(len(lines)))
    bits = {r["h"]: [r[f"p{i}"] & (1 << 64) - 1 for i in range(line_dedup.PARITY_WORDS)] for r in rows}
    assert all(r["n"] == len(shingles(lines[r["h"]])) for r in rows)
    for a in range(0, len(lines), 7):
        for b in range(len(lines)):
            differ = sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b]))
            assert differ <= len(shingles(lines[a]) ^ shingles(lines[b]))


@pytest.mark.parametrize("paired", [512, 7])
def test_similar_lines_below_the_limit_make_no_pairs(spark, monkeypatch, paired):
    """62 open lines of one band whose sketches are alike: 3 links, not 1,891 pairs."""
    monkeypatch.setattr(line_dedup, "PAIRED_ROWS", paired)
    lines = family()
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    met = spark.createDataFrame([(1, i, 7, True, i) for i in range(len(lines))], MET)
    links = {(a, b) for b in range(len(lines)) for a in range(b) if jaccard(lines[a], lines[b]) >= 0.8}
    monkeypatch.setattr(line_dedup, "PARITY_BAND", 10)
    pairs = [tuple(p) for p in line_dedup._met_pairs(met, texts).collect()]
    assert links == {(0, 60), (0, 61), (60, 61)} and links <= set(pairs) and len(pairs) == len(set(pairs)) < 30
    monkeypatch.setattr(line_dedup, "PARITY_BAND", 100)
    assert line_dedup._met_pairs(met, texts).count() == 62 * 61 // 2


@pytest.mark.parametrize("paired", [512, 2])
def test_rows_alike_to_no_other_group_go(spark, monkeypatch, paired):
    monkeypatch.setattr(line_dedup, "PAIRED_ROWS", paired)
    far, near = -1, 0
    rows = [(1, 1, near, True, 1), (1, 2, near, False, 2), (1, 3, far, True, 3), (1, 4, near, False, 2), (2, 5, near, True, 5), (2, 6, near, True, 5), (3, 7, near, False, 7), (3, 8, near, False, 8)]
    mates = line_dedup._mates(spark.createDataFrame(rows, MET))
    assert sorted(r["h"] for r in mates.collect()) == [1, 2, 4] and mates.where(F.col("key") != 1).isEmpty()
