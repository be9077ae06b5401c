"""Signatures and scores of lines against sets of shingles, without Spark."""

import numpy as np
import pandas as pd

from tidemark.llm import line_dedup


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def drawn(seed=3, n=400):
    """Pairs of lines from far apart to equal."""
    draw = np.random.default_rng(seed)
    pairs = []
    for _ in range(n):
        line = "".join(map(chr, draw.integers(97, 123, draw.integers(1, 300))))
        other = list(line)
        for at in draw.integers(0, len(other), draw.integers(0, 1 + len(other) // 25)):
            other[at] = chr(draw.integers(0x4E00, 0x4E50))
        pairs.append((line, "".join(other)))
    return pairs + [("a", "a\0"), ("ab", "abc"), ("a\U0010ffff", "a"), ("x" * 9, "x" * 300_000), ("é€𝄞 word", "é€𝄞 word")]


def test_scores_equal_sets_of_shingles():
    pairs = drawn()
    batch = pd.DataFrame({"a": range(len(pairs)), "b": range(len(pairs)), "line_a": [a for a, _ in pairs], "line_b": [b for _, b in pairs]})
    (scored,) = line_dedup._jaccard(iter([batch]))
    assert scored["score"].tolist() == [jaccard(a, b) for a, b in pairs]


def test_signatures_do_not_hang_on_neighbours():
    lines = [x for pair in drawn() for x in pair]
    alone = np.concatenate([line_dedup._minima([x]) for x in lines])
    assert (line_dedup._minima(lines) == alone).all()


def test_rows_agree_as_often_as_lines_are_similar():
    pairs = [(a, b) for a, b in drawn(4, 3000) if 0.8 <= jaccard(a, b) < 1]
    one, other = (line_dedup._minima([p[side] for p in pairs]) for side in (0, 1))
    same = one == other
    assert len(pairs) > 300 and abs(same.mean() - np.mean([jaccard(a, b) for a, b in pairs])) < 0.02
    bands = same.reshape(len(pairs), -1, line_dedup.BAND_ROWS).all(2).any(1)
    low = (1 << line_dedup.SKETCH_BITS) - 1
    sketch = ((one & low) == (other & low))[:, : line_dedup.SKETCH_ROWS].sum(1) >= line_dedup.SKETCH_AGREES
    assert (bands & sketch).mean() >= 0.99


def test_repeated_lines_of_a_task_are_signed_once():
    batch = pd.DataFrame({"h": [1, 2, 1, 3], "line": ["one line", "two", "one line", "three lines"]})
    got = [h for out in line_dedup._signed(iter([batch, batch, batch.iloc[:0]])) for h in out["h"]]
    assert got == [1, 2, 3]


def test_links_of_a_task_are_a_forest():
    """A group of n similar lines leaves n - 1 links, not all pairs, and connects what all pairs connect."""
    base = "abcdefghijklmnopqrstuvwxyz" * 8
    lines = [base + str(i) for i in range(30)] + [base.upper() + str(i) for i in range(20)] + ["alone", "alone too, but not the same"]
    pairs = [(a, b) for b in range(len(lines)) for a in range(b)]
    rows = pd.DataFrame(pairs, columns=["a", "b"])
    rows["line_a"], rows["line_b"] = ([lines[i] for i in rows[side]] for side in ("a", "b"))
    links = [link for out in line_dedup._joining(iter([rows[:500], rows[500:], rows[:0]])) for link in out.itertuples(index=False, name=None)]
    assert len(links) == 29 + 19 and all(jaccard(lines[a], lines[b]) >= 0.8 for a, b in links)
    group = list(range(len(lines)))
    for a, b in links:
        group = [group[a] if g == group[b] else g for g in group]
    assert len(set(group[:30])) == len(set(group[30:50])) == 1 and len(set(group)) == 4
