"""Prefix trie of conversations against brute force, with every mix of light and heavy nodes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import prefix_trie
from tidemark.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of (conv_id, turn, role, text) rows without equal turns of different content."""
    said = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        said[c].append((role or "", text or ""))
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(said.get(c - c % 100, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(built.items()):
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1] if node else "")
    return sorted(
        (
            members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), children[n], leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest(),
        )
        for n in members
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(4)
    rows = []
    for c in [*range(0, 60), 100, 103, 107, 250, 251, 300]:
        for turn in range(draw.choice([1, 2, 3, 5, 9])):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn, draw.choice(["user", None]), draw.choice(["hé", "", None, "yes please", "no"])))
    rows += [(c, t, "user", f"line {t // 2}") for c in (401, 402, 455) for t in range(40)]
    rows += [(None, 1, "user", "nobody's"), (7, 100, "a", "b"), (7, 100, "a", "b")]
    return rows


@pytest.mark.parametrize("limit", [0, 6, 40, 10**6])
def test_trie_is_brute_force(spark, talks, limit, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 3)
    frame = spark.createDataFrame(talks, SCHEMA).selectExpr("*", "'x' AS place", "1 AS depth", "0L AS d1", "'y' AS base", "2 AS n")
    placed = stored(prefix_trie.placed_turns(frame), "placed")
    got = prefix_trie.trie(*prefix_trie.rebuilt(placed), limit=limit, shard_nodes=30)
    assert rows_of(got) == brute(talks)


def test_empty_and_lone(spark):
    assert rows_of(prefix_trie.shared_beginnings(spark.createDataFrame([], SCHEMA))) == []
    lone = [(5, 1, "user", "taken away with a base that is not there")] + [(c, 1, None, None) for c in (6, 8)]
    assert rows_of(prefix_trie.shared_beginnings(spark.createDataFrame(lone, SCHEMA))) == brute(lone)


def test_clashing_names_are_noticed(spark, talks):
    placed = stored(prefix_trie.placed_turns(spark.createDataFrame(talks, SCHEMA)), "placed")
    turns, sizes = prefix_trie.rebuilt(placed)
    with pytest.raises(ValueError, match="clash"):
        prefix_trie.trie(turns, sizes, bits=2)


def test_slots_are_minimal_and_verified():
    draw = np.random.default_rng(1)
    d1, d2 = draw.integers(-(2**63), 2**63 - 1, (2, 5000))
    table = prefix_trie.SlotTable(d1[:4000], d2[:4000])
    assert sorted(table.find(d1[:4000], d2[:4000])) == list(range(4000))
    assert (table.find(d1[4000:], d2[4000:]) == -1).all() and (table.find(d1[:4000], d2[:4000] + 1) == -1).all()
    assert len(prefix_trie.SlotTable(d1[:0], d2[:0]).find(d1[:0], d2[:0])) == 0
