"""Prefix trie of conversations in minimal-perfect-hash node tables.

Every distinct sequence of first turns is a node. A sequence is named by two 64-bit numbers: the exclusive or, over its turns, of a hash of
place and turn. Prefixes of a conversation are then running aggregates, split by (conversation, ``CHUNK`` turns) so that one
conversation with very many turns is spread over tasks. Names are verified: all rows of one name must have one depth, one parent's
name and one last turn, which makes equal names equal sequences by induction; else another seed is taken.

Distinct names are enumerated with counts by partial aggregation. The rows below a node, an upper bound of its subtree, only shrink on the
way down. *Light* nodes have ``LIMIT`` at most; whole light subtrees are dealt to shards. A shard gives its names the slots of a
minimal perfect hash (levels of bits; each name is compared with the name in its slot), scatters counts into flat arrays by slot and adds them
up through the array of parent slots, deepest nodes first. The few *heavy* nodes above get the totals of light tops, then
add up by doubling: each round sends a node's total to the ancestor twice as far up, so rounds grow with the logarithm of depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, stored
from tidemark.operators.ordered import rank_by_range

# Rows below a light node, nodes of a shard on average, turns of a conversation that one window holds, ids joined in one piece.
LIMIT, SHARD_NODES, CHUNK, IDS_AT_ONCE = 50_000, 100_000, 4096, 8192
# The contract's conversations: turns shared with the first conversation of a hundred.
SHARED_TURNS, SHARED_BY = 6, 100
SEEDS = 4
_U = np.uint64
_NO_TEXT = hashlib.sha256(b"").hexdigest()


def placed_turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, place, t1, t2, chars): turns numbered from 1 in order of ``turn``, null first, ties by content; rows without an id are left out."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        *[F.xxhash64(F.lit(lane), *said).alias(f"t{lane}") for lane in (1, 2)],
        F.length(said[1]).cast("long").alias("chars"),
    )
    return rank_by_range(rows, ["conv_id"], ["turn", "t1", "t2"], "place").drop("turn")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, sizes) of conversations that share beginnings: (conv_id, place, t1, t2, chars, n) and (conv_id, n).

    Conversation c takes its first h turns from conversation c - c % 100, h = crc32(c) % 6, and the turns after its first h from itself.
    """
    own = placed.groupBy("conv_id").agg(F.max("place").alias("n_own"))
    base = (F.col("conv_id") - F.col("conv_id") % SHARED_BY).alias("base")
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS
    bases = own.where(F.col("conv_id") % SHARED_BY == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("wanted", F.coalesce("n_base", F.lit(0)))
    sizes = stored(
        own.select("conv_id", "n_own", base, wanted.alias("wanted"))
        .join(bases, "base", "left")
        .withColumn("taken", taken)
        .withColumn("n", F.col("taken") + F.greatest(F.col("n_own") - F.col("wanted"), F.lit(0))),
        "conversation-sizes",
    )
    heads = placed.where((F.col("conv_id") % SHARED_BY == 0) & (F.col("place") < SHARED_TURNS)).withColumnRenamed("conv_id", "base")
    columns = ["conv_id", "place", "t1", "t2", "chars", "n"]
    first = sizes.where("taken > 0").join(heads, "base").where("place <= taken").select(*columns)
    rest = placed.join(sizes.select("conv_id", "wanted", "taken", "n"), "conv_id").where("place > wanted")
    rest = rest.withColumn("place", F.col("place") - F.col("wanted") + F.col("taken")).select(*columns)
    return stored(first.unionByName(rest), "rebuilt-turns"), sizes.select("conv_id", "n")


def prefixes(turns: DataFrame, sizes: DataFrame, seed: int, bits: int = 64) -> DataFrame:
    """A row for each prefix of each conversation, the empty one included: its name (d1, d2), the parent's (p1, p2), last turn, depth.

    ``bits`` cuts names short, to test that clashes are noticed.
    """
    place = F.col("place")
    lanes = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), place, "t1", "t2"), 64 - bits) if bits < 64 else F.xxhash64(F.lit(seed), F.lit(i), place, "t1", "t2") for i in (1, 2)]
    rows = turns.withColumns({"z1": lanes[0], "z2": lanes[1], "chunk": F.floor((place - 1) / CHUNK)})
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"))
    carried = carried.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    within = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.join(carried, ["conv_id", "chunk"]).withColumns(
        {f"d{i}": F.col(f"c{i}").bitwiseXOR(F.bit_xor(f"z{i}").over(within)) for i in (1, 2)}
    )
    below = named.select(
        "conv_id", place.cast("long").alias("depth"), "n", "chars", "t1", "t2", "d1", "d2",
        *[F.col(f"d{i}").bitwiseXOR(F.col(f"z{i}")).alias(f"p{i}") for i in (1, 2)],
    )
    none = F.lit(None).cast("long")
    root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("chars"), none.alias("t1"), none.alias("t2"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), none.alias("p1"), none.alias("p2"))
    return below.unionByName(root)


def enumerated(rows: DataFrame) -> DataFrame:
    """A row for each name: smallest member, members, rows below, and whether all rows agree."""
    same = F.struct("depth", F.coalesce("p1", F.lit(0)), F.coalesce("p2", F.lit(0)), F.coalesce("t1", F.lit(0)), F.coalesce("t2", F.lit(0)), "chars")
    return rows.groupBy("d1", "d2").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.sum(F.col("n") - F.col("depth") + 1).alias("below"),
        (F.min(same) == F.max(same)).alias("agree"),
    )


class SlotTable:
    """Minimal perfect hash of names (pairs of 64-bit numbers, all different): n names have the slots 0 to n - 1.

    On each level every name left is sent to a bit; names alone on theirs stay, the others go on. A name's slot is the number of set bits
    before its own.
    """

    def __init__(self, d1: np.ndarray, d2: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (set bits, set bits before each)
        left, before = np.arange(len(d1)), 0
        while len(left):
            width = 2 * len(left) + 1
            at = self._bit(d1[left], d2[left], len(self.levels), width)
            alone = np.bincount(at, minlength=width) == 1
            self.levels.append((alone, before + np.cumsum(alone) - alone))
            left, before = left[~alone[at]], before + int(alone.sum())
        self.d1, self.d2 = np.zeros_like(d1), np.zeros_like(d2)
        slots = self._slots(d1, d2)
        self.d1[slots], self.d2[slots] = d1, d2

    @staticmethod
    def _bit(d1: np.ndarray, d2: np.ndarray, level: int, width: int) -> np.ndarray:
        mixed = (d1.view(_U) + _U(level)) * _U(0x9E3779B97F4A7C15) ^ d2.view(_U) * _U(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> _U(32))) * _U(0x94D049BB133111EB)
        return ((mixed ^ (mixed >> _U(29))) % _U(width)).astype(np.int64)

    def _slots(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(d1), -1), np.arange(len(d1))
        for level, (bits, before) in enumerate(self.levels):
            at = self._bit(d1[left], d2[left], level, len(bits))
            slots[left[bits[at]]] = before[at[bits[at]]]
            left = left[~bits[at]]
        return slots

    def find(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Slots of names; -1 for a name that is not the one in its slot."""
        slots = self._slots(d1, d2)
        return np.where((slots >= 0) & (self.d1[slots] == d1) & (self.d2[slots] == d2), slots, -1)


_FILLED = "d1 long, d2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, is_top boolean"


def filled(shard: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard with sums over their subtrees."""
    d1, d2 = (shard[c].to_numpy(np.int64) for c in ("d1", "d2"))
    table = SlotTable(d1, d2)
    slot = table.find(d1, d2)
    if (np.sort(slot) != np.arange(len(slot))).any():
        raise ValueError("a name is twice in a shard")
    top = shard["is_top"].to_numpy(bool)
    up = table.find(*(shard[c].to_numpy(np.int64) for c in ("p1", "p2")))
    if (up[~top] < 0).any():
        raise ValueError("a node's parent is not in its shard")

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(slot), dtype=np.int64)
        out[slot] = values
        return out

    depth, convs, chars, first = (scattered(shard[c].to_numpy(np.int64)) for c in ("depth", "n_convs", "chars", "conv_id"))
    parent = scattered(np.where(top, -1, up))
    children = np.bincount(parent[parent >= 0], minlength=len(slot))
    leaves, saved = (children == 0).astype(np.int64), (convs - 1) * chars
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(depth[order]) != 0, True])
    for start, stop in zip(edges, edges[1:], strict=False):
        level = order[start:stop]
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    out = shard[["d1", "d2", "p1", "p2", "conv_id", "depth"]].copy()
    out["parent_conv_id"] = pd.arrays.IntegerArray(first[parent[slot]], top)
    out["n_convs"], out["n_children"], out["n_leaves"], out["saved_tokens"] = convs[slot], children[slot], leaves[slot], saved[slot]
    out["is_top"] = top
    return out


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (d1, d2, conv_id) to (d1, d2, first id, ids joined by commas), ``IDS_AT_ONCE`` ids at most in a row."""
    for batch in batches:
        d1, d2, ids = (batch[c].to_numpy(np.int64) for c in ("d1", "d2", "conv_id"))
        new = np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]
        since = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        opens = np.flatnonzero(new | (since % IDS_AT_ONCE == 0))
        text = list(map(str, ids.tolist()))
        joined = [",".join(text[a:b]) for a, b in zip(opens, [*opens[1:], len(ids)], strict=True)]
        yield pd.DataFrame({"d1": d1[opens], "d2": d2[opens], "first": ids[opens], "ids": joined})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in order to one digest per name; a name's list is streamed, never held."""
    name, digest = None, None
    for batch in batches:
        out = []
        for d1, d2, ids in zip(batch["d1"], batch["d2"], batch["ids"], strict=True):
            if name == (d1, d2):
                digest.update(f",{ids}".encode())
                continue
            if digest:
                out.append((*name, digest.hexdigest()))
            name, digest = (d1, d2), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["d1", "d2", "ends_sha256"])
    if digest:
        yield pd.DataFrame([(*name, digest.hexdigest())], columns=["d1", "d2", "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of the names at which conversations end.

    A digest of one list is made in one task by its nature; ids come to it sorted, joined in pieces by the tasks before.
    """
    ends = rows.where("depth = n").select("d1", "d2", "conv_id")
    sorted_ids = ends.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    pieces = sorted_ids.mapInPandas(_joined_ids, "d1 long, d2 long, first long, ids string")
    return pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInPandas(
        _digests, "d1 long, d2 long, ends_sha256 string"
    )


def _doubled(heavy: DataFrame) -> DataFrame:
    """``heavy`` (d1, d2, u1, u2, n_leaves, saved_tokens) with both sums over whole subtrees; (u1, u2) is the parent, null for the root."""
    state = heavy
    while not state.where("u1 is not null").isEmpty():
        given = state.where("u1 is not null").groupBy("u1", "u2").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        given = given.withColumnsRenamed({"u1": "d1", "u2": "d2"})
        onward = state.select(F.col("d1").alias("u1"), F.col("d2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        state = stored(
            state.join(given, ["d1", "d2"], "left").join(onward, ["u1", "u2"], "left").select(
                "d1", "d2", F.col("v1").alias("u1"), F.col("v2").alias("u2"),
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
            ),
            "heavy-nodes",
        )
    return state.select("d1", "d2", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, sizes: DataFrame, limit: int = LIMIT, shard_nodes: int = SHARD_NODES, bits: int = 64) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, place, t1, t2, chars, n), ``sizes`` a row (conv_id, n) for every conversation, also those without turns. No
    conversation, no node.
    """
    for seed in range(SEEDS):
        rows = stored(prefixes(turns, sizes, seed, bits), "prefixes")
        nodes = stored(enumerated(rows), "nodes")
        if nodes.where(~F.col("agree")).isEmpty():
            break
    else:
        raise ValueError("names of prefixes clash with every seed")
    heavy = stored(nodes.where(F.col("below") > limit), "heavy")
    names = broadcast_if_small(heavy.select("d1", "d2"))
    # the top of a conversation's light part is its first prefix that is not heavy
    top = F.min(F.struct("depth", "d1", "d2")).alias("top")
    tops = rows.select("conv_id", "depth", "d1", "d2").join(names, ["d1", "d2"], "left_anti").groupBy("conv_id").agg(top)
    shards = max(1, -(-nodes.count() // shard_nodes))
    light = (
        nodes.join(names, ["d1", "d2"], "left_anti")
        .join(tops, "conv_id")
        .select(
            "d1", "d2", *[F.coalesce(p, F.lit(0)).alias(p) for p in ("p1", "p2")], "conv_id", "depth", "n_convs", "chars",
            F.pmod(F.xxhash64("top.d1", "top.d2"), F.lit(shards)).alias("shard"), (F.col("depth") == F.col("top.depth")).alias("is_top"),
        )
    )
    done = stored(light.groupBy("shard").applyInPandas(lambda shard: filled(shard), _FILLED), "light")
    handed = done.where("is_top and depth > 0").groupBy("p1", "p2").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    inner = heavy.where("p1 is not null").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"))
    both = handed.unionByName(inner, allowMissingColumns=True).groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    both = both.agg(F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    began = stored(
        heavy.join(both, ["d1", "d2"], "left").select(
            "d1", "d2", "p1", "p2", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(F.coalesce("n_leaves", F.lit(0))).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"),
        ),
        "heavy-own",
    )
    summed = _doubled(began.select("d1", "d2", F.col("p1").alias("u1"), F.col("p2").alias("u2"), "n_leaves", "saved_tokens"))
    whole = began.drop("n_leaves", "saved_tokens").join(summed, ["d1", "d2"])
    every = done.drop("is_top").unionByName(whole, allowMissingColumns=True)
    parents = broadcast_if_small(heavy.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("heavy_parent")))
    return (
        every.join(parents, ["p1", "p2"], "left")
        .join(end_digests(rows), ["d1", "d2"], "left")
        .select(
            "conv_id", "depth", F.coalesce("parent_conv_id", "heavy_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_TEXT)).alias("ends_sha256"),
        )
    )


def shared_beginnings(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of the conversations as :func:`rebuilt` makes them.

    Null role or text is empty. Rows without a conv_id are left out. Turns with one number are ordered by content; equal rows are turns
    each. An empty table has no nodes. Other columns are not read.
    """
    placed = stored(placed_turns(conversations), "placed-turns")
    return trie(*rebuilt(placed), limit=limit)
