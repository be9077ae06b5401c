"""Bounded already-seen filters: blocked Bloom bitmaps as a table, keyed by hash range.

A filter for ``capacity`` keys and a false-positive ``rate`` has a fixed number of blocks of ``BLOCK_BYTES``; a key belongs to one
block by its hash and sets a few bits there. So a filter never grows, two filters of one shape are merged by or-ing equal blocks,
and a task holds one block at a time. A key that was added is always found again; a key that was not is taken for a
seen one at the stated rate at most, as long as no more than ``capacity`` keys are in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32 * 1024
_BITS = BLOCK_BYTES * 8
FILTER = "block long, bits binary"


@dataclass(frozen=True)
class Shape:
    """Size of a filter. Filters of one shape can be merged and probed for each other's keys."""

    blocks: int
    hashes: int

    @classmethod
    def of(cls, capacity: int, rate: float) -> Shape:
        """For ``capacity`` keys at most. Keys spread unevenly over blocks, so the fullest block counts, not the average."""
        bits_per_key = -math.log(rate) / math.log(2) ** 2
        blocks = max(1, math.ceil(capacity * bits_per_key / _BITS))
        if blocks > 1:
            # room for a block that is six standard deviations over its share
            mean = capacity / blocks
            blocks = math.ceil(blocks * (1 + 6 / math.sqrt(mean)))
        return cls(blocks, max(1, round(-math.log2(rate))))

    @property
    def bytes(self) -> int:
        return self.blocks * BLOCK_BYTES

    def block(self, key: Column | str) -> Column:
        """The block of a key; keys are spread evenly."""
        return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(self.blocks).cast("long"))


def marks(key: Column | str) -> Column:
    """Two numbers of a key that name its bits in the block."""
    return F.struct(F.xxhash64(F.lit("first"), key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def places(a: np.ndarray, b: np.ndarray, hashes: int) -> np.ndarray:
    """Bits of each key, one row per key."""
    a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64) | np.uint64(1)
    steps = np.arange(hashes, dtype=np.uint64)
    # the cubes keep keys with one step from sharing a whole row of bits
    return ((a[:, None] + steps * b[:, None] + (steps**3 - steps) // np.uint64(6)) % np.uint64(_BITS)).astype(np.int64)


def add_to(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Set the bits of keys in the unpacked ``bits``; returns which keys were not in before."""
    new = ~bits[found].all(axis=1)
    bits[found[new]] = True
    return new


def unpacked(raw: bytes | None) -> np.ndarray:
    """The bits of a block as booleans; an absent block is empty."""
    if raw is None:
        return np.zeros(_BITS, dtype=bool)
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).view(bool)


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _keyed(df: DataFrame, key: str, shape: Shape) -> DataFrame:
    """Each distinct non-null key once, with its block and marks."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().select(key, shape.block(key).alias("block"), marks(key).alias("m"))


def build_filter(df: DataFrame, key: str, shape: Shape) -> DataFrame:
    """(block, bits) of all keys of ``df``; blocks without a key have no row."""

    def fill(numbers: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        bits = unpacked(None)
        add_to(bits, places(chunk["a"].to_numpy(), chunk["b"].to_numpy(), shape.hashes))
        return pd.DataFrame({"block": [numbers[0]], "bits": [packed(bits)]})

    rows = _keyed(df, key, shape).select("block", "m.*")
    return rows.groupBy("block").applyInPandas(fill, FILTER)


def merge_filters(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter that knows the keys of both; both must be of one shape."""

    def either(numbers: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(raw, dtype=np.uint8) for raw in chunk["bits"]])
        return pd.DataFrame({"block": [numbers[0]], "bits": [bits.tobytes()]})

    return one.unionByName(other).groupBy("block").applyInPandas(either, FILTER)


def not_in_filter(df: DataFrame, key: str, known: DataFrame, shape: Shape) -> DataFrame:
    """Distinct keys of ``df`` that the filter does not know. A key whose block has no row is new without a look."""

    def probe(numbers: tuple, keys: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        bits = unpacked(block["bits"].iloc[0] if len(block) else None)
        found = places(keys["a"].to_numpy(), keys["b"].to_numpy(), shape.hashes)
        return keys.loc[~bits[found].all(axis=1), [key]]

    keys = _keyed(df, key, shape).select(key, "block", "m.*")
    kind = df.schema[key].dataType.simpleString()
    return keys.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(probe, f"`{key}` {kind}")

