"""SimHash near-copies by anchor points of a covering code.

Fingerprint: 64 bits over the XXH64 hashes (seed 42) of all 4-word shingles of the lower-cased text.

Search. The 64 bits are cut into three blocks of 22, 21 and 21 bits. Two fingerprints at 4 or fewer differing bits
differ by at most 1 bit in one of the blocks. In a block the anchors are the words of a covering code: the Hamming code of
length 15 on the low 15 bits, the other bits free. Its covering radius is 1. A fingerprint's *home* is its nearest anchor (at most
1 bit away); it is copied to every anchor within radius + 1 = 2 bits. Any two fingerprints with
at most 1 differing bit in the block then meet at the home of either, and are compared there on all 64 bits. Each
fingerprint is copied to about 48 anchors, whatever the size of the data; there are 2**18 or 2**17 anchors per block.

Equal fingerprints are one row before the search, so exact copies cost nothing. At an anchor only a spanning
forest of the links found is put out, never the pairs. An anchor with very many fingerprints is cut into tiles of bounded
size that are compared in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import broadcast_if_small, components, fresh, stored

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
# (first bit, bits) of each block
BLOCKS = ((0, 22), (22, 21), (43, 21))
HAMMING_BITS = 15
HOME_TILE, COPY_TILE = 20_000, 400_000
ROWS_AT_ONCE = 200_000
PAIRS_AT_ONCE = 4_000_000
SHINGLES_AT_ONCE = 65_536
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a whole text; 0 without words. Works in blocks of shingles, so memory stays bounded."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1]
    ends = ends[size - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        span = slice(at, at + SHINGLES_AT_ONCE)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[span].tolist(), ends[span].tolist(), strict=True)]
        by_byte = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(by_byte[:, k], minlength=256) @ _BITS_OF_BYTE
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints_of(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Syndrome of the low 15 bits under the Hamming code: xor of the numbers (1 to 15) of the set bits."""
    out = np.zeros_like(words)
    for bit in range(HAMMING_BITS):
        out ^= ((words >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def _flips(bits: int) -> list[np.ndarray]:
    """For each syndrome: the masks of 2 or fewer bits that lead a word of that syndrome to an anchor."""
    masks = [0] + [1 << i for i in range(bits)] + [1 << i | 1 << j for i in range(bits) for j in range(i)]
    masks = np.array(masks, dtype=np.uint64)
    found = _syndrome(masks)
    return [masks[found == s] for s in range(HAMMING_BITS + 1)]


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flips = [_flips(bits) for _, bits in BLOCKS]
    for rows in batches:
        prints = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        reps = rows["rep"].to_numpy(dtype=np.int64)
        for k, (first, bits) in enumerate(BLOCKS):
            words = (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
            of = _syndrome(words)
            for s in range(HAMMING_BITS + 1):
                here = np.flatnonzero(of == s)
                if not len(here):
                    continue
                masks = flips[k][s]
                home = np.uint64(1 << (s - 1)) if s else np.uint64(0)
                yield pd.DataFrame(
                    {
                        "anchor": ((words[here][:, None] ^ masks) | np.uint64(k << 32)).ravel().astype(np.int64),
                        "home": np.tile(masks == home, len(here)),
                        "fp": np.repeat(prints[here].view(np.int64), len(masks)),
                        "rep": np.repeat(reps[here], len(masks)),
                    }
                )


class Forest:
    """Union-find over 0..n-1 on whole arrays; keeps the least index as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        at = self.up[of]
        while True:
            above = self.up[at]
            if np.array_equal(above, at):
                return at
            at = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            if not apart.any():
                return
            a, b = np.unique(np.stack([low[apart], high[apart]]), axis=1)
            np.minimum.at(self.up, b, a)


def _links_of_rows(group: np.ndarray, home: np.ndarray, prints: np.ndarray, reps: np.ndarray) -> pd.DataFrame:
    """A spanning forest of the links between homes and copies of each group; rows are sorted by group, homes first."""
    nodes, node = np.unique(reps, return_inverse=True)
    forest = Forest(len(nodes))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    which = np.repeat(np.arange(len(starts)), sizes)
    homes = np.flatnonzero(home & (sizes[which] > 1))
    partners = sizes[which[homes]]
    at = 0
    reach = np.cumsum(partners)
    while at < len(homes):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        count = partners[at:stop]
        left = np.repeat(homes[at:stop], count)
        within = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        right = starts[which[left]] + within
        near = np.bitwise_count(prints[left] ^ prints[right]) <= MAX_BITS
        forest.link(node[left[near]], node[right[near]])
        at = stop
    roots = forest.roots(np.arange(len(nodes)))
    moved = roots != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[roots[moved]], "b": nodes[moved]})


def _links_at_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by anchor and tile, homes first; whole groups are compared together."""
    held: list[pd.DataFrame] = []
    rows = 0

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        group = frame["anchor"].to_numpy() * 1_000_003 + frame["tile"].to_numpy()
        return _links_of_rows(
            group, frame["home"].to_numpy(dtype=bool), frame["fp"].to_numpy(dtype=np.int64).view(np.uint64), frame["rep"].to_numpy()
        )

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < ROWS_AT_ONCE:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame["anchor"] == frame["anchor"].iloc[-1]) & (frame["tile"] == frame["tile"].iloc[-1])
        whole = frame[~last]
        if len(whole):
            yield compare(whole)
        held, rows = [frame[last]], int(last.sum())
    if rows:
        yield compare(pd.concat(held, ignore_index=True))


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """(a, b): links between representatives that connect all fingerprints at ``MAX_BITS`` or fewer differing bits.

    ``prints`` has one row (fp, rep) per distinct fingerprint.
    """
    schema = "anchor long, home boolean, fp long, rep long"
    rows = prints.select("fp", "rep").mapInPandas(_anchor_rows, schema)
    counts = rows.groupBy("anchor").agg(
        F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("copies")
    )
    large = counts.where((F.col("homes") > HOME_TILE) | (F.col("copies") > COPY_TILE)).select(
        "anchor",
        F.ceil(F.col("homes") / HOME_TILE).cast("int").alias("across"),
        F.ceil(F.col("copies") / COPY_TILE).cast("int").alias("down"),
    )
    across, down = F.coalesce("across", F.lit(1)), F.coalesce("down", F.lit(1))
    salt = F.xxhash64("fp")
    # tile number = home part * down + copy part; a home goes to its row of tiles, a copy to its column
    as_home = F.transform(F.sequence(F.lit(0), down - 1), lambda j: F.pmod(salt, across).cast("int") * down + j)
    as_copy = F.transform(F.sequence(F.lit(0), across - 1), lambda i: i * down + F.pmod(salt, down).cast("int"))
    tiled = rows.join(stored(large, "large-anchors"), "anchor", "left")
    dealt = tiled.select(
        "anchor", "fp", "rep", F.explode(
            F.when(F.col("home"), F.array_union(as_home, as_copy)).otherwise(as_copy)
        ).alias("tile"),
        (F.col("home")).alias("home"),
    )
    return (
        dealt.repartition("anchor", "tile")
        .sortWithinPartitions("anchor", "tile", F.desc("home"))
        .select("anchor", "tile", "home", "fp", "rep")
        .mapInPandas(_links_at_anchors, "a long, b long")
    )


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per input row.

    Fingerprints link at ``MAX_BITS`` or fewer differing bits; ``component_id`` is the smallest doc_id reachable. A null
    or blank text has fingerprint 0 and links like any other. Rows of one doc_id are rows of their
    own with one id; a row with a null doc_id gets the component of its fingerprint, or null if no row with an id
    has it or links to it. Only the two named columns are read. An empty table gives an empty result.
    """
    prints = stored(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprints_of(F.col(text)).alias("fp")), "fingerprints"
    )
    distinct = stored(
        prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints"
    )
    found = components(linked_fingerprints(distinct), "a", "b")
    component = distinct.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(component, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose doc_id is the smallest of its component, all columns kept.

    Rows without a doc_id stay; rows that share a doc_id are one document and stay or go together.
    """
    dropped_id = fresh("dropped_id", docs)
    ids = near_copies(docs, doc_id, text).groupBy("doc_id").agg(F.min("component_id").alias("least"))
    dropped = stored(ids.where("doc_id <> least").select(F.col("doc_id").alias(dropped_id)), "copies")
    return docs.join(broadcast_if_small(dropped), docs[doc_id] == F.col(dropped_id), "left_anti")
