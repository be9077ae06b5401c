"""Benchmark items inside documents: size-partitioned MinHash containment search, exact check of what it finds.

An item and a document are sets of shingles: five consecutive words, lower-cased, of letters and digits. An item is
contained if at least ``CONTAINMENT`` of its distinct shingles are in the document.

The MinHash of an item is the shingle with the least value under each of ``ROWS`` hash functions. A document of any length
contains the least shingle of an item with a probability equal to the containment, so the document's own minima are not
needed: its shingles are joined with the items' least shingles. Items are partitioned by their number of
shingles; each partition has rows per band chosen for a recall of over 0.999 at the threshold. A document
that holds all rows of a band is a candidate, and candidates are checked on all shingles, as text.

DataFrame functions only. Rows are one per shingle of a document only inside a stage: the join with the items follows at once
and keeps matches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, fresh, stored

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
ROWS = 32
# (largest number of distinct shingles, rows per band); recall at 0.8: 1 - (1 - 0.8**rows)**(32 // rows)
PARTITIONS = ((8, 1), (64, 2), (None, 3))
WORDS = r"[\p{L}\p{N}]+"


def shingle_texts(text: Column) -> Column:
    """All shingles of a text in order; a text of fewer words is one shingle, a text without words has none."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
    return F.transform(F.array(words), _runs)[0]


def _runs(words: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE_WORDS - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE_WORDS)), " "))
    return F.when(F.size(words) > 0, runs)


def _bands_hit(rows: Column, per_band: int) -> Column:
    """Whether the bit set ``rows`` holds every row of at least one band."""
    whole = (1 << per_band) - 1
    hit = F.lit(False)
    for first in range(0, ROWS - per_band + 1, per_band):
        mask = whole << first
        hit = hit | (rows.bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
    return hit


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): the items that each document contains.

    A null or blank text contains nothing and, as an item, is contained nowhere. An item of fewer than five words is found
    only where it is the whole document. Rows without an id are not looked at; rows with one id count as one text
    with the shingles of all of them. Other columns are not read. Empty tables give an empty result.
    """
    wanted = stored(
        items.where(F.col(item_id).isNotNull())
        .select(F.col(item_id).alias("item_id"), F.explode(shingle_texts(F.col(item_text))).alias("shingle"))
        .distinct()
        .withColumn("h", F.xxhash64("shingle")),
        "items",
    )
    minima = [F.min_by("h", F.xxhash64("h", F.lit(i))).alias(f"m{i}") for i in range(ROWS)]
    sketches = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"), *minima)
    rows = F.array(*[F.struct(F.col(f"m{i}").alias("h"), F.lit(1 << i).cast("long").alias("bit")) for i in range(ROWS)])
    least = stored(
        sketches.select("item_id", "n_shingles", F.explode(rows).alias("r"))
        .groupBy("item_id", "n_shingles", "r.h")
        .agg(F.bit_or("r.bit").alias("bits")),
        "least-shingles",
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    parts = F.lit(False)
    low = 0
    for high, per_band in PARTITIONS:
        of_size = F.col("n_shingles") > low if high is None else F.col("n_shingles").between(low + 1, high)
        parts = parts | (of_size & _bands_hit(F.col("bits"), per_band))
        low = high
    candidates = stored(
        texts.select("doc_id", F.explode(shingle_texts(F.col("text"))).alias("shingle"))
        .select("doc_id", F.xxhash64("shingle").alias("h"))
        .join(broadcast_if_small(least), "h")
        .groupBy("doc_id", "item_id", "n_shingles")
        .agg(F.bit_or("bits").alias("bits"))
        .where(parts)
        .select("doc_id", "item_id", "n_shingles"),
        "candidates",
    )
    suspects = stored(candidates.select("doc_id").distinct(), "suspects")
    held = (
        texts.join(broadcast_if_small(suspects), "doc_id", "left_semi")
        .select("doc_id", F.explode(shingle_texts(F.col("text"))).alias("shingle"))
        .join(broadcast_if_small(wanted.select("item_id", "shingle")), "shingle")
        .groupBy("doc_id", "item_id")
        .agg(F.count_distinct("shingle").alias("n_shared"))
    )
    return (
        held.join(candidates, ["doc_id", "item_id"])
        .where(F.col("n_shared") >= CONTAINMENT * F.col("n_shingles"))
        .select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    )


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that contain no item; all columns and rows without a doc_id stay."""
    leak_id = fresh("leak_id", docs)
    leaks = stored(contained_items(docs, items, doc_id, text).select(F.col("doc_id").alias(leak_id)).distinct(), "leaks")
    return docs.join(broadcast_if_small(leaks), docs[doc_id] == F.col(leak_id), "left_anti")
