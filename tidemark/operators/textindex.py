"""Term index and near-copy fingerprints of document text."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import let
from tidemark.session import use_checkpoints

WORD = r"[\p{L}\p{N}]+"
SHINGLE_WORDS = 3
# Fixed values of the fingerprint: 8 bands of 2 hashes; hash i of a shingle is (A[i] * x + B[i]) mod PRIME,
# where x is the number in the first 8 hex digits of its md5. A and B follow from i by md5 as well.
BANDS = 8
ROWS_PER_BAND = 2
PRIME = 4_294_967_311
# Rows of a tile, on average, where the signatures of one band are compared with each other.
TILE_ROWS = 512


def hash_factors(i: int) -> tuple[int, int]:
    return tuple(int(hashlib.md5(f"{name}{i}".encode()).hexdigest()[:7], 16) | 1 for name in "ab")


def words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def term_index(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, doc, n): how often each term occurs in each document."""
    return (
        df.select(doc_id, F.explode(words(text)).alias("term")).groupBy("term", doc_id).agg(F.count(F.lit(1)).alias("n"))
    )


def documents_with_all(df: DataFrame, doc_id: str, text: str, terms: list[str]) -> DataFrame:
    """Documents that contain every term, with the total number of hits."""
    wanted = sorted(set(terms))
    hits = df.select(doc_id, F.explode(words(text)).alias("term")).where(F.col("term").isin(*wanted))
    counts = [F.count(F.when(F.col("term") == t, 1)).alias(f"_n{i}") for i, t in enumerate(wanted)]
    everyone = F.lit(True)
    for i in range(len(wanted)):
        everyone = everyone & (F.col(f"_n{i}") > 0)
    return hits.groupBy(doc_id).agg(*counts, F.count(F.lit(1)).alias("hits")).where(everyone).select(doc_id, "hits")


def shingles(text: Column | str, size: int = SHINGLE_WORDS) -> Column:
    """Runs of ``size`` words, repeats kept; a shorter text is one shingle."""

    def runs(found: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(1), F.size(found) - (size - 1)),
            lambda i: F.concat_ws(" ", *[F.element_at(found, i + k) for k in range(size)]),
        )
        return F.when(F.size(found) > size, several).otherwise(F.array(F.array_join(found, " ")))

    return let(words(text), runs)


def fingerprints(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, band, value): MinHash over word shingles, banded. A text without words has no fingerprint.

    A repeated shingle does not change a minimum, so repeats are not looked for.
    The minimum of every hash is an aggregate over exploded shingles: minima of whole numbers combine in
    each task's hash table before the shuffle, and nothing larger than one text is ever in memory.
    """
    shingled = df.select(doc_id, F.explode(shingles(text)).alias("_s")).where(F.col("_s") != "")
    numbered = shingled.select(
        doc_id, F.conv(F.substring(F.md5(F.col("_s").cast("binary")), 1, 8), 16, 10).cast("bigint").alias("_x")
    )
    minima = []
    for i in range(BANDS * ROWS_PER_BAND):
        a, b = hash_factors(i)
        minima.append(F.min((F.col("_x") * a + b) % PRIME).alias(f"_h{i}"))
    bands = F.array(
        *[
            F.struct(
                F.lit(b).alias("band"),
                F.concat_ws("-", *[F.col(f"_h{b * ROWS_PER_BAND + r}") for r in range(ROWS_PER_BAND)]).alias("value"),
            )
            for b in range(BANDS)
        ]
    )
    signed = numbered.groupBy(doc_id).agg(*minima)
    return signed.select(doc_id, F.explode(bands).alias("_b")).select(doc_id, "_b.band", "_b.value")


def linked_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group): every linked node with the least node it can reach.

    Each round a node hears the least label of its neighbours and follows the label of that label; rounds are checkpointed. Nodes without a
    link take no part.
    """
    edges = links.select(F.col(a).alias("_from"), F.col(b).alias("_to")).where("_from <> _to")
    edges = edges.union(edges.select("_to", "_from")).distinct().checkpoint()
    label = edges.groupBy("_from").agg(F.min("_to").alias("_m")).select(F.col("_from").alias("node"), F.least("_from", "_m").alias("group"))
    label = label.checkpoint()
    while True:
        heard = edges.join(label.withColumnRenamed("node", "_to"), "_to").groupBy("_from").agg(F.min("group").alias("_heard"))
        lowered = label.join(heard, F.col("node") == F.col("_from")).select(
            "node", F.col("group").alias("_old"), F.least("group", "_heard").alias("group")
        )
        # a group that one of its members has left follows it
        hooks = lowered.groupBy(F.col("_old").alias("_at")).agg(F.min("group").alias("_next"))
        onward = F.least("group", F.coalesce("_next", "group")).alias("group")
        after = lowered.join(hooks, F.col("group") == F.col("_at"), "left").select("node", "_old", onward).checkpoint()
        if after.where("group <> _old").isEmpty():
            return after.select("node", "group")
        label = after.select("node", "group")


def _differing(one: Column, other: Column) -> Column:
    """Places in which two signatures differ: a distance, so it obeys the triangle inequality."""
    return reduce(Column.__add__, [(one[i] != other[i]).cast("int") for i in range(BANDS * ROWS_PER_BAND)])


def similar_signatures(signatures: DataFrame, doc_id: str, minima: str, most_differing: int) -> DataFrame:
    """(a, b): links that connect all signatures that share a band and differ in ``most_differing`` places at most.

    ``signatures`` has one row per distinct signature. The signatures of a band are compared with the band's least one; those linked to it are
    connected through it. Of the others, the open ones, every pair is met, and pairs of an open one and a linked one unless
    the triangle inequality rules them out. The rows of a band are dealt into tiles, so a task joins two tiles and never a band; pairs that
    are not links leave no row.
    """
    keys = F.array(
        *[F.xxhash64(F.lit(b), *[F.col("_m")[b * ROWS_PER_BAND + r] for r in range(ROWS_PER_BAND)]) for b in range(BANDS)]
    )
    members = signatures.select(F.col(doc_id).alias("_doc"), F.col(minima).alias("_m")).withColumn("_key", F.explode(keys))
    shared = members.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_doc", "_m")).alias("_c")).where("_n > 1")
    met = (
        members.join(shared.select("_key", "_c"), "_key")
        .select("_key", "_doc", "_m", F.col("_c._doc").alias("_centre"), _differing(F.col("_m"), F.col("_c._m")).alias("_d"))
        .checkpoint()
    )
    spokes = met.where((F.col("_d") <= most_differing) & (F.col("_doc") != F.col("_centre"))).select(F.col("_centre").alias("a"), F.col("_doc").alias("b"))
    nearest = met.where(F.col("_d") > most_differing).groupBy("_key").agg(F.min("_d").alias("_open"))
    rest = met.join(nearest, "_key").where(F.col("_d") >= F.col("_open") - most_differing)
    rest = rest.select("_key", "_doc", "_m", (F.col("_d") > most_differing).alias("_is_open")).checkpoint()
    sizes = rest.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("_tiles")).where("_tiles > 0")
    dealt = rest.join(sizes, "_key").withColumn("_tile", F.pmod(F.xxhash64("_doc", "_key"), F.col("_tiles")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    left = dealt.where("_is_open").select("_key", F.col("_doc").alias("a"), F.col("_m").alias("_ma"), F.col("_tile").alias("_ta"), others.alias("_tb"))
    right = dealt.select("_key", F.col("_doc").alias("b"), F.col("_m").alias("_mb"), F.col("_tile").alias("_tb"), others.alias("_ta"), F.col("_is_open").alias("_both"))
    once = (F.col("a") < F.col("b")) | (~F.col("_both") & (F.col("a") != F.col("b")))
    pairs = left.join(right, ["_key", "_ta", "_tb"]).where(once & (_differing(F.col("_ma"), F.col("_mb")) <= most_differing))
    return spokes.union(pairs.select("a", "b")).distinct()


def near_copy_groups(prints: DataFrame, doc_id: str, similarity: float = 0.5) -> DataFrame:
    """(doc, group): documents that are near-copies, directly or through others, have one group, its least id.

    Two documents are linked if they share a band and ``similarity`` of all their minima are equal. Documents with equal
    signatures are one row throughout; of the rest, :func:`similar_signatures` finds links that connect every linked pair, whatever
    the size of a band.
    """
    use_checkpoints(prints.sparkSession)
    in_order = F.sort_array(F.collect_list(F.struct("band", "value")))
    minima = F.flatten(F.transform(in_order, lambda b: F.transform(F.split(b["value"], "-"), lambda m: m.cast("bigint"))))
    signed = prints.groupBy(F.col(doc_id).alias("_doc")).agg(minima.alias("_minima")).checkpoint()
    distinct = signed.groupBy("_minima").agg(F.min("_doc").alias("_first")).checkpoint()
    places = BANDS * ROWS_PER_BAND
    links = similar_signatures(distinct, "_first", "_minima", places - math.ceil(similarity * places))
    grouped = linked_groups(links, "a", "b")
    named = distinct.join(grouped, F.col("_first") == F.col("node"), "left").select("_minima", F.coalesce("group", "_first").alias("group"))
    return signed.join(named, "_minima").select(F.col("_doc").alias(doc_id), "group")
