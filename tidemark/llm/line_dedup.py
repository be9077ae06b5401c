"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard check, distributed union-find.

Lines are compared lower-cased and trimmed; a line of blanks is never compared nor removed. Equal lines are one row
from the first step on. Two lines are linked if the Jaccard similarity of their sets of 5-character shingles is 0.8
or more (a shorter line is one shingle).

Signature: the least value, under each of 44 hash orders, among all of the line's 5-character shingles, the same ones that the
exact check compares. Each order is the shingle's 32-bit hash times a fixed odd number. The 44 rows make 11 bands of 4: of lines
that are 0.8 similar some band agrees with probability 0.997. Two bits of each of the first 32 rows make a sketch; two lines of a band whose
sketches agree in fewer than 20 places (a similarity of about 0.5) are not compared further, which costs under 0.1 % of
the pairs that are 0.8 similar.

Rows of all bands are shuffled once, and a window finds each band's least line. Bands that hold over about a thousandth of all lines
are found in a sample of lines; their rows skip the window: their least line is a minimum that every task prepares, and no task holds such a band.

The lines of a band are compared with the band's least line first. Where all are copies of it, that is all. The rest are
compared among themselves, and with the copies only if, by the triangle inequality of the Jaccard distance, a
link to a copy is possible at all; a line whose score was not computed excludes nothing. Lines that links of any band have joined need no
further link among themselves, and a line whose sketch is alike to none of another group in its band goes. So the rest meet the band's middle line, the one nearest to what most sketches of the band hold, and
then all pairs that are in different groups still are met, whatever the
size of the band: its rows are dealt into tiles, and a task joins two tiles, never a whole band. A pair whose sketches are
not alike leaves no row, nor does a pair that the parities of its shingles exclude: each distinct shingle flips one of 1,024 bits, so
the bits in which two lines differ are at most the shingles that only one of them has. This is a bound, no estimate: it excludes no link.

Signing and scoring, a line or a pair at a time, are numpy in Arrow batches: Spark has no function that hashes all shingles of
a line cheaply, and the form without Python took several times the processor time and disk. Bands, links,
components and decisions are DataFrame functions; texts are shuffled for candidates alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, components, fresh, stored

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BAND_ROWS = 44, 4
SEED = 7
# Characters that a worker hashes at a time (a longer line alone), and line hashes that it remembers so as to sign a repeated line once.
HASHED_CHARS, REMEMBERED = 250_000, 500_000
# Rows of a tile, on average: bands that hold more after their copies are linked are dealt into several tiles.
PAIRED_ROWS = 512
SKETCH_ROWS, SKETCH_BITS, SKETCH_AGREES = 32, 2, 20
# 64-bit words of the parities of a line's shingles, and the rows of a band from which on parities are compared; the pairs of a smaller band are few.
PARITY_WORDS, PARITY_BAND = 16, 64
# Lines of the sample that finds large bands, and the sampled lines that make a band large. The sample routes rows, it drops none.
SAMPLE_LINES, LARGE_BAND = 50_000, 50


def compared(line: Column) -> Column:
    return F.lower(F.trim(line))


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): one row per ``\\n``-separated line, numbered from 0, of rows that have an id and a text."""
    return docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")
    )


def _portions(lengths: list[int]) -> Iterator[slice]:
    """Runs of consecutive lines that hold ``HASHED_CHARS`` characters at most, or one line."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > HASHED_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if lengths:
        yield slice(start, len(lengths))


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all lines, and where those of each line begin and end."""
    codes = np.frombuffer("".join(x.ljust(SHINGLE, "\0") for x in lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((max(SHINGLE, len(x)) for x in lines), np.int64, len(lines))
    stops = np.cumsum(lengths)
    for i, x in enumerate(lines):
        if len(x) < SHINGLE:
            codes[stops[i] - SHINGLE + len(x) : stops[i]] = 0x110000  # no character: padding equals no text
    turn, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    n = len(codes) - SHINGLE + 1
    hashes = codes[:n].copy()
    for k in range(1, SHINGLE):
        hashes = hashes * turn + codes[k : n + k]
    for _ in range(2):
        hashes = (hashes ^ (hashes >> np.uint64(32))) * mix
    return hashes ^ (hashes >> np.uint64(32)), stops - lengths, stops - SHINGLE + 1


def _orders() -> list[np.uint32]:
    """Odd numbers that 32-bit hashes are multiplied by."""
    draw = random.Random(SEED)
    return [np.uint32(draw.getrandbits(32) | 1) for _ in range(ROWS)]


def _minima(lines: list[str]) -> np.ndarray:
    """A row of ``ROWS`` least values for each line."""
    hashes, begin, end = _hashed(lines)
    short = hashes.astype(np.uint32)
    # positions between two lines belong to shingles that span both; reduceat gives them segments of their own, which go
    cuts = np.stack([begin, end], 1).reshape(-1)[:-1]
    return np.stack([np.minimum.reduceat(short * order, cuts)[::2] for order in _orders()], 1).view(np.int32)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[int] = set()
    for batch in batches:
        batch = batch.drop_duplicates("h")
        batch = batch[np.fromiter((h not in seen for h in batch["h"].tolist()), bool, len(batch))]
        if len(seen) > REMEMBERED:
            seen.clear()
        seen.update(batch["h"].tolist())
        lines = batch["line"].tolist()
        for part in _portions([len(x) for x in lines]):
            minima = pd.DataFrame(_minima(lines[part]), columns=[f"m{i}" for i in range(ROWS)])
            minima.insert(0, "h", batch["h"].to_numpy()[part])
            yield minima


def _signatures(lines: DataFrame) -> DataFrame:
    """(h, m0, m1, ...): signatures of all lines; a line that several tasks hold is there several times."""
    return lines.select("h", "line").mapInPandas(_signed, "h long, " + ", ".join(f"m{i} int" for i in range(ROWS)))


def _band_keys() -> Column:
    """Keys of all bands of a signature."""
    return F.array(
        *[F.xxhash64(F.lit(at), *[f"m{i}" for i in range(at, at + BAND_ROWS)]) for at in range(0, ROWS, BAND_ROWS)]
    )


def _sketch() -> Column:
    """The low bits of the first rows of a signature, packed into a long number."""
    places = [
        F.shiftleft(F.col(f"m{i}").bitwiseAND((1 << SKETCH_BITS) - 1).cast("long"), SKETCH_BITS * i) for i in range(SKETCH_ROWS)
    ]
    return reduce(Column.bitwiseOR, places).alias("sketch")


def _alike(a: str, b: str) -> Column:
    """Whether enough places of two sketches are equal."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    folded = reduce(Column.bitwiseOR, [F.shiftrightunsigned(differ, i) for i in range(1, SKETCH_BITS)], differ)
    lowest = F.lit(sum(1 << (SKETCH_BITS * i) for i in range(SKETCH_ROWS))).cast("long")
    return F.bit_count(folded.bitwiseAND(lowest)) <= SKETCH_ROWS - SKETCH_AGREES


def _jaccard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pairs = list(zip(batch["line_a"], batch["line_b"]))
        scores = []
        for part in _portions([len(a) + len(b) for a, b in pairs]):
            number: dict[str, int] = {}
            for pair in pairs[part]:
                for line in pair:
                    number.setdefault(line, len(number))
            hashes, begin, end = _hashed(list(number))
            sets = [np.unique(hashes[i:j]) for i, j in zip(begin, end)]
            for a, b in pairs[part]:
                one, other = sets[number[a]], sets[number[b]]
                either = np.sort(np.concatenate([one, other]))
                both = int(np.count_nonzero(either[1:] == either[:-1]))
                scores.append(both / (len(either) - both))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "score": np.array(scores, float)})


def _joining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of a task's pairs that join lines not joined before in that task; pairs of lines already joined are not scored."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for batch in batches:
        for part in _portions([len(a) + len(b) for a, b in zip(batch["line_a"], batch["line_b"])]):
            rows = batch.iloc[part]
            rows = rows[np.fromiter((root(a) != root(b) for a, b in zip(rows["a"].tolist(), rows["b"].tolist())), bool, len(rows))]
            (scores,) = _jaccard(iter([rows]))
            scores = scores[scores["score"].to_numpy() >= SIMILARITY]
            joins = np.zeros(len(scores), bool)
            for i, (a, b) in enumerate(zip(scores["a"].tolist(), scores["b"].tolist())):
                one, other = root(a), root(b)
                joins[i] = one != other
                above[other] = one
            yield scores.loc[joins, ["a", "b"]]
        if len(above) > REMEMBERED:
            above.clear()  # links may come again


def _texts(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(h, line): the lines whose hashes ``wanted`` (h) has, each once; stored."""
    wanted = broadcast_if_small(stored(wanted.distinct(), "candidates"))
    return stored(lines.join(wanted, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line")), "candidate-texts")


def _sides(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct ``pairs`` (a, b) with the two lines."""
    sides = pairs.select("a", "b").distinct()
    for end in ("a", "b"):
        sides = sides.join(texts.select(F.col("h").alias(end), F.col("line").alias(f"line_{end}")), end)
    return sides.select("a", "b", "line_a", "line_b")


def _scored(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``score``, the exact Jaccard similarity of the two lines by 64-bit hashes of all shingles; stored."""
    return stored(_sides(pairs, texts).mapInPandas(_jaccard, "a long, b long, score double"), "scores")


def _flipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lines = batch["line"].tolist()
        for part in _portions([len(x) for x in lines]):
            hashes, begin, end = _hashed(lines[part])
            flips = np.zeros((len(begin), 64 * PARITY_WORDS), np.uint8)
            n = np.zeros(len(begin), np.int64)
            for i, (start, stop) in enumerate(zip(begin, end)):
                own = np.unique(hashes[start:stop])
                n[i] = len(own)
                flips[i] = np.bincount((own % np.uint64(flips.shape[1])).astype(np.int64), minlength=flips.shape[1]) & 1
            words = pd.DataFrame(np.packbits(flips, 1).view(np.int64), columns=[f"p{i}" for i in range(PARITY_WORDS)])
            words.insert(0, "h", batch["h"].to_numpy()[part])
            words.insert(1, "n", n)
            yield words


def _parities(texts: DataFrame) -> DataFrame:
    """(h, n, p0, p1, ...): how many distinct shingles a line has, and the bits that an odd number of them hash to."""
    return texts.select("h", "line").mapInPandas(_flipped, "h long, n long, " + ", ".join(f"p{i} long" for i in range(PARITY_WORDS)))


def _may_link(a: str, b: str) -> Column:
    """Whether two lines, structs of ``_parities``, may be similar enough: then the shingles of one line alone are (1 - s) / (1 + s) of both lines' at most."""
    differ = [F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(PARITY_WORDS)]
    return reduce(Column.__add__, differ) * (1 + SIMILARITY) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (1 - SIMILARITY) + 1e-6


def _band_rows(lines: DataFrame) -> DataFrame:
    """(key, h, sketch): each line once or more in every band of its signature."""
    signed = _signatures(lines).select("h", _band_keys().alias("keys"), _sketch())
    return signed.select(F.explode("keys").alias("key"), "h", "sketch")


def _spokes(lines: DataFrame, n_lines: int) -> DataFrame:
    """(key, a, b, sketch, sketch_a): every line b of a band but the band's least line a, with a; stored."""
    part = F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(max(n_lines, 1)))
    sampled = _band_rows(lines.where(part < SAMPLE_LINES)).distinct()
    large = stored(sampled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {LARGE_BAND}").select("key"), "large-bands")
    columns = ["key", F.col("c.h").alias("a"), F.col("h").alias("b"), "sketch", F.col("c.sketch").alias("sketch_a")]
    large = F.broadcast(large)  # at most SAMPLE_LINES * bands / LARGE_BAND rows, give or take the sample's chance
    rows = _band_rows(lines)
    least = F.first(F.struct("h", "sketch")).over(Window.partitionBy("key").orderBy("h"))
    spokes = [
        rows.join(large, "key", "left_anti").withColumn("c", least).where("h <> c.h").select(*columns).dropDuplicates(["key", "b"])
    ]
    if not large.isEmpty():
        held = stored(rows.join(large, "key"), "large-band-rows")
        centre = held.groupBy("key").agg(F.min(F.struct("h", "sketch")).alias("c"))
        spokes.append(held.join(F.broadcast(centre), "key").where("h <> c.h").select(*columns).distinct())
    return stored(reduce(DataFrame.unionByName, spokes), "spokes")


def _middle_spokes(met: DataFrame) -> DataFrame:
    """(a, b): the rows of a band that are alike to its middle row and in another group, with it.

    The middle row agrees best with the bits that most of the band's sketches have: variants of one line are nearest to the least changed one.
    """
    bits = [F.col("sketch").bitwiseAND(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(SKETCH_ROWS * SKETCH_BITS)]
    most = [F.when(2 * F.count_if(bit != 0) > F.count(F.lit(1)), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(0) for i, bit in enumerate(bits)]
    common = met.groupBy("key").agg(reduce(Column.bitwiseOR, most).alias("common"))
    rows = met.join(common, "key")
    off = F.bit_count(F.col("sketch").bitwiseXOR(F.col("common")))
    middle = rows.groupBy("key").agg(F.min(F.struct(off.alias("off"), "h", "sketch", "group")).alias("c"))
    spokes = met.join(middle, "key").where("group <> c.group").select(F.col("c.h").alias("a"), F.col("h").alias("b"), F.col("c.sketch").alias("sketch_a"), "sketch")
    return spokes.where(_alike("sketch", "sketch_a")).select("a", "b")


def _tiles(met: DataFrame, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of bands, dealt into tiles, as the two sides of a join by ``key``, ``tile_a`` and ``tile_b``; columns of the left side end in ``_a``."""
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    tiles = F.ceil(F.col("rows") / PAIRED_ROWS).cast("int")
    dealt = met.join(sizes, "key").withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("key", "h"), tiles).cast("int")})
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    left = dealt.select("key", *[F.col(c).alias(f"{c}_a") for c in own], F.col("tile").alias("tile_a"), F.explode(every).alias("tile_b"))
    right = dealt.select("key", *own, F.col("tile").alias("tile_b"), F.explode(every).alias("tile_a"))
    return left, right


def _mates(met: DataFrame) -> DataFrame:
    """The rows of ``met`` that have an alike row of another group in their band, one of the two open; stored."""
    left, right = _tiles(met, ["h", "sketch", "open", "group"])
    mate = (F.col("group_a") != F.col("group")) & (F.col("open_a") | F.col("open")) & _alike("sketch", "sketch_a")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "tile_a", "tile_b")]
    found = left.alias("l").join(right.alias("r"), [*same, mate], "left_semi")
    return stored(found.select("key", F.col("h_a").alias("h"), F.col("sketch_a").alias("sketch"), F.col("open_a").alias("open"), F.col("group_a").alias("group")).distinct(), "mates")


def _tiled(met: DataFrame, parities: DataFrame | None = None) -> DataFrame:
    """(a, b): all alike pairs of a band's rows in different groups, one of them open; a task joins two tiles of a band.

    With ``parities``, pairs that these exclude are left out.
    """
    own = ["h", "sketch", "open", "group"]
    if parities is not None:
        met = met.join(parities.select("h", F.struct(*parities.drop("h").columns).alias("parity")), "h")
        own.append("parity")
    left, right = _tiles(met, own)
    pairs = left.where("open_a").join(right, ["key", "tile_a", "tile_b"]).where("group_a <> group and (h_a < h or (h_a > h and not open))")
    pairs = pairs.where(_alike("sketch", "sketch_a"))
    if parities is not None:
        pairs = pairs.where(_may_link("parity", "parity_a"))
    return pairs.select(F.col("h_a").alias("a"), F.col("h").alias("b"))


def _met_pairs(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs of ``_tiled`` that may be links; those of large bands are told by parities."""
    large = stored(met.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(f"rows > {PARITY_BAND}").select("key"), "paired-bands")
    many = stored(met.join(large, "key"), "paired-rows")
    parities = stored(_parities(texts.join(many.select("h").distinct(), "h")), "parities")
    return _tiled(met.join(large, "key", "left_anti")).unionByName(_tiled(many, parities))


def _forest(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links among ``pairs`` that connect what all of them connect, a forest per task; stored."""
    return stored(_sides(pairs, texts).mapInPandas(_joining, "a long, b long"), "joined")


def _regrouped(met: DataFrame, links: DataFrame) -> DataFrame:
    """``met`` with ``group`` after ``links`` have joined groups, without bands of which no open row may still find another group; stored."""
    of = met.select("h", "group").distinct()
    ends = links
    for end in ("a", "b"):
        ends = ends.join(of.select(F.col("h").alias(end), F.col("group").alias(f"group_{end}")), end)
    now = components(ends, "group_a", "group_b")
    met = met.join(now, F.col("group") == F.col("node"), "left").withColumn("group", F.coalesce("component", "group"))
    return _unsettled(met.drop("node", "component"))


def _unsettled(met: DataFrame) -> DataFrame:
    """Bands with rows of several groups, one of them open; stored."""
    bands = met.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.bool_or("open").alias("any"))
    return stored(met.join(bands.where("any and least <> most").select("key"), "key"), "met")


def linked_lines(lines: DataFrame, n_lines: int) -> DataFrame:
    """(a, b): pairs that connect all lines that links connect, and no others. ``lines`` has (h, line), ``n_lines`` rows, one or more per distinct line."""
    spokes = _spokes(lines, n_lines)
    near = spokes.where(_alike("sketch", "sketch_a"))
    alike = stored(near.select("a", "b").distinct(), "pairs")
    scores = _scored(alike, _texts(alike.select(F.explode(F.array("a", "b")).alias("h")), lines))
    linked = F.col("score") >= SIMILARITY
    to_centre = scores.where(linked).select("a", "b")
    columns = ["key", F.col("b").alias("h"), "sketch"]
    unscored = spokes.where(~_alike("sketch", "sketch_a")).select(*columns, F.lit(True).alias("open"), F.lit(None).cast("double").alias("score"))
    met = near.join(scores, ["a", "b"]).select(*columns, (~linked).alias("open"), "score").unionByName(unscored)
    # Open lines are not linked to the centre. A line that is linked matters only to open lines it can still reach: by the
    # triangle inequality their scores with the centre differ by 0.2 at most. A score that was not computed may be any.
    still = met.where("open").groupBy("key").agg(F.max(F.coalesce("score", F.lit(1.0))).alias("best"))
    met = met.join(still, "key").where(F.col("open") | (F.col("score") <= F.col("best") + (1 - SIMILARITY) + 1e-9))
    # Lines that other bands have joined already need no link here.
    groups = components(to_centre, "a", "b")
    of = groups.select(F.col("node").alias("h"), F.col("component").alias("group"))
    met = met.drop("score", "best").join(of, "h", "left").withColumn("group", F.coalesce("group", "h"))
    met = _unsettled(stored(met, "grouped"))
    # The middle row joins many of a band's groups; of the groups that stay apart all alike pairs are then met.
    met = _mates(met)
    texts = _texts(met.select("h"), lines)
    near = _forest(_middle_spokes(met), texts)
    rest = _forest(_met_pairs(_regrouped(met, near), texts), texts)
    return groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(near).unionByName(rest)


def line_decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, h, component, keep): one row per line that is not blank.

    ``h`` is the 64-bit hash of the compared line and stands for it. In every component the first line, by doc_id and line number,
    is kept. Rows that share a doc_id count as one document each; of equal (doc_id, line_no) both rows stay or go.
    Null and empty texts have no rows. Other columns are not read.
    """
    lines = line_rows(docs, doc_id, text).select("doc_id", "line_no", compared(F.col("line")).alias("line")).where("line <> ''")
    keyed = lines.withColumn("h", F.xxhash64("line"))
    placed = stored(keyed.select("doc_id", "line_no", "h"), "lines")
    found = stored(components(linked_lines(keyed.select("h", "line"), placed.count()), "a", "b"), "line-components")
    least = placed.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    grouped = stored(
        least.join(found, F.col("h") == F.col("node"), "left").select("h", "first", F.coalesce("component", "h").alias("component")),
        "line-groups",
    )
    firsts = grouped.groupBy("component").agg(F.min("first").alias("first"))
    firsts = grouped.select("h", "component").join(firsts, "component")
    return placed.join(firsts, "h").select(
        "doc_id", "line_no", "h", "component", (F.struct("doc_id", "line_no") == F.col("first")).alias("keep")
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without removed lines, all rows and columns kept.

    A document that loses every line has an empty text; null texts and rows without a doc_id are unchanged. ``n_chars``, where
    there is such a column, is counted anew for changed texts.
    """
    gone_id, gone_lines = fresh("gone_id", docs), fresh("gone_lines", docs)
    gone = (
        line_decisions(docs, doc_id, text)
        .where(~F.col("keep"))
        .groupBy(F.col("doc_id").alias(gone_id))
        .agg(F.collect_set("line_no").alias(gone_lines))
    )
    left = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(gone_lines, i))
    joined = docs.join(gone, F.col(doc_id) == F.col(gone_id), "left")
    changed = F.col(gone_lines).isNotNull()
    out = joined.withColumn(text, F.when(changed, F.array_join(left, "\n")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
