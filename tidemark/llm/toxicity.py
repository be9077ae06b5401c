"""Toxicity classifier: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words, the heads of longer words (first 5 and 7 letters, so that endings of one stem share
weight), pairs of neighbours, and pairs with one or two words between. Each is a 32-bit hash. A long text is read piece by piece; pairs
reach across the pieces.

The learner keeps for each feature the sum of gradients, less what its weight has already moved, and the sum of their squares. The latter
sets the feature's own rate: rare features move fast, common ones slowly. A feature whose gradient sum stays within the L1 bound
has weight 0. Few weights are left; they are broadcast as two sorted arrays.

Training takes a bounded sample of the labelled texts, chosen by a hash of the id: ``SAMPLE`` rows, of ``TEXT_CHARS`` code points each and
``SAMPLE_CHARS`` in all at most. The texts become features on the executors; the driver gets feature numbers of the sample
alone. Scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stored

SAMPLE, TEXT_CHARS, SAMPLE_CHARS = 8000, 200_000, 20_000_000
PASSES, LEAST_TEXTS = 3, 3
# Rates alpha / (beta + root of a feature's squared gradients), L1 and L2 bounds.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0
HEADS = (5, 7)
GAPS = (1, 2, 3)
SEED = 12
CHARS_AT_ONCE = 1 << 20
WORDS_KNOWN = 1 << 18
_WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((values ^ (values >> np.uint64(29))) >> np.uint64(32)).astype(np.uint32)


class _Words(dict):
    """Numbers of words, given on first sight; the hashes of word number i are row i of :meth:`table`."""

    def __init__(self) -> None:
        self.new: list[tuple[int, ...]] = []
        self.rows = np.zeros((1 << 12, 1 + len(HEADS)), np.uint64)

    def __missing__(self, word: str) -> int:
        heads = [f"{n}:{word[:n]}" if len(word) > n else f"0:{word}" for n in HEADS]
        self.new.append(tuple(xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in (f"0:{word}", *heads)))
        self[word] = len(self)
        return self[word]

    def table(self) -> np.ndarray:
        if self.new:
            while len(self.rows) < len(self):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[len(self) - len(self.new) : len(self)] = np.array(self.new, dtype=np.uint64)
            self.new = []
        return self.rows


class Features:
    """Hashed features of texts; remembers the hashes of words it has met."""

    def __init__(self) -> None:
        self.known = _Words()

    def pieces(self, text: str | None) -> Iterator[np.ndarray]:
        """The features of a whole text, piece by piece, repeats kept."""
        text = text or ""
        carried, at = np.zeros(0, np.uint64), 0
        while at < len(text):
            stop = at + CHARS_AT_ONCE
            while stop < len(text) and _WORDS.match(text, stop - 1, stop) and _WORDS.match(text, stop, stop + 1):
                stop += 1  # not within a word
            words = _WORDS.findall(text[at:stop].lower())
            at = stop
            if not words:
                continue
            if len(self.known) > WORDS_KNOWN:
                self.known = _Words()
            numbers = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            fresh = self.known.table()[numbers]
            plain = np.r_[carried, fresh[:, 0]]
            found = [_mixed(fresh.ravel())]
            for gap in GAPS:
                first = max(0, len(carried) - gap)
                found.append(_mixed((plain[first:-gap] * _MIX + plain[first + gap :]) * _MIX + np.uint64(gap)))
            yield np.concatenate(found)
            carried = plain[-max(GAPS) :]

    def of(self, text: str | None) -> np.ndarray:
        """The features of a whole text, sorted, each once."""
        parts = [np.unique(part) for part in self.pieces(text)]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def _probability(value: float | np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


@dataclass
class Model:
    """The features with a weight, sorted, and their weights; ``constant`` counts for every text."""

    features: np.ndarray
    weights: np.ndarray
    constant: float

    def __post_init__(self) -> None:
        # which of 2**20 ranges of features have a weight in them
        self.ranges = np.zeros(1 << 20, bool)
        self.ranges[self.features >> np.uint32(12)] = True

    def score(self, pieces: Iterable[np.ndarray]) -> float:
        """Probability of label 1 for a text's features, in pieces and with repeats."""
        hits = [part[self.ranges[part >> np.uint32(12)]] for part in pieces]
        found = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.uint32)
        if not len(self.features) or not len(found):
            return float(_probability(self.constant))
        place = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        return float(_probability(self.constant + self.weights[place[self.features[place] == found]].sum()))


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    bound = np.maximum(np.abs(z) - l1, 0) * np.sign(z)
    return -bound / ((beta + np.sqrt(n)) / alpha + l2)


def ftrl(
    texts: list[np.ndarray],
    labels: np.ndarray,
    passes: int = PASSES,
    alpha: float = ALPHA,
    beta: float = BETA,
    l1: float = L1,
    l2: float = L2,
    least_texts: int = LEAST_TEXTS,
) -> Model:
    """Fit on one text after the other, in the given order.

    Features of fewer than ``least_texts`` texts are left out. The constant is a feature of every text, free of L1 and L2.
    """
    if not len(labels):
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    every = np.sort(np.concatenate(texts))
    opens = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, int)
    names = every[opens[np.diff(np.r_[opens, len(every)]) >= least_texts]]
    columns = []
    for found in texts:
        place = np.searchsorted(names, found)
        place = place[place < len(names)]
        columns.append(place[names[place] == found[: len(place)]].astype(np.int32))
    z, n = np.zeros(len(names)), np.zeros(len(names))
    z0, n0 = 0.0, 0.0
    for _ in range(passes):
        for mine, label in zip(columns, labels, strict=True):
            w = _weights(z[mine], n[mine], alpha, beta, l1, l2)
            w0 = -z0 / ((beta + np.sqrt(n0)) / alpha)
            slope = float(_probability(w0 + w.sum())) - label
            step = (np.sqrt(n[mine] + slope**2) - np.sqrt(n[mine])) / alpha
            z[mine] += slope - step * w
            n[mine] += slope**2
            z0 += slope - (np.sqrt(n0 + slope**2) - np.sqrt(n0)) / alpha * w0
            n0 += slope**2
    w = _weights(z, n, alpha, beta, l1, l2)
    return Model(names[w != 0], w[w != 0], float(-z0 / ((beta + np.sqrt(n0)) / alpha)))


@F.pandas_udf(T.BinaryType())
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    read = Features()
    for texts in batches:
        yield pd.Series([read.of(t).tobytes() for t in texts], dtype=object)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fit on rows of ``docs`` that ``labels`` (doc_id, toxic) marks 0 or 1.

    Rows without an id teach nothing; rows that share an id teach once, an id with both labels teaches nothing. Without any label the
    model answers 0.5.
    """
    marked = labels.where(F.col(toxic).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    marked = marked.agg(F.min(toxic).alias("label"), F.max(toxic).alias("other")).where("label = other").drop("other")
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.length(text).alias("chars"))
    read = read.where(F.coalesce("chars", F.lit(0)) <= TEXT_CHARS)
    draw = F.xxhash64(F.lit(SEED), "doc_id").alias("draw")
    narrow = read.groupBy("doc_id").agg(F.max("chars").alias("chars")).join(marked, "doc_id")
    drawn = narrow.select("doc_id", "label", "chars", draw).orderBy("draw", "doc_id").limit(SAMPLE)
    # the sample has SAMPLE rows at most here: one task adds their lengths up
    reach = F.sum(F.coalesce("chars", F.lit(0))).over(Window.orderBy("draw", "doc_id"))
    chosen = stored(drawn.withColumn("reach", reach).where(F.col("reach") <= SAMPLE_CHARS).select("doc_id", "label", "draw"), "sample")
    found = read.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text"))
    rows = found.select("draw", "doc_id", "label", _features("text").alias("found")).collect()
    rows.sort(key=lambda row: (row["draw"], row["doc_id"]))
    return ftrl([np.frombuffer(row["found"], np.uint32) for row in rows], np.array([row["label"] for row in rows], dtype=float))


def scorer(spark: SparkSession, model: Model):
    """A column function of a text: the probability of label 1. A text without words gets what the constant says."""
    shared = spark.sparkContext.broadcast((model.features, model.weights, model.constant))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted, read = Model(*shared.value), Features()
        for texts in batches:
            yield pd.Series([fitted.score(read.pieces(t)) for t in texts], dtype=float)

    return score


def held_out(doc_id: Column) -> Column:
    """The fold that no training sees: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row; the model learns from rows that are not held out.

    Null and empty texts have a score too. Labels, language, source and id are never inputs of a score. Rows may repeat or lack an id.
    """
    held = held_out(F.col(doc_id))
    model = train(docs.where(~held), labels.where(~held_out(F.col("doc_id"))), doc_id, text)
    out = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), scorer(docs.sparkSession, model)(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
