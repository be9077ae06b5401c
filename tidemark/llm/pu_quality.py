"""Quality classifier learnt from positives and unlabelled text, with the non-negative unbiased risk.

Trusted positives are documents labelled 1. Unlabelled text is a sample of the corpus as it is; its labels are not read. With the
class prior p, the risk of a scorer on negatives is its risk on unlabelled text less p times its risk on positives as if they
were negative. That difference cannot be below zero in truth; where a batch of the sample makes it negative, the step
goes back up instead of fitting the noise (non-negative risk). The prior is estimated from a first scorer of
positives against unlabelled: the least ratio, over thresholds, of the unlabelled to the positives that fall below it on
the negative side, so that what is left over can only be negatives.

A text is described by counts and shares of its characters, words, lines and repeats, taken from the whole text on the executors.
The scorer is linear over these, their squares and pairwise products of the most telling; a last logistic step on the risk makes its
value a probability. Training takes a bounded sample (``POSITIVES``, ``UNLABELLED``), chosen by a hash of the id; only
numbers of that sample reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, stored

POSITIVES, UNLABELLED = 4000, 12_000
EPOCHS, BATCH = 60, 512
STEP, RIDGE = 0.02, 1e-4
SEED = 5
CHARS_AT_ONCE = 1 << 20
_WORDS = re.compile(WORD)
# Fixed values of the description: character groups counted per text.
_GROUPS = {
    "upper": re.compile(r"[A-ZÀ-ÖØ-Þ]"),
    "digit": re.compile(r"\d"),
    "stop": re.compile(r"[.!?…]"),
    "pause": re.compile(r"[,;:]"),
    "symbol": re.compile(r"[#*$%&|<>@^~={}\[\]\\/_+]"),
    "exclaim": re.compile(r"!"),
    "quote": re.compile(r"[\"'«»“”]"),
}
FEATURES = (
    "log_chars", "log_words", "log_lines", "mean_word", "long_words", "short_words", "distinct_words", "top_word",
    "repeated_pairs", "adjacent_equal", "repeated_lines", "mean_line", "upper_words", "title_words", "packed", "line_packed",
    *_GROUPS,
)


def describe(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all 0 for a null, empty or blank text."""
    words = _WORDS.findall(text or "")
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    pairs = Counter(zip(lower, lower[1:], strict=False))
    lines = [line for line in text.split("\n") if line.strip()]
    raw = text.encode("utf-8", "surrogatepass")
    squeezed = sum(len(zlib.compress(raw[at : at + CHARS_AT_ONCE], 1)) for at in range(0, len(raw), CHARS_AT_ONCE))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    return [
        np.log1p(chars), np.log1p(n), np.log1p(len(lines)), sizes.mean(), float((sizes > 12).mean()), float((sizes < 3).mean()),
        len(counts) / n, max(counts.values()) / n, 1 - len(pairs) / max(1, n - 1),
        sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n, 1 - len(set(lines)) / len(lines), np.log1p(chars / len(lines)),
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, squeezed / len(raw), np.log1p(squeezed),
        *[len(group.findall(text)) / chars for group in _GROUPS.values()],
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def description(texts: pd.Series) -> pd.Series:
    return pd.Series([describe(t) for t in texts], dtype=object)


@dataclass
class Model:
    """Centre and scale of the description, the chosen products, weights with the constant last, and the estimated prior."""

    centre: np.ndarray
    scale: np.ndarray
    pairs: np.ndarray
    weights: np.ndarray
    prior: float

    def values(self, rows: np.ndarray) -> np.ndarray:
        return _expand(np.clip((rows - self.centre) / self.scale, -6, 6), self.pairs) @ self.weights

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.values(rows), -30, 30)))


def _expand(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    products = x[:, pairs[:, 0]] * x[:, pairs[:, 1]] / 6 if len(pairs) else np.zeros((len(x), 0))
    return np.hstack([x, x**2 / 6, products, np.ones((len(x), 1))])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights by stochastic steps on the non-negative risk with logistic loss; without a prior, positives against unlabelled."""
    draw = np.random.default_rng(SEED)
    weights = np.zeros(positive.shape[1])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    turn = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(unlabelled))
        for at in range(0, len(order), BATCH):
            u = unlabelled[order[at : at + BATCH]]
            p = positive[draw.integers(0, len(positive), BATCH)]
            at_p, at_u = p @ weights, u @ weights
            up = -(p.T @ _sigmoid(-at_p)) / len(p)  # gradient of the loss of positives as positives
            down_p = p.T @ _sigmoid(at_p) / len(p)  # of positives, and of unlabelled, as negatives
            down_u = u.T @ _sigmoid(at_u) / len(u)
            if prior is None:
                slope = up + down_u
            else:
                negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
                slope = prior * up + down_u - prior * down_p if negative >= 0 else prior * down_p - down_u
            slope = slope + RIDGE * weights
            turn += 1
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            weights -= STEP * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return weights


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from a scorer's values.

    For every threshold, the share of the unlabelled above it is at least the prior times the positives' share above it. The least
    such ratio bounds the prior; thresholds that few positives pass are left out, as their ratio is noise.
    """
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    thresholds = np.quantile(positive, np.linspace(0, 0.9, 181))
    above_p = 1 - np.searchsorted(positive, thresholds) / len(positive)
    above_u = 1 - np.searchsorted(unlabelled, thresholds) / len(unlabelled)
    noise = np.sqrt(above_u * (1 - above_u) / len(unlabelled)) + np.sqrt(above_p * (1 - above_p) / len(positive))
    return float(np.clip(((above_u + noise) / above_p).min(), 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Model:
    """Fit on the rows of ``docs``; ``labels`` (doc_id, quality) names the positives among them.

    Rows without an id teach nothing. Without any positive the model has weight 0 and prior 0.5: it answers 0.5.
    """
    draw = F.xxhash64(F.lit(SEED), doc_id)
    ids = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), draw.alias("draw"))
    trusted = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias("doc_id")).distinct()
    # two top-k passes over narrow rows, then the texts of the chosen rows alone
    narrow = ids.select("doc_id", "draw").distinct()
    positive = narrow.join(trusted, "doc_id", "left_semi").orderBy("draw", "doc_id").limit(POSITIVES)
    unlabelled = narrow.select("doc_id", F.xxhash64("draw").alias("draw")).orderBy("draw", "doc_id").limit(UNLABELLED)
    chosen = stored(
        positive.select("doc_id", F.lit(1).alias("side")).unionByName(unlabelled.select("doc_id", F.lit(0).alias("side"))), "sample"
    )
    described = ids.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("side", "doc_id", description("text").alias("x"))
    # rows that share an id teach once, so that the driver gets no more than the sample
    rows = described.groupBy("side", "doc_id").agg(F.min("x").alias("x")).select("side", "x").collect()
    raw = np.array([row["x"] for row in rows], dtype=np.float64).reshape(-1, len(FEATURES))
    side = np.array([row["side"] for row in rows], dtype=int)
    order = np.lexsort((*raw.T[::-1], side))  # rows arrive in any order
    raw, side = raw[order], side[order]
    width = len(FEATURES)
    if not (side == 1).any():
        return Model(np.zeros(width), np.ones(width), np.zeros((0, 2), int), np.zeros(2 * width + 1), 0.5)
    centre, scale = raw[side == 0].mean(axis=0), raw[side == 0].std(axis=0) + 1e-9
    x = np.clip((raw - centre) / scale, -6, 6)
    plain = _expand(x, np.zeros((0, 2), int))
    guide = _fit(plain[side == 1], plain[side == 0], None)
    telling = np.argsort(-np.abs(guide[:width]), kind="stable")[:10]
    pairs = np.array([(i, j) for a, i in enumerate(telling) for j in telling[:a]])
    full = _expand(x, pairs)
    contrast = full @ _fit(full[side == 1], full[side == 0], None)
    prior = estimated_prior(contrast[side == 1], contrast[side == 0])
    return Model(centre, scale, pairs, _fit(full[side == 1], full[side == 0], prior), prior)


def scorer(spark: SparkSession, model: Model):
    """A column function of a text: the probability of label 1. Null and empty texts are scored as texts without words."""
    shared = spark.sparkContext.broadcast((model.centre, model.scale, model.pairs, model.weights, model.prior))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = Model(*shared.value)
        for texts in batches:
            rows = np.array([describe(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pd.Series(fitted.probabilities(rows))

    return score


def held_out(doc_id: Column) -> Column:
    """The fold that no training sees: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row; the model learns from rows that are not held out.

    Labels, language, source and id are never inputs of a score. Rows may repeat or lack an id.
    """
    held = held_out(F.col(doc_id))
    model = train(docs.where(~held), labels.where(~held_out(F.col("doc_id"))), doc_id, text)
    out = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), scorer(docs.sparkSession, model)(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
