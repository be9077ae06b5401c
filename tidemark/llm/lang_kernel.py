"""Language identification: presence kernels over blended n-grams, Nyström landmarks, one-versus-rest kernel ridge regression.

A text is the set of its character n-grams of 1 to 4 characters, lower-cased, with every run of non-letters as one blank.
Each set is kept as a bit per bucket of a fixed hash, ``BUCKETS`` for each n. The kernel of two texts is the mean over n of
``|A and B| / sqrt(|A| |B|)``, squared: a blended spectrum with presence in place of counts. It is a matrix product of the
normalised presence rows. A text of more than ``WINDOW`` characters is cut into equal windows, so that a long text does not fill the
buckets; its kernel with another text is the mean of its windows', and each of its windows may teach.

Training uses a bounded sample of labelled texts (``PER_LANGUAGE`` of each language, the least by a hash of their id; ``MAX_LANGUAGES``
languages with the most rows). The sample's texts become bits on the executors; only the bits reach the driver.
``LANDMARKS`` of them, the same number for each language, span the Nyström map; ridge regression with labels +1 and -1 is
solved in the map. Scoring is two matrix products per batch of texts: with the landmarks, and with the weights.

A ridge value says which taught language is nearest, not whether the text is in it. That is told by familiarity: the mean, over
the buckets of a text's 3-grams, of the share of a language's training texts that have the bucket. Each language has a floor, learnt from
the sample: halfway between what nearly all of its own texts reach (each left out of the shares it is held against) and what
texts of the other languages have in the middle, or what random buckets have if no other language is taught.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh

ORDERS = (1, 2, 3, 4)
BUCKETS = 4096
PER_LANGUAGE = 400
MAX_LANGUAGES = 256
LANDMARKS = 64
RIDGE = 1e-3
TEXTS_AT_ONCE = 256
CHARS_AT_ONCE = 1 << 20
WINDOW = 4096
FAMILIAR_ORDER = 3
OWN_QUANTILE = 0.01
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def presence(text: str | None) -> np.ndarray | None:
    """One byte per bucket and order, 1 where an n-gram of the text falls into it; None without a letter.

    The whole text is read, in pieces that overlap by the longest n-gram, so memory stays bounded.
    """
    if not text:
        return None
    bits = np.zeros((len(ORDERS), BUCKETS), dtype=np.uint8)
    found = False
    for at in range(0, len(text), CHARS_AT_ONCE):
        stop = at + CHARS_AT_ONCE
        piece = _NOT_LETTERS.sub(" ", text[max(0, at - max(ORDERS) + 1) : stop].lower())
        found = found or any(map(str.isalpha, piece))
        piece = f"{'' if at else ' '}{piece}{' ' if stop >= len(text) else ''}"
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        grams = np.zeros(len(codes), dtype=np.uint64)
        for row, n in enumerate(ORDERS):
            grams = grams[: len(codes) - n + 1] * _MIX[0] + codes[n - 1 :]
            mixed = (grams ^ (grams >> np.uint64(29))) * _MIX[1]
            bits[row, mixed >> np.uint64(64 - 12)] = 1
    return bits.ravel() if found else None


def windows(text: str | None) -> Iterator[str]:
    """The whole text in the least number of equal pieces of at most ``WINDOW`` characters; the last may be shorter."""
    if text:
        size = -(-len(text) // -(-len(text) // WINDOW))
        for at in range(0, len(text), size):
            yield text[at : at + size]


@F.pandas_udf(T.BinaryType())
def packed_presence(texts: pd.Series) -> pd.Series:
    rows = (presence(t) for t in texts)
    return pd.Series([None if r is None else np.packbits(r).tobytes() for r in rows], dtype=object)


def _normalised(rows: np.ndarray) -> np.ndarray:
    blocks = rows.reshape(len(rows), len(ORDERS), BUCKETS).astype(np.float32)
    sizes = np.maximum(blocks.sum(axis=2, keepdims=True), 1)
    return (blocks / np.sqrt(sizes * len(ORDERS))).reshape(len(rows), -1)


def _familiar_bits(rows: np.ndarray) -> np.ndarray:
    return rows.reshape(len(rows), len(ORDERS), BUCKETS)[:, ORDERS.index(FAMILIAR_ORDER)].astype(np.float32)


def _familiarity(rows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(rows, languages): the mean share of a text's 3-gram buckets."""
    bits = _familiar_bits(rows)
    return bits @ shares.T / np.maximum(bits.sum(axis=1, keepdims=True), 1)


def _profiles(packed: np.ndarray, of: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, floors) of the training texts ``packed``, of the languages ``of``. A language of one text has no floor."""
    part = lambda k: np.unpackbits(packed[of == k], axis=1)
    shares = np.array([_familiar_bits(part(k)).mean(axis=0) for k in range(languages)])
    floors = np.zeros(languages)
    others = [_familiarity(part(k), shares) for k in range(languages)]
    for k in range(languages):
        n = len(others[k])
        if n > 1:
            # each bit of a text counts its own text once among n
            own = (others[k][:, k] * n - 1) / (n - 1)
            strange = np.concatenate([other[:, k] for j, other in enumerate(others) if j != k] or [shares[k].mean(keepdims=True)])
            floors[k] = min(np.quantile(own, OWN_QUANTILE), (np.quantile(own, OWN_QUANTILE) + np.median(strange)) / 2)
    return shares, floors


@dataclass
class Model:
    """``languages`` in the order of the columns of ``weights``; landmarks are kept as bits; shares and floors of familiarity."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    shares: np.ndarray
    floors: np.ndarray

    def scorer(self):
        """A function of a batch of presence rows: (rows, languages) of regression values."""
        spread = _normalised(np.unpackbits(self.landmarks, axis=1)).T.copy() if len(self.languages) else None

        def score(rows: np.ndarray) -> np.ndarray:
            kernel = (_normalised(rows) @ spread) ** 2
            return np.hstack([kernel, np.ones((len(rows), 1), dtype=np.float32)]) @ self.weights

        return score


def train(labelled: DataFrame, seed: int = 11) -> Model:
    """Fit on windows of ``labelled`` (doc_id, text, lang); rows without language or letter are left out.

    A table without any labelled text gives a model without languages, which answers ``und``.
    """
    labelled = labelled.where("lang is not null and text is not null")
    top = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    names = sorted(row["lang"] for row in top.collect())
    of_text = F.xxhash64(F.lit(seed), "doc_id", "text")
    pieces = F.ceil(F.length("text") / WINDOW).cast("int")
    places = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    size = F.ceil(F.length("text") / F.greatest(pieces, F.lit(1))).cast("int")
    draw = lambda base, i: F.when(i == 0, base).otherwise(F.xxhash64(base, i))
    # Spark keeps the least rows of each language per task before it shuffles them; only numbers move
    by_draw = Window.partitionBy("lang").orderBy("draw")
    known = labelled.where(F.col("lang").isin(names))
    listed = known.select("lang", of_text.alias("base"), F.explode(places).alias("i"))
    ranked = listed.select("lang", draw(F.col("base"), F.col("i")).alias("draw")).distinct()
    chosen = ranked.withColumn("rank", F.row_number().over(by_draw)).where(F.col("rank") <= PER_LANGUAGE).select("draw").collect()
    wanted = [row["draw"] for row in chosen]
    cut = known.select("lang", "text", size.alias("size"), of_text.alias("base"), places.alias("places"))
    taken = F.filter("places", lambda i: draw(F.col("base"), i).isin(wanted))
    taken = F.transform(
        taken, lambda i: F.struct(draw(F.col("base"), i).alias("draw"), F.substring("text", i * F.col("size") + 1, F.col("size")).alias("text"))
    )
    picked = cut.select("lang", F.explode(taken).alias("w")).select("lang", "w.draw", "w.text")
    picked = picked.groupBy("draw", "lang").agg(F.first("text").alias("text"))  # repeated rows teach once
    rows = picked.select("draw", "lang", packed_presence("text").alias("bits")).where("bits is not null").collect()
    rows = sorted({(row["draw"], row["lang"]): bytes(row["bits"]) for row in rows if row["lang"] in names}.items())
    names = sorted({lang for (_, lang), _ in rows})  # those with a letter in some text
    if not rows:
        return Model([], np.zeros((0, 0), np.uint8), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0))
    packed = np.array([np.frombuffer(bits, dtype=np.uint8) for _, bits in rows])
    of = np.array([names.index(lang) for (_, lang), _ in rows])
    each = max(1, LANDMARKS // len(names))
    landmarks = packed[np.concatenate([np.flatnonzero(of == k)[:each] for k in range(len(names))])]
    spread = _normalised(np.unpackbits(landmarks, axis=1))
    kernel = np.vstack([(_normalised(np.unpackbits(part, axis=1)) @ spread.T) ** 2 for part in np.array_split(packed, 1 + len(packed) // 512)]).astype(np.float64)
    among = ((spread @ spread.T) ** 2).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    kept = values > 1e-6 * values.max()
    to_map = vectors[:, kept] / np.sqrt(values[kept])
    mapped = np.hstack([kernel @ to_map, np.ones((len(kernel), 1))])
    target = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    # each language weighs the same, however many rows it has
    share = (1.0 / np.bincount(of, minlength=len(names)))[of][:, None]
    solved = np.linalg.solve(mapped.T @ (mapped * share) + RIDGE * np.eye(mapped.shape[1]), mapped.T @ (target * share))
    weights = np.vstack([to_map @ solved[:-1], solved[-1:]]).astype(np.float32)
    return Model(names, landmarks, weights, *_profiles(packed, of, len(names)))


def classifier(spark: SparkSession, model: Model):
    """A column function of a text: struct (lang, score, familiar).

    ``und`` with score 0 where the text is null or has no letter, or the model knows no language. The score is (1 + v) / 2 for the
    winning regression value v, held to 0..1. Ties go to the first name. ``familiar`` tells whether the text's familiarity reaches the
    floor of the winning language; it is false for ``und``. Rows are independent of each other.
    """
    shared = spark.sparkContext.broadcast((model.languages, model.landmarks, model.weights, model.shares, model.floors))

    @F.pandas_udf("lang string, score double, familiar boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = Model(*shared.value)
        score = fitted.scorer()
        for texts in batches:
            names = np.full(len(texts), UNKNOWN, dtype=object)
            scores, familiar = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            values = np.zeros((len(texts), len(fitted.languages)))
            known, count = values.copy(), np.zeros(len(texts))
            rows = ((i, row) for i, t in enumerate(texts) for row in map(presence, windows(t)) if row is not None)
            while fitted.languages and (block := list(itertools.islice(rows, TEXTS_AT_ONCE))):
                of, bits = np.array([i for i, _ in block]), np.array([row for _, row in block])
                np.add.at(values, of, score(bits))
                np.add.at(known, of, _familiarity(bits, fitted.shares))
                np.add.at(count, of, 1)
            there = np.flatnonzero(count)
            if len(there):
                values, known = values[there] / count[there, None], known[there] / count[there, None]
                best = values.argmax(axis=1)
                names[there] = np.array(fitted.languages, dtype=object)[best]
                scores[there] = np.clip((1 + values.max(axis=1)) / 2, 0, 1)
                familiar[there] = known[np.arange(len(there)), best] >= fitted.floors[best]
            yield pd.DataFrame({"lang": names, "score": scores, "familiar": familiar})

    return classify


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; see :func:`classifier`. Other columns are not read."""
    answered = docs.select(F.col(doc_id).alias("doc_id"), classifier(docs.sparkSession, model)(F.col(text)).alias("a"))
    return answered.select("doc_id", F.col("a.lang").alias("lang_pred"), F.col("a.score").alias("score"))


def held_out(doc_id: Column) -> Column:
    """The fold that no training sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def recognised(docs: DataFrame, min_score: float = 0.2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in a language that the corpus' own labels teach, all columns kept.

    Rejected are texts without a letter, null texts, texts that no language claims with ``min_score``, and texts that are less familiar
    than the floor of the language that claims them. A corpus without
    labels teaches nothing, so all its documents go.
    """
    labelled = docs.where(~held_out(F.col(doc_id)))
    model = train(labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")))
    answer = fresh("answer", docs)
    scored = docs.withColumn(answer, classifier(docs.sparkSession, model)(F.col(text)))
    accepted = (F.col(f"{answer}.lang") != UNKNOWN) & (F.col(f"{answer}.score") >= min_score) & F.col(f"{answer}.familiar")
    return scored.where(accepted).select(*docs.columns)
