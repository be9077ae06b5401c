"""Quality rules by line frequency: lines that many documents of one host share are removed, depleted documents rejected.

A line is normalised (lower-cased, each number as 0, blanks run together) and hashed. Per host and hash the distinct documents are counted;
above ``MAX_DOCUMENTS`` the line is boilerplate of that host. A document is depleted if less than ``MIN_LEFT`` of its
words, or fewer than ``MIN_WORDS``, are left once such lines are removed.

Base statistics of a text are taken in one pass over its words per document, inside the task that reads it. Only hashes of
lines, never texts, are shuffled; a line that a third of all documents share costs one partial count per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, fields, stored

MAX_DOCUMENTS = 20
MIN_LEFT = 0.3
MIN_WORDS = 10
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_WORDS = re.compile(WORD)
_DIGITS = re.compile(r"[0-9]+")

STATS = fields(
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash longs, line_words longs"
)


def _repeat_words(words: list[str]) -> int:
    """Words in windows of five words that the text has twice or more, the first occurrence included.

    Words are numbered first, windows are compared by their numbers as whole rows, so equal means equal.
    """
    if len(words) <= WINDOW:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    rank = ids
    for size in (1, 2):  # windows of 2, then 4 words, numbered by their two halves
        _, rank = np.unique(rank[: len(rank) - size] * (len(words) + 1) + rank[size:], return_inverse=True)
    last = len(words) - WINDOW + 1
    _, rank, counts = np.unique(
        rank[:last] * (len(words) + 1) + ids[WINDOW - 1 :], return_inverse=True, return_counts=True
    )
    starts = np.flatnonzero(counts[rank] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def text_statistics(text: str | None) -> tuple:
    """The base statistics of a whole text, and a hash and word count for each normalised line that has a word."""
    text = text or ""
    words = _WORDS.findall(text)
    seen: set[str] = set()
    again, hashes, sizes = 0, [], []
    for line in text.split("\n"):
        in_line = _WORDS.findall(line)
        if not in_line:
            continue
        again += line in seen
        seen.add(line)
        hashes.append(line_hash(in_line))
        sizes.append(len(in_line))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), sum(map(len, words)), symbols, again, _repeat_words(words), hashes, sizes


def line_hash(in_line: list[str]) -> int:
    """Hash of a normalised line, from its words."""
    plain = _DIGITS.sub("0", " ".join(in_line).lower())
    return xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63)


@F.pandas_udf(STATS)
def statistics_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_statistics(t) for t in texts], columns=STATS.names)


def _frequent(lines: DataFrame) -> DataFrame:
    """(host, no_host, h) of the lines in more than ``MAX_DOCUMENTS`` distinct documents of a host."""
    return (
        lines.where("doc_id is not null")
        .select("host", "no_host", "h", "doc_id")
        .distinct()
        .groupBy("host", "no_host", "h")
        .agg(F.count(F.lit(1)).alias("documents"))
        .where(F.col("documents") > MAX_DOCUMENTS)
    )


@F.pandas_udf(T.StringType())
def _left(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def of(text: str | None, hashes) -> str | None:
        if text is None or hashes is None:
            return text
        drop = set(map(int, hashes))
        return "\n".join(x for x in text.split("\n") if not (found := _WORDS.findall(x)) or line_hash(found) not in drop)

    return pd.Series([of(*pair) for pair in zip(texts, gone, strict=True)], dtype=object)


def without_frequent_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, text) for every input row, without the lines that :func:`judged` takes for boilerplate of the row's host.

    Lines without a word stay, null texts stay null. Rows of one host with equal texts lose the same lines, so the lines are joined back by
    host and a 64-bit hash of the text.
    """
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(host).isNull().alias("no_host"),
        F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"),
    )
    lines = stored(
        named.select("doc_id", "host", "no_host", "text_hash", F.explode(statistics_of("text")["line_hash"]).alias("h")), "text-lines"
    )
    on = ["host", "no_host", "text_hash"]
    gone = lines.join(_frequent(lines), ["host", "no_host", "h"]).groupBy(*on).agg(F.collect_set("h").alias("gone"))
    return named.join(gone, on, "left").select("doc_id", _left("text", "gone").alias("text"))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: doc_id, base statistics, base_failed, n_words_left, kept.

    A null text is an empty one. A null host is a host of its own. Rows that share a doc_id count once in a line's documents; rows
    without a doc_id count for no line but are judged like the others. An empty table gives an empty result.
    """
    row = F.monotonically_increasing_id().alias("row")
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(host).isNull().alias("no_host"), statistics_of(F.col(text)).alias("s"))
    stats = stored(read.select(row, "doc_id", "host", "no_host", "s.*"), "text-statistics")
    lines = stats.select(
        "row", "doc_id", "host", "no_host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("line")
    ).select("row", "doc_id", "host", "no_host", F.col("line.line_hash").alias("h"), F.col("line.line_words").alias("n"))
    removed = lines.join(_frequent(lines), ["host", "no_host", "h"]).groupBy("row").agg(F.sum("n").alias("removed"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        stats.join(removed, "row", "left")
        .withColumn("n_words_left", left)
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= MIN_LEFT * F.col("n_words")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "kept"
        )
    )
