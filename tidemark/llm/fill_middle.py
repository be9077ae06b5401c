"""Fill-in-the-middle examples; cuts are located over content-defined chunks whose summaries are remembered.

A text is cut into chunks where a rolling hash of its last bytes has its low bits zero, so equal passages give equal chunks wherever they
stand. Of each chunk a summary is kept: code points, line ends, whether a mark lies inside, and its two outermost bytes at either end, by which
marks across a border are found. Summaries are remembered by a hash of the chunk and taken over only where the chunk's content is equal.
Summaries add up: the running counts of line ends name the chunk of each cut, and only that chunk is searched.

Every text is handled where it is read; nothing is shuffled. The memory of a task is bounded (``REMEMBERED_BYTES``); a task that is run again
only fills it anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fields

# Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
SEED = 7
CHANGED_OF_100, SPM_OF_100 = 100, 50
# A chunk has 256 bytes at least, about 1,024 more on average, and 16,384 at most.
SHORTEST, BITS, LONGEST = 256, 10, 16_384
BYTES_AT_ONCE = 1 << 20
REMEMBERED_BYTES = 16 << 20
_WINDOW = 32
_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


class Summary(NamedTuple):
    points: int
    ends: int
    marked: bool
    head: bytes
    tail: bytes


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the hash of the last 32 bytes up to it: twice the hash before, plus the byte's own number."""
    out, reach = _GEAR[data], 1
    while reach < _WINDOW:
        out[reach:] += out[:-reach] << np.uint32(reach)
        reach *= 2
    return out


def borders(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``, ascending; the last is its length."""
    found = []
    for at in range(0, len(raw), BYTES_AT_ONCE):
        before = min(at, _WINDOW - 1)
        hashes = rolling(np.frombuffer(raw, np.uint8, min(BYTES_AT_ONCE, len(raw) - at) + before, at - before))[before:]
        # the highest bits depend on all bytes of the window
        found.append(np.flatnonzero(hashes >> np.uint32(32 - BITS) == 0) + at + 1)
    out, last = [], 0
    for border in [*np.concatenate(found).tolist(), len(raw)] if found else []:
        while border - last > LONGEST:
            last += LONGEST
            out.append(last)
        if border - last >= SHORTEST or (border == len(raw) and border > last):
            out.append(border)
            last = border
    return out


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    points = int(np.count_nonzero((data & 0xC0) != 0x80))
    return Summary(points, chunk.count(b"\n"), any(mark in chunk for mark in _MARKS), chunk[:2], chunk[-2:])


class Memory:
    """Summaries of the chunks seen last, found by hash and used only if the whole content is equal."""

    def __init__(self, most_bytes: int = REMEMBERED_BYTES):
        self.most, self.size, self.hits = most_bytes, 0, 0
        self.held: dict[int, tuple[bytes, Summary]] = {}

    def of(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        known = self.held.pop(key, None)
        if known and known[0] == chunk:
            self.hits += 1
        else:
            if known:
                self.size -= len(known[0])
            known = chunk, summary(chunk)
            self.size += len(chunk)
        self.held[key] = known  # the latest used is last
        while self.size > self.most:
            oldest = next(iter(self.held))
            self.size -= len(self.held.pop(oldest)[0])
        return known[1]


class Chunked:
    """A text as chunks with running counts."""

    def __init__(self, raw: bytes, memory: Memory):
        self.raw, self.stops = raw, [0, *borders(raw)]
        parts = [memory.of(raw[a:b]) for a, b in zip(self.stops, self.stops[1:], strict=False)]
        self.points = np.cumsum([0, *[p.points for p in parts]])
        self.ends = np.cumsum([0, *[p.ends for p in parts]])
        seams = (a.tail + b.head for a, b in zip(parts, parts[1:], strict=False))
        self.marked = any(p.marked for p in parts) or any(mark in seam for seam in seams for mark in _MARKS)
        self.units = int(self.ends[-1]) + (bool(raw) and not raw.endswith(b"\n"))

    def after(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` lines."""
        if units == 0:
            return 0, 0
        if units > self.ends[-1]:
            return len(self.raw), int(self.points[-1])
        chunk = int(np.searchsorted(self.ends, units)) - 1
        start, at = self.stops[chunk], self.stops[chunk] - 1
        for _ in range(units - int(self.ends[chunk])):
            at = self.raw.index(b"\n", at + 1)
        inside = np.frombuffer(self.raw, np.uint8, at + 1 - start, start)
        return at + 1, int(self.points[chunk]) + int(np.count_nonzero((inside & 0xC0) != 0x80))


def draws(seed: int, doc_id: str) -> list[int]:
    """Four numbers from the first 32 hex digits of a digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def example(text: str | None, doc_id: str, memory: Memory, seed: int, changed: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    cut = Chunked(raw, memory)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not raw or cut.marked or h3 % 100 >= changed:
        return cut.units, "plain", None, None, text or ""
    low, high = sorted((h1 % (cut.units + 1), h2 % (cut.units + 1)))
    (a, a_points), (b, b_points) = cut.after(low), cut.after(high)
    prefix, middle, suffix = (raw[x:y].decode("utf-8", "surrogatepass") for x, y in ((0, a), (a, b), (b, len(raw))))
    if h4 % 100 < spm:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return cut.units, form, a_points, b_points - a_points, output


def _maker(seed: int, changed: int, spm: int):
    @F.pandas_udf(fields("n long, form string, prefix_chars long, middle_chars long, output string"))
    def make(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        memory = Memory()
        for ids, texts in batches:
            rows = [example(t, i or "", memory, seed, changed, spm) for i, t in zip(ids, texts, strict=True)]
            made = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return make


def transformed(
    docs: DataFrame,
    seed: int = SEED,
    changed_of_100: int = CHANGED_OF_100,
    spm_of_100: int = SPM_OF_100,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output.

    The middle lies between two drawn line counts; draws hang on seed and id alone, so rows with one id and one text are equal. A null id
    draws as an empty one, a null text is an empty text. Texts that are empty or hold a mark stay plain, with null counts. Other
    columns are not read.
    """
    made = _maker(seed, changed_of_100, spm_of_100)(F.col(doc_id).cast("string"), F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), made.alias("made")).select("doc_id", "made.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text in another form than plain holds no mark, so each mark is the first of its kind."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    at = F.instr(body, second)
    head, rest = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(PREFIX))
    last = F.instr(rest, MIDDLE)
    tail, middle = F.substr(rest, F.lit(1), last - 1), F.substr(rest, last + len(MIDDLE))
    rebuilt = F.when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
    return F.when(form == "plain", output).otherwise(rebuilt)
