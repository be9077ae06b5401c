"""Exact removal of long repeated byte strings by a run-length index.

A byte of a document is removed if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

Routing. Equal strings must meet without shipping every string. The ``MINIMIZER`` bytes with the least hash among those in a string
(the leftmost of equals) depend on the string alone. Neighbouring strings that share one are sent as one *piece*, about 70 bytes for 20
strings, to the bucket of that hash; equal strings are in pieces of one bucket and one hash. A task packs the pieces of a batch
per bucket and sends equal pieces once with the places where they occur, so that a passage in a third of all documents costs
each task one copy.

Index. In a bucket, pieces of a hash that occurs in one document only are dropped, and equal pieces become one with its least
document; all later occurrences are marked whole. The rest are indexed: the suffixes with ``LENGTH`` bytes ahead
of them are put in order, and the bytes before them form the Burrows-Wheeler transform of the pieces, kept as runs. A run never crosses
from one ``LENGTH``-byte context into another, and its first and last suffixes are sampled with their documents.
Equal suffixes are in order of documents, so the sample that begins a context names the least document that has the string.
The matching statistic of a suffix, cut at ``LENGTH``, reaches ``LENGTH`` where that sample is of a smaller document;
such stretches are streamed out as marks.

Marks come back to their documents as byte ranges; each document is then read once more, cut and hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fields

LENGTH = 50
MINIMIZER = 10
SPAN = LENGTH - MINIMIZER + 1
BYTES_AT_ONCE = 1 << 19
# Bytes of pieces that are packed together, and of packed pieces that are sent together.
PACKED_AT_ONCE, SENT_AT_ONCE = 64 << 20, 4 << 20
PACKING_LEVEL = 6
# Buckets and tasks per shuffle partition. Buckets are dealt evenly, and a task works on one after the other: what it
# is sent, which may lie in one Arrow batch, is the pieces of two.
BUCKETS_PER_PARTITION, TASKS_PER_PARTITION = 4, 2
SORTED_AT_ONCE = 250_000
_PLACE_BITS = np.uint64(24)
_FACTOR = 0x9E3779B97F4A7C15
_U = np.uint64


def _joined(left: np.ndarray, right: np.ndarray, at: int, size: int | None = None) -> np.ndarray:
    """Hashes of the bytes that ``left`` has hashes of, followed by ``size`` bytes (``at`` if not given) hashed in ``right``, ``at`` bytes on."""
    n = len(right) - at
    out = left[:n] * _U(_FACTOR ** (size or at) % 2**64)
    out += right[at:]
    return out


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``MINIMIZER`` bytes from each position on."""
    done = data.astype(_U)
    done += _U(1)
    done *= _U(0xD6E8FEB86659FD93)
    two = done = _joined(done, done, 1)
    done = _joined(done, done, 2)
    done = _joined(done, done, 4)
    ten = _joined(done, two, 8, 2)
    del done, two
    ten ^= ten >> _U(31)
    ten *= _U(0x94D049BB133111EB)
    return ten ^ (ten >> _U(29))


def _powers(n: int) -> np.uint64:
    return _U(_FACTOR**n % 2**64)


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``LENGTH`` bytes from each position on, from those of 2, 4, ... 32 bytes."""
    done, size = {1: (data.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)}, 1
    while 2 * size <= LENGTH:
        done[2 * size] = done[size][:-size] * _powers(size) + done[size][size:]
        if not LENGTH & size:
            del done[size]
        size *= 2
    out, at = None, 0
    n = len(data) - LENGTH + 1
    for size in sorted(done, reverse=True):
        if LENGTH & size:
            part = done[size][at : at + n]
            out = part.copy() if out is None else out * _powers(size) + part
            at += size
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all stretches, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _pieces(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, place of the minimizer, its hash) of all pieces of ``data``, texts that end at ``stops``."""
    hashes = _hashes(data)
    packed = (hashes & ~((_U(1) << _PLACE_BITS) - _U(1))) | np.arange(len(hashes), dtype=_U)
    place = (_least(packed, SPAN) & ((_U(1) << _PLACE_BITS) - _U(1))).astype(np.int64)
    text = np.searchsorted(stops, np.arange(len(place)), side="right")
    inside = np.arange(len(place)) + LENGTH <= stops[text]
    first = inside & np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]]
    starts = np.flatnonzero(first)
    last = inside & np.r_[first[1:] | ~inside[1:], True]
    sizes = np.flatnonzero(last) - starts + LENGTH
    return starts, sizes, place[starts] - starts, hashes[place[starts]]


def _same(content: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a piece for each different content, number of its content for each piece); compares whole contents."""
    width = LENGTH + SPAN
    padded = np.zeros((len(sizes), width), dtype=np.uint8)
    if len(sizes):
        column = np.arange(len(content)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        padded[np.repeat(np.arange(len(sizes)), sizes), column] = content
        padded[:, -1] = sizes
    rows = np.ascontiguousarray(padded).view(f"V{width}").ravel()
    _, one, number = np.unique(rows.view(f"S{width}"), return_index=True, return_inverse=True)
    return one, number


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=PACKING_LEVEL).compress(sizes + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, dtype="<u4", count=len(kinds))
    ends = np.cumsum(sizes) + 4 * len(kinds)
    return [np.frombuffer(raw[end - size : end], dtype=kind) for end, size, kind in zip(ends, sizes, kinds, strict=True)]


# content, size and place of the minimizer of each different piece; ids and tags of documents; then for each occurrence the piece,
# the document and the place in it, as steps from the one before
KINDS = ("u1", "u1", "u1", "<i8", "<i4", "<i4", "<i4", "<i4")


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values.astype("<i8"), prepend=0).astype("<i4")


class _Packer:
    """Collects some texts and where their pieces are, and packs the pieces per bucket when enough are held."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.held: list[tuple[np.ndarray, ...]] = []
        self.read = self.texts = self.size = 0

    def add(self, texts: list[bytes], ids: list[int], tags: list[int], offsets: list[int]) -> None:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts])
        stops = np.cumsum(lengths)
        starts, sizes, place, hashes = _pieces(data, stops)
        owner = np.searchsorted(stops, starts, side="right")
        at = starts - (stops - lengths)[owner] + np.array(offsets)[owner]
        # the pieces are three to four times the text, so they are cut out when they are packed
        self.held.append((
            data, np.array(ids, dtype="<i8"), np.array(tags, dtype="<i4"), (hashes % _U(self.buckets)).astype("<i4"),
            (starts + self.read).astype("<i4"), sizes.astype("u1"), place.astype("u1"),
            (owner + self.texts).astype("<i4"), at.astype("<i4"),
        ))
        self.read += len(data)
        self.texts += len(texts)
        self.size += int(sizes.sum())

    def rows(self) -> Iterator[pd.DataFrame]:
        data, ids_of, tags_of, *of_pieces = (np.concatenate(columns) for columns in zip(*self.held, strict=True))
        self.held, self.read, self.texts, self.size = [], 0, 0, 0
        buckets, all_starts, all_sizes, all_places, all_owners, all_at = of_pieces
        by_bucket = np.argsort(buckets, kind="stable")
        edges = np.r_[np.flatnonzero(np.diff(buckets[by_bucket], prepend=-1)), len(by_bucket)]
        out, packed = [], 0
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            part = by_bucket[low:high]
            sizes, owner = all_sizes[part].astype(np.int64), all_owners[part]
            place, ids, tags, at = all_places[part], ids_of[owner], tags_of[owner], all_at[part]
            content = data[_ragged(all_starts[part].astype(np.int64), sizes)]
            one, number = _same(content, sizes)
            # different pieces in the order in which they first occur, so that steps are small
            order = np.argsort(one)
            rank = np.empty(len(one), dtype=np.int64)
            rank[order] = np.arange(len(one))
            one, number = one[order], rank[number]
            docs = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
            doc = np.zeros(len(ids), dtype=np.int64)
            doc[docs[1:]] = 1
            starts = np.cumsum(sizes) - sizes
            blob = _pack(
                content[_ragged(starts[one], sizes[one])], sizes[one].astype("u1"), place[one],
                ids[docs], tags[docs], _steps(number), _steps(np.cumsum(doc)), _steps(at),
            )
            out.append((int(buckets[part[0]]), blob))
            packed += len(blob)
            if packed >= SENT_AT_ONCE:
                yield pd.DataFrame(out, columns=["bucket", "pieces"])
                out, packed = [], 0
        if out:
            yield pd.DataFrame(out, columns=["bucket", "pieces"])


def _packer(buckets: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = _Packer(buckets)
        cuts: list[tuple[bytes, int, int, int]] = []
        held = 0

        def take() -> None:
            nonlocal cuts, held
            if cuts:
                packer.add(*map(list, zip(*cuts, strict=True)))
            cuts, held = [], 0

        for batch in batches:
            for doc_id, tag, text in zip(batch["doc_id"], batch["tag"], batch["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                # a long text is cut so that every string lies whole in one cut
                for offset in range(0, len(raw) - LENGTH + 1, BYTES_AT_ONCE):
                    cuts.append((raw[offset : offset + BYTES_AT_ONCE + LENGTH - 1], doc_id, tag, offset))
                    held += len(cuts[-1][0])
                    if held >= BYTES_AT_ONCE:
                        take()
                        if packer.size >= PACKED_AT_ONCE:
                            yield from packer.rows()
        take()
        if packer.held:
            yield from packer.rows()

    return pack


def _repeated_windows(
    content: np.ndarray, starts: np.ndarray, windows: np.ndarray, docs: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of the windows that a piece of a smaller document has too: the run-length index of some pieces."""
    order = np.argsort(docs, kind="stable")
    at = _ragged(starts[order], windows[order])
    piece = np.repeat(order, windows[order])
    # a suffix whose hash no other has is alone in its context: it needs no place in the index
    sizes = windows[order] + LENGTH - 1
    hashes = _window_hashes(content[_ragged(starts[order], sizes)])[_ragged(np.cumsum(sizes) - sizes, windows[order])]
    ordered = np.sort(hashes)
    several = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(several):
        return piece[:0], at[:0]
    place = np.minimum(np.searchsorted(several, hashes), len(several) - 1)
    shared = several[place] == hashes
    at, piece = at[shared], piece[shared]
    suffixes = np.lib.stride_tricks.sliding_window_view(content, LENGTH)[at].reshape(-1).view(f"S{LENGTH}")
    rank = np.argsort(suffixes, kind="stable")
    ordered = suffixes[rank]
    new_context = np.r_[True, ordered[1:] != ordered[:-1]]
    # the transform: the byte before each suffix, or a sign of its own where the piece begins
    before = np.where(at == starts[piece], 256, content[np.maximum(at - 1, 0)].astype(np.int64))[rank]
    run = np.flatnonzero(np.r_[True, before[1:] != before[:-1]] | new_context)
    sample = docs[piece[rank[run]]]  # document of each run's first suffix
    opens = new_context[run]
    least = sample[opens][np.cumsum(opens) - 1]  # of the run's context
    length = np.diff(np.r_[run, len(rank)])
    hit = rank[docs[piece[rank]] > np.repeat(least, length)]
    return piece[hit], at[hit] - starts[piece[hit]]


def _marks_of_bucket(blobs: list[bytes]) -> pd.DataFrame:
    """(doc_id, tag, start, stop): byte ranges that are repeated, of all documents with pieces in the bucket."""
    parts = [_unpack(blob, KINDS) for blob in blobs]
    pieces_before = np.cumsum([0, *[len(p[1]) for p in parts]])
    docs_before = np.cumsum([0, *[len(p[3]) for p in parts]])
    content, sizes, place, ids, tags = (np.concatenate([p[i] for p in parts]) for i in range(5))
    piece = np.concatenate([np.cumsum(p[5], dtype=np.int64) + n for p, n in zip(parts, pieces_before, strict=False)])
    doc = np.concatenate([np.cumsum(p[6], dtype=np.int64) + n for p, n in zip(parts, docs_before, strict=False)])
    at = np.concatenate([np.cumsum(p[7], dtype=np.int64) for p in parts])
    parts.clear()
    blobs.clear()
    sizes = sizes.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    of = ids[doc]
    # minimizers that only one document has
    minimizer = np.lib.stride_tricks.sliding_window_view(content, MINIMIZER)[starts + place]
    key = np.ascontiguousarray(minimizer[:, :8]).view("<u8").ravel() * _U(_FACTOR)
    key += np.ascontiguousarray(minimizer[:, 8:]).view("<u2").ravel()
    _, group = np.unique(key, return_inverse=True)
    low, high = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group[piece], of)
    np.maximum.at(high, group[piece], of)
    live = (low < high)[group]
    if not live.any():
        return pd.DataFrame({"doc_id": [], "tag": [], "start": [], "stop": []}, dtype="int64")
    kept = np.flatnonzero(live)
    renumber = np.cumsum(live) - 1
    here = live[piece]
    piece, doc, at, of = renumber[piece[here]], doc[here], at[here], of[here]
    content, sizes, group = content[_ragged(starts[kept], sizes[kept])], sizes[kept], group[kept]
    # equal pieces of different tasks
    one, number = _same(content, sizes)
    starts = np.cumsum(sizes) - sizes
    piece = number[piece]
    starts, sizes, group = starts[one], sizes[one], group[one]
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, piece, of)
    later = of > least[piece]
    found = [(doc[later], at[later], at[later] + sizes[piece[later]])]
    # hashes that still have several pieces are indexed, as many at a time as memory allows
    order = np.argsort(group, kind="stable")
    alone = np.bincount(group)[group] < 2
    order = order[~alone[order]]
    windows = sizes - LENGTH + 1
    reach = np.cumsum(windows[order])
    firsts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, int)
    holders = np.argsort(piece, kind="stable")
    holders = holders[~later[holders]]
    held_from = np.searchsorted(piece[holders], np.arange(len(one)))
    held_to = np.searchsorted(piece[holders], np.arange(len(one)), side="right")
    low_cut = 0
    while low_cut < len(order):
        goal = (reach[low_cut - 1] if low_cut else 0) + SORTED_AT_ONCE
        nexts = firsts[firsts > low_cut]
        fits = nexts[reach[nexts - 1] <= goal]
        high_cut = int(fits[-1]) if len(fits) else int(nexts[0]) if len(nexts) else len(order)
        if not len(fits) and len(nexts) == 0 or reach[-1] <= goal:
            high_cut = len(order)
        mine = order[low_cut:high_cut]
        hit, window = _repeated_windows(content, starts[mine], windows[mine], least[mine])
        if len(hit):
            by = np.lexsort((window, hit))
            hit, window = hit[by], window[by]
            opens = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1]) | (window[1:] != window[:-1] + 1)])
            ends = np.r_[opens[1:], len(hit)] - 1
            of_piece = mine[hit[opens]]
            count = held_to[of_piece] - held_from[of_piece]
            who = holders[_ragged(held_from[of_piece], count)]
            begin = at[who] + np.repeat(window[opens], count)
            found.append((doc[who], begin, at[who] + np.repeat(window[ends], count) + LENGTH))
        low_cut = high_cut
    doc, start, stop = (np.concatenate(part) for part in zip(*found, strict=True))
    return pd.DataFrame({"doc_id": ids[doc], "tag": tags[doc].astype(np.int64), "start": start, "stop": stop})


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket; one bucket's packed pieces are held at a time."""
    now, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch["bucket"], batch["pieces"], strict=True):
            if bucket != now and blobs:
                yield _marks_of_bucket(blobs)
            now = bucket
            blobs.append(blob)
    if blobs:
        yield _marks_of_bucket(blobs)


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, start, stop): ranges of bytes to remove; they overlap. ``tag`` is a hash of the text the range is of."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, tasks = partitions * BUCKETS_PER_PARTITION, partitions * TASKS_PER_PARTITION
    read = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.hash(F.col(text)).alias("tag"), F.col(text).alias("text")
    )
    packed = read.mapInPandas(_packer(buckets), "bucket long, pieces binary")
    return (
        packed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int"))
        .sortWithinPartitions("bucket")
        .mapInPandas(_marks, "doc_id long, tag long, start long, stop long")
    )


def cut(raw: bytes, starts: list[int], stops: list[int]) -> tuple[bytes, int]:
    """(the bytes outside all ranges, number of maximal removed runs)."""
    order = np.argsort(np.asarray(starts, dtype=np.int64), kind="stable")
    starts, stops = np.asarray(starts, dtype=np.int64)[order], np.asarray(stops, dtype=np.int64)[order]
    reach = np.maximum.accumulate(stops)
    opens = np.r_[True, starts[1:] > reach[:-1]]
    low, high = starts[opens], reach[np.r_[opens[1:], True]]
    kept = [raw[a:b] for a, b in zip(np.r_[0, high].tolist(), np.r_[low, len(raw)].tolist(), strict=True)]
    return b"".join(kept), len(low)


@F.pandas_udf(T.BinaryType())
def _packed_text(texts: pd.Series) -> pd.Series:
    """Texts as compressed UTF-8, for the way to their ranges."""
    packer = zstandard.ZstdCompressor(level=PACKING_LEVEL)
    return pd.Series([packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


@F.pandas_udf(fields("n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
def _summary(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for packed, starts, stops in zip(*batch, strict=True):
            raw = unpack(packed)
            left, spans = cut(raw, starts, stops) if starts is not None and len(starts) else (raw, 0)
            rows.append((len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
        yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_ranges(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    marks = repeated_ranges(docs, doc_id, text).groupBy("doc_id", "tag").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")
    )
    read = docs.select(
        F.col(doc_id).alias("doc_id"), _packed_text(F.col(text)).alias("packed"), F.hash(F.col(text)).cast("long").alias("tag")
    )
    return read.join(marks, ["doc_id", "tag"], "left")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. Rows without a doc_id are not compared and lose nothing. Rows that share a doc_id do not take from
    each other; each is answered by its own text. Texts under 50 bytes lose nothing. Other columns are not read.
    """
    found = _with_ranges(docs, doc_id, text).select("doc_id", _summary("packed", "starts", "stops").alias("s"))
    return found.select("doc_id", "s.*")


@F.pandas_udf(T.BinaryType())
def _left(packed: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    unpack = zstandard.ZstdDecompressor().decompress
    raws = ((unpack(p), a, b) for p, a, b in zip(packed, starts, stops, strict=True))
    return pd.Series([cut(raw, a, b)[0] if a is not None and len(a) else raw for raw, a, b in raws], dtype=object)


def remaining_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept): the bytes that stay of every row. They need not be valid UTF-8, as ranges are of bytes."""
    return _with_ranges(docs, doc_id, text).select("doc_id", _left("packed", "starts", "stops").alias("kept"))
