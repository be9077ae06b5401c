"""Fill-in-the-middle: every example against a plain cut of lines, exact round trips, remembered chunks."""

import hashlib
import random
import re

import pytest
from helpers import AWKWARD, frame, given
from pyspark.sql import functions as F

from tidemark.llm import fill_middle


def plain(text, doc_id, seed=7, changed=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= changed:
        return len(units), "plain", None, None, text
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    a, b, c = ("".join(part) for part in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_examples_are_plain_cuts():
    draw, memory = random.Random(1), fill_middle.Memory(100_000)
    signs = ["word ", "é", "\n", "\U0001f600", "<", "P", ">", "S", "\r", " "]
    passage = "".join(draw.choices(signs[:4], k=4000))
    for i in range(600):
        size = draw.choice([0, 1, 2, 40, 3000])
        text = "".join(draw.choices(signs, weights=[5, 2, draw.choice([0, 1, 4]), 1, 0.2, 0.2, 0.2, 0.2, 0.2, 0.1], k=size))
        text += passage * (i % 3 == 0)
        assert fill_middle.example(text, str(i), memory, 7, 100, 50) == plain(text, i)
    assert memory.hits > 300 and memory.size <= 100_000


def test_chunks_hang_on_content():
    draw = random.Random(2)
    raw = bytes(draw.choices(range(256), k=60_000))
    ends = set(fill_middle.borders(raw))
    moved = {e - 777 for e in fill_middle.borders(bytes(777) + raw)}
    assert len(ends & moved) > 0.8 * len(ends) and max(ends) == len(raw)
    for stops in (fill_middle.borders(raw), fill_middle.borders(bytes(100_000)), fill_middle.borders(b"x")):
        sizes = [b - a for a, b in zip([0, *stops], stops, strict=False)]
        assert all(s >= fill_middle.SHORTEST for s in sizes[:-1]) and max(sizes) <= fill_middle.LONGEST
    assert fill_middle.borders(b"") == []


def test_borders_in_pieces_are_the_same(monkeypatch):
    raw = bytes(random.Random(3).choices(range(256), k=30_000))
    whole = fill_middle.borders(raw)
    monkeypatch.setattr(fill_middle, "BYTES_AT_ONCE", 1000)
    assert fill_middle.borders(raw) == whole


def test_equal_hash_needs_equal_content(monkeypatch):
    monkeypatch.setattr(fill_middle.xxhash, "xxh3_64_intdigest", lambda chunk: 1)
    memory = fill_middle.Memory()
    assert memory.of(b"one\n") == fill_middle.summary(b"one\n") and memory.of(b"two") == fill_middle.summary(b"two")
    assert memory.hits == 0 and memory.size == 3


def restored(made):
    return made.withColumn("text", fill_middle.restored(F.col("output"), F.col("form")))


@pytest.mark.parametrize("awkward", [True, False])
def test_round_trip(spark, small, awkward):
    more = [(20 + i, f"a<b\n{'<' * i}S>\nlast{'<' * i}", "en", "s") for i in range(6)] + [(30, "with <M> inside\nof it", "en", "s"), (31, "\n", "en", "s"), (32, "x" * 300_000 + "\nä" * 50_000, "en", "s")]
    docs = frame(spark, AWKWARD + more, clashes=True) if awkward else given(spark, small)
    want = sorted((str(r["doc_id"]), *map(str, plain(r["text"], r["doc_id"])), r["text"] or "") for r in docs.collect())
    got = restored(fill_middle.transformed(docs)).collect()
    assert sorted((str(r["doc_id"]), *map(str, (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])), r["text"]) for r in got) == want
    assert len({r["form"] for r in got}) == 3 if awkward else True
    assert fill_middle.transformed(docs.limit(0)).collect() == []


def test_shares_of_forms(spark, small):
    forms = {r["form"] for r in fill_middle.transformed(given(spark, small), changed_of_100=0).collect()}
    assert forms == {"plain"}
    forms = {r["form"] for r in fill_middle.transformed(given(spark, small), spm_of_100=0).collect()}
    assert forms <= {"plain", "psm"}
