"""Toxicity: the learner and its features against plain loops, held-out accuracy, awkward rows."""

import math
import zlib

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, frame

from tidemark.llm import toxicity


def plain_ftrl(texts, labels, passes, alpha, beta, l1, l2, least):
    """One coordinate after the other, in dictionaries; returns weights and constant."""
    count = {}
    for text in texts:
        for f in text:
            count[f] = count.get(f, 0) + 1
    z, n = {None: 0.0}, {None: 0.0}

    def weight(f):
        bound = 0.0 if f is None else l1
        if abs(z.get(f, 0.0)) <= bound:
            return 0.0
        rate = (beta + math.sqrt(n[f])) / alpha + (0.0 if f is None else l2)
        return -(z[f] - math.copysign(bound, z[f])) / rate

    for _ in range(passes):
        for text, label in zip(texts, labels, strict=True):
            mine = [None, *[f for f in text if count[f] >= least]]
            w = {f: weight(f) for f in mine}
            slope = 1 / (1 + math.exp(-sum(w.values()))) - label
            for f in mine:
                step = (math.sqrt(n.get(f, 0.0) + slope**2) - math.sqrt(n.get(f, 0.0))) / alpha
                z[f] = z.get(f, 0.0) + slope - step * w[f]
                n[f] = n.get(f, 0.0) + slope**2
    return {f: weight(f) for f in z if f is not None and weight(f)}, weight(None)


def test_learner_is_ftrl_proximal():
    draw = np.random.default_rng(3)
    texts = [np.unique(draw.integers(0, 60, 12)).astype(np.uint32) for _ in range(200)]
    labels = np.array([float(5 in t or 17 in t) for t in texts])
    for least, l1 in ((1, 0.5), (45, 0.1), (3, 100.0)):
        model = toxicity.ftrl(texts, labels, 2, 0.7, 1.0, l1, 0.5, least)
        weights, constant = plain_ftrl([t.tolist() for t in texts], labels, 2, 0.7, 1.0, l1, 0.5, least)
        assert dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(weights)
        assert model.constant == pytest.approx(constant)
    model = toxicity.ftrl(texts, labels, 5, 0.7, 1.0, 0.5, 0.5, 1)
    assert np.mean([(model.score([t, t]) >= 0.5) == y for t, y in zip(texts, labels, strict=True)]) >= 0.98


def plain_features(text):
    words = toxicity._WORDS.findall(text.lower())
    whole = [xxhash.xxh64_intdigest(f"0:{w}".encode()) for w in words]
    heads = [xxhash.xxh64_intdigest(f"{n}:{w[:n]}".encode()) for w in words for n in toxicity.HEADS if len(w) > n]
    mix, out = int(toxicity._MIX), whole + heads
    for gap in toxicity.GAPS:
        out += [((a * mix + b) * mix + gap) % 2**64 for a, b in zip(whole, whole[gap:], strict=False)]
    return set(toxicity._mixed(np.array(out, dtype=np.uint64)).tolist())


def test_features_are_words_heads_pairs_and_skips(monkeypatch):
    text = "You utter Fool, you_know; the écoles are closing and 12 more\nlines of words without an end " * 30
    read = toxicity.Features()
    assert set(read.of(text).tolist()) == plain_features(text)
    assert len(read.of("a b")) == 3 and len(read.of("")) == len(read.of(None)) == len(read.of(" -- ")) == 0
    monkeypatch.setattr(toxicity, "CHARS_AT_ONCE", 7)
    monkeypatch.setattr(toxicity, "WORDS_KNOWN", 3)
    assert set(toxicity.Features().of(text).tolist()) == plain_features(text)


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] for r in held if toxic[r["doc_id"]]]) >= 0.8
    assert np.mean([r["predicted"] for r in held if not toxic[r["doc_id"]]]) <= 0.01


def test_awkward_rows_of_toxicity(spark):
    taught = [(100 + i, f"you are a fool number {i}" if i % 2 else f"a good day number {i}", "en", "s") for i in range(60)]
    docs = frame(spark, AWKWARD + taught + [(900, "fool " + "good " * 300_000, "en", "s")], clashes=True)
    marks = [(i, 1, i % 2) for i in range(100, 160)] + [(None, 1, 1), (6, 1, None), (5, 1, 0), (5, 1, 1), (1, 1, 0), (4, 1, 7)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {(r["doc_id"], r["held_out"]): r for r in toxicity.scored(docs, labels).collect()}
    assert toxicity.scored(docs, labels).count() == docs.count()
    assert len({r["score"] for (i, _), r in got.items() if i in (1, 2, 3)}) == 1
    assert all(r["predicted"] == i % 2 for (i, _), r in got.items() if i is not None and 100 <= i < 160)
    untaught = toxicity.scored(docs, labels.limit(0)).collect()
    assert {r["score"] for r in untaught} == {0.5}
    assert toxicity.scored(docs.limit(0), labels).collect() == []
