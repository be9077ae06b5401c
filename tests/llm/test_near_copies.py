"""SimHash anchors, connected components, and fuzzy lines against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import AWKWARD, WORD, frame, given, groups_of
from tidemark.llm import line_dedup, simhash_anchors
from tidemark.llm.common import components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def near(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= 4


def test_fingerprints_and_components_of_given_documents(spark, small):
    docs = given(spark, small)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = groups_of(texts, [(i, j) for i in texts for j in texts if i < j and near(prints[i], prints[j])])
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash_anchors.near_copies(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in texts}


def test_fingerprint_in_blocks_is_the_whole_texts(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash_anchors.fingerprint(text)
    monkeypatch.setattr(simhash_anchors, "SHINGLES_AT_ONCE", 64)
    assert simhash_anchors.fingerprint(text) == whole == plain_fingerprint(text)


def random_prints(seed, n):
    draw = np.random.default_rng(seed)
    centres = draw.integers(-(2**63), 2**63, 20)
    out = {}
    for i in range(n):
        flips = draw.choice(64, size=draw.integers(0, 9), replace=False)
        out[i] = int(np.int64(centres[i % 20]) ^ np.bitwise_or.reduce([np.int64(0), *(np.left_shift(np.int64(1), np.int64(f)) for f in flips)]))
    return out


@pytest.mark.parametrize("tiles", [False, True])
def test_links_of_random_fingerprints(spark, monkeypatch, tiles):
    if tiles:  # every anchor is cut into tiles
        monkeypatch.setattr(simhash_anchors, "HOME_TILE", 2)
        monkeypatch.setattr(simhash_anchors, "COPY_TILE", 3)
    prints = random_prints(3, 300)
    first = {}
    for i, fp in prints.items():
        first.setdefault(fp, i)
    frame_ = spark.createDataFrame([(fp, i) for fp, i in first.items()], "fp long, rep long")
    found = [(r["a"], r["b"]) for r in simhash_anchors.linked_fingerprints(frame_).collect()]
    reps = list(first.values())
    want = groups_of(reps, [(i, j) for i in reps for j in reps if i < j and near(prints[i], prints[j])])
    assert groups_of(reps, found) == want


def test_anchors_cover_every_block():
    draw = np.random.default_rng(1)
    for _, bits in simhash_anchors.BLOCKS:
        flips = simhash_anchors._flips(bits)
        words = draw.integers(0, 1 << bits, 500).astype(np.uint64)
        of = simhash_anchors._syndrome(words)
        for word, s in zip(words, of, strict=True):
            anchors = word ^ flips[s]
            assert not simhash_anchors._syndrome(anchors).any()
            home = word ^ (np.uint64(1 << (int(s) - 1)) if s else np.uint64(0))
            assert home in anchors
            # a word one bit away is copied to this home
            other = word ^ np.uint64(1 << int(draw.integers(0, bits)))
            assert home in other ^ flips[simhash_anchors._syndrome(np.array([other]))[0]]


def test_awkward_rows_of_near_copies(spark):
    docs = frame(spark, AWKWARD, clashes=True)
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash_anchors.near_copies(docs).collect()]
    assert len(got) == len(AWKWARD)
    assert {c for i, fp, c in got if fp == 0} == {1}  # null and blank texts link, also of the row without an id
    assert [c for i, _, c in got if i == 6] == [6, 6]
    kept = simhash_anchors.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 6, 7]
    assert simhash_anchors.near_copies(docs.limit(0)).collect() == []


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (2, 1), (None, 3), (20, 21), (21, 5)]
    links += [(100, 100 + i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == groups_of({n for link in real for n in link}, real)
    assert components(df.limit(0), "a", "b").collect() == []


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def lines_removed(rows):
    """Brute force over all pairs: {doc_id: removed line numbers}."""
    places = [
        (i, n, line.strip(" ").lower()) for i, t in rows if i is not None for n, line in enumerate((t or "").split("\n"))
    ]
    places = sorted({p for p in places if p[2]}, key=lambda p: p[:2])
    distinct = sorted({p[2] for p in places})
    sets = [shingles(line) for line in distinct]
    links = []
    for i in range(len(sets)):
        for j in range(i):
            if 0.8 * max(len(sets[i]), len(sets[j])) <= min(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    links.append((i, j))
    group = groups_of(range(len(sets)), links)
    number = {line: i for i, line in enumerate(distinct)}
    seen, out = set(), {}
    for i, n, line in places:
        if group[number[line]] in seen:
            out.setdefault(i, set()).add(n)
        seen.add(group[number[line]])
    return out, len(links)


def decided(df):
    out = {}
    for r in line_dedup.line_decisions(df).where("not keep").collect():
        out.setdefault(r["doc_id"], set()).add(r["line_no"])
    return out


def test_fuzzy_lines_of_given_documents(spark, small):
    docs = given(spark, small)
    want, links = lines_removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = decided(docs)
    missed = sum(len(want[i] - got.get(i, set())) for i in want)
    assert links > 20 and not any(got[i] - want.get(i, set()) for i in got)
    assert missed <= 0.02 * links


@pytest.mark.parametrize("paired", [4096, 2])
def test_family_of_similar_lines_and_strangers(spark, monkeypatch, paired):
    monkeypatch.setattr(line_dedup, "PAIRED_ROWS", paired)  # 2: bands are split
    base = "all the lines of this family differ in one number only and are otherwise the same text {} for sure"
    rows = [(i, base.format(i), "en", "s") for i in range(60)] + [(100 + i, f"stranger {i * 7919} has {'xyzuvw'[i % 6] * 9} here", "en", "s") for i in range(20)]
    got = decided(frame(spark, rows))
    want, _ = lines_removed([(i, t) for i, t, _, _ in rows])
    assert got == want and len(got) >= 59


def test_awkward_rows_of_lines(spark):
    docs = frame(spark, AWKWARD, clashes=True)
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(AWKWARD)
    rows = [(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()]
    assert [t for i, t, _ in rows if i == 1] == [None] and [t for i, t, _ in rows if i == 3] == [" \n\t "]
    assert [t for i, t, _ in rows if i == 6] == [AWKWARD[7][1]] * 2
    assert line_dedup.line_decisions(docs.limit(0)).collect() == []
    twice = frame(spark, [(1, "one line here\n\nsecond line there", "en", "s"), (2, "ONE line here \nnew words follow", "en", "s"), (3, "second line there", "en", "s")])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.deduplicated(twice).collect()}
    assert got == {1: ("one line here\n\nsecond line there", 32), 2: ("new words follow", 16), 3: ("", 0)}


def test_short_numbered_and_unspaced_lines(spark):
    """Lines whose words or eight-character pieces mostly differ although their shingles are 0.8 similar."""
    texts = [f"{word} per page {i}" for word in ("items", "entries", "results shown") for i in range(8)]
    draw = np.random.default_rng(5)
    for _ in range(30):
        run = "".join(chr(0x4E00 + c) for c in draw.integers(0, 3000, 60))
        texts += [run, "x" + run]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    want, links = lines_removed([(i, t) for i, t, _, _ in rows])
    assert links >= 50 and decided(frame(spark, rows)) == want


def test_twins_in_one_hot_band(spark, monkeypatch):
    """Pairs of near-copies that share no band but one that all lines have."""
    monkeypatch.setattr(line_dedup, "PAIRED_ROWS", 8)
    monkeypatch.setattr(line_dedup, "_band_keys", lambda: F.array(F.lit(1).cast("long")))
    draw = np.random.default_rng(6)
    own = lambda: "".join(map(chr, draw.integers(97, 123, 6)))
    texts = []
    for _ in range(40):
        line = f"please note that this page with number {own()} was moved to the new place {own()} today"
        texts += [line, line + " " + own()]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    want, links = lines_removed([(i, t) for i, t, _, _ in rows])
    assert links >= 40 and decided(frame(spark, rows)) == want
