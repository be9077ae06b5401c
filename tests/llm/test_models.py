"""Language, quality and transcript models: held-out accuracy, awkward rows, exactness of the distributed parts."""

import itertools
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, frame, given

from tidemark.llm import lang_kernel, pu_quality, transcripts


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_of_held_out_documents(spark, small):
    docs = given(spark, small)
    model = lang_kernel.train(docs.where(~lang_kernel.held_out(docs["doc_id"])))
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = lang_kernel.predict(docs, model).collect()
    held = [r for r in rows if fold(r["doc_id"], 4) == 2]
    assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.9


def test_kernel_is_the_presence_kernel():
    texts = ["Die Katze sitzt auf dem Dach", "le chat est sur le toit", "the cat is on the roof"]
    rows = np.array([lang_kernel.presence(t) for t in texts])
    got = lang_kernel._normalised(rows) @ lang_kernel._normalised(rows).T
    width = lang_kernel.BUCKETS
    for i, j in itertools.product(range(3), repeat=2):
        want = []
        for n in range(len(lang_kernel.ORDERS)):
            a, b = (set(np.flatnonzero(rows[k][n * width : (n + 1) * width])) for k in (i, j))
            want.append(len(a & b) / (len(a) * len(b)) ** 0.5)
        assert got[i, j] == pytest.approx(np.mean(want), rel=1e-5)


def test_presence_in_pieces_is_the_whole_texts(monkeypatch):
    text = "Ein Satz mit 12 Zahlen, und noch einer; é und ß. " * 40
    whole = lang_kernel.presence(text)
    monkeypatch.setattr(lang_kernel, "CHARS_AT_ONCE", 97)
    assert (lang_kernel.presence(text) >= whole).all()  # a piece may end in a run of blanks that the whole text merges
    assert lang_kernel.presence("12 34 -- ½ _") is None and lang_kernel.presence("") is None and lang_kernel.presence(None) is None


def test_awkward_rows_of_language(spark):
    taught = [(50 + i, "the and of to in that was", "en", "s") for i in range(20)] + [(80 + i, "der die das und nicht ein", "de", "s") for i in range(20)]
    docs = frame(spark, AWKWARD + taught + [(8, "12345 -- !!", "en", "s")], clashes=True)
    model = lang_kernel.train(docs.where(~lang_kernel.held_out(docs["doc_id"])))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_kernel.predict(docs, model).collect()}
    assert [got[i] for i in (1, 2, 3, 8)] == [("und", 0.0)] * 4
    kept = lang_kernel.recognised(docs)
    assert kept.columns == docs.columns
    assert {1, 2, 3, 8}.isdisjoint({r["doc_id"] for r in kept.collect()})
    nothing = lang_kernel.train(docs.limit(0))
    assert {r["lang_pred"] for r in lang_kernel.predict(docs, nothing).collect()} == {"und"}
    assert lang_kernel.predict(docs.limit(0), model).collect() == []


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = pu_quality.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert np.mean([r["predicted"] == quality[r["doc_id"]] for r in held]) >= 0.95
    good = [r["score"] for r in held if quality[r["doc_id"]]]
    bad = [r["score"] for r in held if not quality[r["doc_id"]]]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_prior_and_risk_never_fit_below_zero():
    draw = np.random.default_rng(2)
    positive = draw.normal(2, 1, 4000)
    unlabelled = np.r_[draw.normal(2, 1, 6000), draw.normal(-2, 1, 4000)]
    assert pu_quality.estimated_prior(positive, unlabelled) == pytest.approx(0.6, abs=0.08)
    x = lambda v: np.c_[v / 4, np.ones(len(v))]
    weights = pu_quality._fit(x(positive), x(unlabelled), 0.6)
    values = x(unlabelled) @ weights
    truth = np.r_[np.ones(6000), np.zeros(4000)]
    assert np.mean((values > 0) == truth) >= 0.95


def test_awkward_rows_of_quality(spark):
    docs = frame(spark, AWKWARD, clashes=True)
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = pu_quality.scored(docs, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    unlearnt = pu_quality.scored(docs, labels.limit(0)).collect()
    assert {r["score"] for r in unlearnt} == {0.5}
    assert pu_quality.scored(docs.limit(0), labels).collect() == []


def whole_path(rows, emission, transition):
    """Plain Viterbi over a conversation at once."""
    steps = transcripts._steps(rows)
    return transcripts.decode_chunk(rows, transcripts.START, best_end(steps, emission, transition), emission, transition)


def best_end(steps, emission, transition):
    score = np.where(np.arange(transcripts.START + 1) == transcripts.START, 0.0, -np.inf)
    for o, change in steps:
        score = ((score[:, None] + transition).max(axis=0) if change else score) + emission[o]
    return int(score[: transcripts.START].argmax())


def test_chunks_decode_like_the_whole():
    draw = np.random.default_rng(4)
    emission = transcripts._emissions(draw.integers(0, 50, (3, transcripts.CODES)).astype(float))
    transition = transcripts._transitions(np.array([5.0, 9, 1]), draw.integers(0, 50, (3, 3)).astype(float))
    for _ in range(20):
        rows = [list(draw.integers(0, 4 * transcripts.CODES, draw.integers(1, 6))) for _ in range(30)]
        chunks = [rows[i : i + 7] for i in range(0, 30, 7)]
        ends = transcripts.borders([transcripts.reduce_chunk(c, emission, transition) for c in chunks])
        parts = [transcripts.decode_chunk(c, a, b, emission, transition) for c, (a, b) in zip(chunks, ends, strict=True)]
        assert list(itertools.chain(*parts)) == whole_path(rows, emission, transition)


def test_roles_of_held_out_conversations(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    truth = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in rows.collect()}
    got = transcripts.recovered(rows).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["roles"][0] == truth[r["conv_id"], r["turn"]][0] for r in held]) >= 0.95
    for r in got[:50]:
        text = truth[r["conv_id"], r["turn"]][1]
        assert r["rendered"] == f"<|{r['roles'][0]}|>\n{text.strip()}\n<|end|>"
    monkeypatch.setattr(transcripts, "CHUNK", 2)
    again = {(r["conv_id"], r["turn"]): r["roles"] for r in transcripts.recovered(rows).collect()}
    assert again == {(r["conv_id"], r["turn"]): r["roles"] for r in got}


def test_awkward_transcripts(spark):
    script = "System: be brief\nHuman: what is it?\nand where\n**Assistant:** a thing\n- here\nUser> thanks"
    rows = [
        (1, 0, None, script), (2, None, "user", None), (None, 3, "user", "no conversation"), (None, None, None, None),
        (3, 0, "user", "same row"), (3, 0, "user", "same row"), (3, 0, "assistant", "tie of a turn"), (4, 1, "nobody", "word " * 40_000),
    ]
    df = spark.createDataFrame([(c, t, r, x, 1, 2, 3) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, conv int, at int, th int")
    got = {(r["conv_id"], r["turn"]): r for r in transcripts.recovered(df).collect()}
    assert transcripts.recovered(df).count() == len(rows)
    assert got[1, 0]["roles"] == ["system", "user", "assistant", "user"]
    assert got[1, 0]["rendered"] == (
        "<|system|>\nbe brief\n<|end|>\n<|user|>\nwhat is it?\nand where\n<|end|>\n<|assistant|>\na thing\n- here\n<|end|>\n<|user|>\nthanks\n<|end|>"
    )
    assert len(got[2, None]["roles"]) == 1
    assert transcripts.recovered(df.limit(0)).collect() == []


def test_untaught_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    strange = [
        "Это обычный русский текст, которому никто не учил, и он достаточно длинный. " * 3, "這是一個中文的句子,沒有人教過這種語言",
        "これは誰も教えていない言語で書かれた普通の文です", "Zażółć gęślą jaźń, to jest zwykły polski tekst o niczym szczególnym. " * 3, "x y z q w k j v",
    ]
    more = frame(spark, [(10**9 + i, t, None, "s") for i, t in enumerate(strange)])
    kept = {r["doc_id"] for r in lang_kernel.recognised(docs.unionByName(more)).select("doc_id").collect()}
    assert not any(i >= 10**9 for i in kept)
    clean = [r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    assert len(set(clean) - kept) <= 0.002 * len(clean)


def test_language_of_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    held = {}
    for r in docs.collect():
        if r["lang"] and r["text"] and fold(r["doc_id"], 4) == 2:
            held.setdefault(r["lang"], []).append(r["text"])
    long = [(i, ("\n".join(texts) * 100)[:2_000_000], lang, "s") for i, (lang, texts) in enumerate(sorted(held.items()))]
    model = lang_kernel.train(docs.where(~lang_kernel.held_out(docs["doc_id"])))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_kernel.predict(frame(spark, long), model).collect()}
    assert all(got[i][0] == lang and got[i][1] > 0.8 for i, _, lang, _ in long)
    taught = lang_kernel.train(frame(spark, long))  # texts of many windows teach as well
    rows = lang_kernel.predict(frame(spark, long), taught).collect()
    assert [r["lang_pred"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [lang for _, _, lang, _ in long]
