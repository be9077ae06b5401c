"""Token mix and the whole pipeline against brute force."""

import hashlib
import importlib
import sys
from collections import defaultdict

import corpus_pipeline
import pytest
from helpers import AWKWARD, WORD, frame, groups_of
from pyspark.sql import functions as F
from test_near_copies import lines_removed, near, plain_fingerprint
from test_texts import word_shingles

from tidemark.llm import mixing, production
from tidemark.llm.common import stored


def poured(budget, children):
    """Deal a budget to {name: (weight, capacity)} by filling children one after the other."""
    left, out = dict(children), {}
    while left:
        total = sum(w for w, _ in left.values())
        full = [c for c, (w, cap) in left.items() if budget * w >= cap * total]
        if not full:
            out |= {c: min(cap, budget * w // total) for c, (w, cap) in left.items()}
            break
        one = min(full, key=lambda c: (left[c][1] / left[c][0], c))
        out[one] = left.pop(one)[1]
        budget -= out[one]
    return out


def weight(level, name):
    return production.MIX_WEIGHTS[level].get(name, 1)


def chosen(rows, share=production.MIX_SHARE, epochs=production.MIX_EPOCHS, seed=production.MIX_SEED):
    """Brute force: sorted (doc_id, epoch) for rows (doc_id, domain, lang, source, tokens)."""
    tokens, members = defaultdict(int), defaultdict(list)
    for i, *leaf, n in rows:
        tokens[tuple(leaf)] += n
        members[tuple(leaf)].append((i, n))
    budgets = {(): int(sum(tokens.values()) * share)}
    for depth, level in enumerate(mixing.LEVELS):
        nodes = defaultdict(int)
        for leaf, n in tokens.items():
            nodes[leaf[: depth + 1]] += n * epochs
        for parent, budget in list(budgets.items()):
            if len(parent) == depth:
                dealt = poured(budget, {c: (weight(level, c[-1]), cap) for c, cap in nodes.items() if c[:depth] == parent})
                budgets |= dealt
    out = []
    for leaf, n in tokens.items():
        whole, rest = divmod(budgets[leaf], n)
        out += [(i, e) for i, _ in members[leaf] for e in range(whole)]
        for i, size in sorted(members[leaf], key=lambda m: (hashlib.md5(f"{seed}:{whole}:{m[0]}".encode()).hexdigest(), m[0])):
            rest -= size
            if rest < 0:
                break
            out.append((i, whole))
    return sorted(out), budgets


def domain(source):
    digits = "".join(c for c in source[::-1][: len(source) - len(source.rstrip("0123456789"))])[::-1]
    return ("web", "books", "code")[int(digits) % 3] if digits else "unknown"


def rows_of(docs):
    out = [(i, domain(so or ""), la or "unknown", so or "unknown", len(WORD.findall(t or ""))) for i, t, la, so in docs]
    return [r for r in out if r[0] is not None and r[4]]


@pytest.mark.parametrize("share", [0.05, 0.5, 1.3, 5.0])
def test_mix_of_given_documents(spark, small, share):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = rows_of([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()])
    sized = mixing.sized_documents(docs, production.domain_of_source(F.col("source")))
    got = mixing.choose(sized, share, production.MIX_WEIGHTS, production.MIX_SEED, max_epochs=2).collect()
    want, _ = chosen(rows, share)
    assert sorted((r["doc_id"], r["epoch"]) for r in got) == want


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "s1", 10), ("web", "en", "s2", 1000), ("web", "de", "s1", 1000), ("code", "en", "s1", 5)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {tuple(r)[:3]: r["budget"] for r in mixing.budgets(df, 400, {}, max_epochs=1).collect()}
    # code can take 5 of its 200: 395 for web, 197 for each language; s1 can take 10 of its 98, s2 gets the rest
    assert got == {("web", "en", "s1"): 10, ("web", "en", "s2"): 187, ("web", "de", "s1"): 197, ("code", "en", "s1"): 5}


def test_awkward_rows_of_the_mix(spark):
    docs = frame(spark, AWKWARD, clashes=True)
    out = mixing.mixed(docs, production.domain_of_source(F.col("source")), 2.0, production.MIX_WEIGHTS)
    assert out.columns == [*docs.columns, "mix_epoch"]
    assert sorted((r["doc_id"], r["mix_epoch"]) for r in out.collect()) == sorted([(i, e) for i in (4, 5, 6, 6, 7) for e in (0, 1)])
    assert mixing.mixed(docs.limit(0), F.lit("d"), 0.5, {}).collect() == []
    named = docs.withColumn("mix_epoch", F.lit(1))
    assert mixing.mixed(named, F.lit("d"), 0.5, {}).columns[-1] == "_mix_epoch"


def test_pipeline_stages_against_brute_force(spark, small):
    """Each stage after the language model is computed again in plain Python from that stage's own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda df: [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.orderBy("doc_id").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    given_columns = docs.columns
    before = rows(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), f"test-{name}")
        if name == "mix":
            got = sorted((r["doc_id"], r["mix_epoch"]) for r in docs.collect())
            assert got == chosen(rows_of(before))[0]
            break
        assert docs.columns == given_columns
        after = rows(docs)
        if name == "language":
            assert {r[0] for r in after} == {i for i, t, _, _ in before if any(map(str.isalpha, t or ""))}
        if name == "lines":
            gone, _ = lines_removed([(i, t) for i, t, _, _ in before])
            want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t, _, _ in before}
            wrong = [i for i, t, _, _ in after if t != want[i]]
            assert len(after) == len(before) and len(wrong) <= 2
        if name == "near_copies":
            prints = {i: plain_fingerprint(t) for i, t, _, _ in before}
            group = groups_of(prints, [(i, j) for i in prints for j in prints if i < j and near(prints[i], prints[j])])
            assert after == [r for r in before if group[r[0]] == r[0]]
        if name == "decontamination":
            wanted = [word_shingles(t) for t in items]
            leaks = {i for i, t, _, _ in before if any(w and len(w & word_shingles(t)) >= 0.8 * len(w) for w in wanted)}
            assert leaks and after == [r for r in before if r[0] not in leaks]
        before = after


def test_entry_without_this_subpackage(monkeypatch):
    """Where the folder is not there the other queries still load; a fault inside it is not hidden."""
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and sum(name.startswith("op") and name[2].isdigit() for name in entry.queries()) == 13
    with monkeypatch.context() as patch:
        for name in [m for m in sys.modules if m.startswith("tidemark.llm")]:
            patch.delitem(sys.modules, name)
        real = importlib.import_module

        def absent(name, *args):
            if name == "tidemark.llm":
                raise ModuleNotFoundError(name=name)
            return real(name, *args)

        patch.setattr(importlib, "import_module", absent)
        assert "pipeline" not in entry.queries() and "status_histogram" in entry.queries()

        def broken(name, *args):
            if name == "tidemark.llm":
                raise ModuleNotFoundError(name="xxhash")
            return real(name, *args)

        patch.setattr(importlib, "import_module", broken)
        with pytest.raises(ModuleNotFoundError):
            entry.queries()


