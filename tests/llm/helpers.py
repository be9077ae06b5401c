"""Small tables with awkward rows, and plain reference computations."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside
CLASHES = (
    "h", "line", "line_no", "key", "fp", "rep", "tag", "start", "stop", "row", "host", "answer", "epoch", "tokens", "domain",
    "a", "b", "component", "leak_id", "gone_id", "gone_lines", "dropped_id", "taken_id", "bits", "shingle", "item_id",
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, clashes=False):
    """Documents from (doc_id, text, lang, source) tuples, with columns of clashing names if asked."""
    df = spark.createDataFrame([(i, t, la, so, None if t is None else len(t)) for i, t, la, so in rows], SCHEMA)
    if clashes:
        df = df.selectExpr("*", *[f"'x' AS {name}" for name in CLASHES])
    return df


def given(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


AWKWARD = [
    (1, None, "en", "s1"),
    (2, "", "en", "s1"),
    (3, " \n\t ", None, "s1"),
    (4, "only three words", "en", None),
    (None, "a row without an id has a text as well as any other row here", "en", "s1"),
    (None, None, None, None),
    (5, "word " * 60_000, "en", "s2"),
    (6, "the same text stands in two rows of one id\nand a second line", "en", "s2"),
    (6, "the same text stands in two rows of one id\nand a second line", "en", "s2"),
    (7, "ünïcödé wörds — and signs \U0001f600 in a text", "de", "s2"),
]


def groups_of(nodes, links):
    """Least member that each node reaches over links."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
