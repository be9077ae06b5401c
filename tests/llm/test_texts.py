"""Run-length index, quality rules, secrets and contamination against brute force."""

import base64
import hashlib
import json
import re
from collections import Counter

from helpers import AWKWARD, WORD, frame, given
from tidemark.llm import contamination, line_frequency, run_index, secret_scan


def plain_cut(rows):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} by looking every string up."""
    least = {}
    for i, t in sorted(rows):
        raw = t.encode()
        for p in range(len(raw) - 49):
            least.setdefault(raw[p : p + 50], i)
    out = {}
    for i, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not before for before, g in zip(b"\0" + bytes(gone), gone, strict=False))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def cuts(df):
    return {r["doc_id"]: tuple(r)[1:] for r in run_index.deduplicated(df).collect()}


def test_repeats_of_given_documents(spark, small):
    docs = given(spark, small)
    assert cuts(docs) == plain_cut([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeats_in_cuts_and_slices(spark, monkeypatch):
    """Small limits: long texts are cut, batches flushed and suffixes sorted in many slices."""
    monkeypatch.setattr(run_index, "BYTES_AT_ONCE", 300)
    monkeypatch.setattr(run_index, "SORTED_AT_ONCE", 40)
    seed = "".join(chr(97 + i * i % 23) for i in range(400))
    other = "".join(chr(65 + i * 7 % 19) for i in range(90)) + "éß\x00"
    texts = [seed, seed[100:260] + other, other * 12, "x" * 500, "x" * 130 + seed[:60], seed[5:54], seed[5:55], other + seed[::-1], seed + other]
    rows = [(i * 3 + 1, t, "en", "s") for i, t in enumerate(texts)]
    assert cuts(frame(spark, rows)) == plain_cut([(i, t) for i, t, _, _ in rows])


def test_awkward_rows_of_repeats(spark):
    docs = frame(spark, AWKWARD, clashes=True)
    got = [tuple(r) for r in run_index.deduplicated(docs).collect()]
    assert len(got) == len(AWKWARD)
    assert [r[1:4] for r in got if r[0] == 1] == [(0, 0, 0)]
    assert [r[2] for r in got if r[0] in (5, 6)] == [0, 0, 0]  # repeats inside a document, or under its own id, stay
    assert run_index.deduplicated(docs.limit(0)).collect() == []
    shared = "this passage of well over fifty bytes is in both of the documents"
    pair = frame(spark, [(8, shared + " first", "en", "s"), (9, "second: " + shared, "en", "s"), (9, "of one id, but without it", "en", "s")])
    assert sorted(bytes(r["kept"]) for r in run_index.remaining_bytes(pair).collect()) == [
        b"of one id, but without it", b"second: ", (shared + " first").encode(),
    ]


def plain_statistics(t):
    t = t or ""
    words, seen, again = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        again += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), again, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_line_frequency(spark):
    boiler = "Subscribe to our letter number {} today"
    body = " ".join(f"word{i}" for i in range(30))
    rows = [(300 + i, f"{body} {i}\n{boiler.format(i)}", "en", "a") for i in range(25)]
    rows += [(100 + i, f"{boiler.format(i)}\n{boiler.format(i + 1)}\nfour words of own", "en", "a") for i in range(5)]
    rows += [(200, f"{boiler.format(1)}\n{boiler.format(2)}\nfour words of own", "en", "other"), (201, boiler.format(3) + "\nfour words of own, twice", "en", None)]
    docs = frame(spark, rows + AWKWARD, clashes=True).drop("host").withColumnRenamed("source", "host")
    got = [tuple(r) for r in line_frequency.judged(docs, host="host").collect()]
    assert len(got) == len(rows) + len(AWKWARD)
    by_id = {r[0]: r for r in got if r[0] is not None}
    for i, t, _, _ in rows + AWKWARD:
        if i is not None:
            assert by_id[i][1:7] == plain_statistics(t), i
    assert all(by_id[300 + i][8] and by_id[300 + i][7] == 31 for i in range(25))  # the body stays
    assert not any(by_id[100 + i][8] for i in range(5))  # depleted
    assert by_id[200][8] and by_id[201][8]  # the limit is one host's
    assert line_frequency.judged(docs.limit(0), host="host").collect() == []


def test_statistics_of_given_documents(spark, small):
    docs = given(spark, small)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in line_frequency.judged(docs).collect():
        assert tuple(r)[1:7] == plain_statistics(texts[r["doc_id"]])


def test_texts_without_frequent_lines(spark):
    many = line_frequency.MAX_DOCUMENTS + 1
    rows = [(i, f"own words of {chr(97 + i)}\n\nAll rights reserved {10 + i}", "en", "s1") for i in range(many)]
    rows += [(100, "All rights reserved 11\nmore", "en", "s2"), (101, None, "en", "s1"), (None, "All rights  reserved 15", "en", "s1")]
    got = {r["doc_id"]: r["text"] for r in line_frequency.without_frequent_lines(frame(spark, rows)).collect()}
    want = {i: f"own words of {chr(97 + i)}\n" for i in range(many)}
    assert got == want | {100: "All rights reserved 11\nmore", 101: None, None: ""}


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def field(b):
    return len(b).to_bytes(4, "big") + b


def kinds(text):
    return [(secret_scan.KINDS[k], text[a:b]) for a, k, b in secret_scan.spans_of(text)]


def test_structural_secrets():
    number = lambda n: der(2, bytes(range(1, n + 1)))
    rsa = base64.b64encode(der(0x30, der(2, b"\0") + number(120) + number(3) + number(100))).decode()
    ssh = base64.b64encode(field(b"ssh-ed25519") + field(bytes(range(32)))).decode()
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "me"})) + ".c2ln"
    wrapped = "\n".join(rsa[i : i + 64] for i in range(0, len(rsa), 64))
    assert kinds(f"é key {rsa} end") == [("der", rsa)]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{wrapped}\n-----END RSA PRIVATE KEY-----") == [("der", wrapped)]
    assert kinds(f"{wrapped}\nWords follow at once") == [("der", wrapped)]
    assert kinds(f"ssh-ed25519 {ssh} me@host") == [("ssh", ssh)]
    assert kinds(f"cookie {token}") == [("jwt", token)]
    hexed = base64.b64decode(rsa).hex()
    assert kinds(f"raw {hexed}") == [("hex", hexed), ("der", hexed)]
    # random runs, broken lengths and headers without an algorithm are not reported
    noise = base64.b64encode(hashlib.sha512(b"x").digest()).decode()
    assert kinds(f"{noise} {rsa[:-8]}") == []
    assert kinds("eyJ4IjoxfQ.eyJ4IjoxfQ.x") == []


def test_wrapped_keys_and_token_headers():
    number = lambda n: der(2, bytes(range(1, n + 1)))
    rsa = base64.b64encode(der(0x30, der(2, b"\0") + number(120) + number(3) + number(100))).decode()
    lines = [rsa[i : i + 64] for i in range(0, len(rsa), 64)]
    for gap in ("\n\t\t", "\n" + " " * 8, "\\n", "\\r\\n", '\\n" +\n    "', '"\n  "', '",\n "', "\n> ", "\r\n\t"):
        body = gap.join(lines)
        assert kinds(f"-----BEGIN RSA PRIVATE KEY-----{gap}{body}{gap}-----END RSA PRIVATE KEY-----") == [("der", body)], gap
    assert [k for k, _ in kinds(f"{rsa}\n\n{rsa}")] == ["der", "der"]
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    for head in (b'{ "alg": "HS256"}', b'{\n "alg": "HS256"}', b'\n{"alg": "HS256"}'):
        token = f"{part(head)}.{part(b'{ }')}.c2ln"
        assert kinds(f"cookie {token}") == [("jwt", token)]


BASE = (
    re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
)


def plain_base(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in BASE[0].finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in BASE[1].finditer(t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in BASE[2].finditer(t) if len(m[0]) >= 24]
    named = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return hashlib.sha256(named.encode()).hexdigest()


def test_base_spans(spark, small):
    rows = AWKWARD + [
        (20, "é\U0001f600 Password = 'abc123' tokenSECRET:xyzxyz0 api_key\":\"short\" APIKEY=longer-one.", "en", "s"),
        (21, "AKIA" + "A1" * 8 + " AKIAshort " + "0123456789abcdef" * 2 + "G" + "a" * 23, "en", "s"),
    ]
    docs = frame(spark, rows, clashes=True)
    texts = {i: t for i, t, _, _ in rows}
    got = secret_scan.scanned(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["base_sha256"] == plain_base(texts[r["doc_id"]])
    counts = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in got}
    assert counts[20] == (3, 0, 0) and counts[21] == (0, 1, 1)
    assert secret_scan.scanned(docs.limit(0)).collect() == []
    given_docs = given(spark, small)
    texts = {r["doc_id"]: r["text"] for r in given_docs.collect()}
    assert all(r["base_sha256"] == plain_base(texts[r["doc_id"]]) for r in secret_scan.scanned(given_docs).collect())


def word_shingles(t):
    words = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_contained_items(spark):
    item = " ".join(f"item{i}" for i in range(24))
    short = "seven words make up this short item"
    filler = " ".join(f"filler{i}" for i in range(3000))
    changed = item.replace("item2 ", "other ")  # 3 of 20 shingles differ
    half = " ".join(item.split()[:12])
    rows = [
        (10, f"{filler} {item.upper()}, {filler}", "en", "s"),
        (11, f"{filler} {changed} {filler}", "en", "s"),
        (12, f"{half} {filler}", "en", "s"),
        (13, f"{short}.", "en", "s"),
        (14, "so short", "en", "s"),
        (15, f"so short {filler}", "en", "s"),
    ]
    items = [(1, item), (2, short), (3, "so short"), (4, None), (5, " "), (None, filler), (6, item)]
    docs = frame(spark, rows + AWKWARD, clashes=True)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS h", "2 AS bits", "3 AS doc_id")
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in contamination.contained_items(docs, bench).collect()}
    want = {}
    for i, t, _, _ in rows + AWKWARD:
        for k, it in items:
            if i is not None and k is not None:
                a, b = word_shingles(t), word_shingles(it)
                if b and len(a & b) >= 0.8 * len(b):
                    want[i, k] = (len(b), len(a & b))
    assert got == want and {(10, 1), (11, 1), (13, 2), (14, 3), (10, 6)} <= set(got)
    kept = contamination.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 6, 7, 12, 15]
    assert contamination.contained_items(docs.limit(0), bench).collect() == []
    assert contamination.contained_items(docs, bench.limit(0)).collect() == []
