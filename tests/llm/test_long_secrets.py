"""Secrets in long wrapped texts: every wrapped form in bounded time, keys found behind other lines."""

import base64
import hashlib
import time

import pytest

from tidemark.llm import secret_scan
from tidemark.llm.line_frequency import line_hash

GAPS = {"tab": "\n\t", "deep": "\n" + " " * 9, "plain": "\n", "quotes": '" +\n    "', "escape": "\\n", "mail": "\n> ", "return": "\r\n"}


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else b"\x82" + size.to_bytes(2, "big")
    return bytes([tag]) + head + body


KEY = base64.b64encode(der(0x30, der(2, b"\0") + der(2, bytes(range(1, 121))) + der(2, bytes(range(1, 101))))).decode()
LINES = [KEY[i : i + 64] for i in range(0, len(KEY), 64)]


def random_lines(chars, seed):
    digests, i = [], 0
    while len(digests) * 64 < chars:
        digests.append(base64.b64encode(hashlib.sha512(f"{seed}{i}".encode()).digest()[:48]).decode())
        i += 1
    return digests


@pytest.mark.parametrize("gap", GAPS.values(), ids=GAPS.keys())
def test_two_megabytes_of_wrapped_lines(gap):
    for lines in (random_lines(2_000_000, "x"), ["A" * 64] * 30_000, ["MIMP" + "A" * 60] * 30_000):
        text = gap.join([*lines, *LINES])
        start = time.perf_counter()
        found = secret_scan.spans_of(text)
        assert time.perf_counter() - start < 6  # the old search took minutes for a tenth of it
        assert [(secret_scan.KINDS[k], text[a:b]) for a, k, b in found] == [("der", gap.join(LINES))]


def test_long_run_before_a_point():
    text = "".join(random_lines(1_000_000, "y")).replace("+", "-").replace("/", "_") + ".abc.def"
    start = time.perf_counter()
    secret_scan.spans_of(text)
    assert time.perf_counter() - start < 6


def test_hex_keys_begin_any_line():
    body = base64.b64decode(KEY).hex()
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = (field(b"ssh-ed25519") + field(bytes(range(32)))).hex()
    text = f"{'ab' * 20}\n{body}\nand {ssh}"
    confirmed = [(secret_scan.KINDS[k], text[a:b]) for a, k, b in secret_scan.spans_of(text) if k > 2]
    assert confirmed == [("der", body), ("ssh", ssh)]


def test_numbers_of_any_length_are_one():
    assert line_hash("Page 7 of 12".split()) == line_hash("page 107  of 9".split()) != line_hash("page of".split())
