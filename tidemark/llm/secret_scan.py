"""Secret scan with structural confirmation.

Base spans come from three patterns (assignments, access key ids, long hex runs). The method's own spans are runs of
base64 or hex characters that, once decoded, have the structure of a key:

    jwt   three dotted parts; the header is a JSON object with a string ``alg``, the payload a JSON object
    der   an ASN.1 SEQUENCE whose nested lengths fill it exactly and that begins like a key: a version number or an
          algorithm identifier
    ssh   length-prefixed fields that fill the data exactly, the first a known key type; or the private key container

The lines of a wrapped key may be indented, quoted or ended by escapes; each wrapped body is decoded once, and every line that begins in
it is looked at as the start of a key. A run that only looks random is not reported. Texts are mapped to one byte per code point, so that long runs are found by a byte
search and offsets count code points. Each text is scanned by itself in the task that reads it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fields

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
BASE_KINDS = KINDS[:3]
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24
# Shortest run that can hold a key: 24 bytes in base64 or hex.
MIN_RUN = 32
# Names of assigned secrets, key types and the private key container of SSH.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SSH_TYPES = (
    b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521",
)
SSH_CONTAINER = b"openssh-key-v1\x00"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a header of 10 bytes at least, tried wherever a brace may begin in it
_SIGNED = re.compile(rb"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)(?=\.([A-Za-z0-9_-]+\.[A-Za-z0-9_-]*))")
_BRACE = re.compile(rb"^|e[wy]")
# what may stand between the lines of a wrapped key: line ends as escapes, quotes with a sign, marks of quoted mail
_ESCAPED = ((b"\\n", b" \n"), (b"\\r", b"  "), (b"\\t", b"  "))
_QUOTED = re.compile(rb"""["'][ \t]*[+,.]?[ \t]*\r?\n[ \t]*["']|\r?\n(?=[ \t]*>)[ \t>]+""")
_WRAPPED = re.compile(rb"x{%d,}(?:(?:[ \t]*\r?\n)+[ \t]*x+)*={0,2}" % MIN_RUN)
_RUN = re.compile(rb"x{%d,}={0,2}" % MIN_RUN)


def _mark(members: bytes) -> bytes:
    """Translation of members to ``x``; blanks, line ends and ``=`` stay, all else becomes a point."""
    return bytes(120 if b in members else b if b in b" \t\r\n=" else 46 for b in range(256))


_HEX = bytes(120 if b in b"0123456789abcdef" else 46 for b in range(256))
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
# keys in the plain alphabet may be wrapped over lines, those in the alphabet for addresses may not
_ALPHABETS = ((_mark(_LETTERS + b"+/"), True), (_mark(_LETTERS + b"-_"), False))
# how a key begins in hex: a SEQUENCE, the length of a key type, the container's name
_HEADS_HEX = re.compile(rb"(?i)30|000000|6f70656e")
_OTHERS = re.compile(rb"[^0-9A-Fa-f]")
_HEX_RUN = re.compile(rb"x{%d,}" % MIN_HEX)


def _der_items(data: bytes, at: int, stop: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, stop) of the values that fill ``data[at:stop]`` exactly; None where lengths do not fit."""
    items = []
    while at < stop:
        if at + 2 > stop:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > stop:
                return None
            size = int.from_bytes(data[at : at + more], "big")
            at += more
        if at + size > stop:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def _declared(data: bytes, at: int) -> int:
    """Bytes of the ASN.1 SEQUENCE that begins at ``at``, its head included; 0 where none does."""
    if data[at : at + 1] != b"\x30" or at + 2 > len(data):
        return 0
    more = data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0
    if more > 4:
        return 0
    return 2 + more + (int.from_bytes(data[at + 2 : at + 2 + more], "big") if more else data[at + 1])


def is_der_key(data: bytes, at: int, stop: int) -> bool:
    """Whether ``data[at:stop]`` is one SEQUENCE that begins like a key and whose lengths fill it."""
    outer = _der_items(data, at, stop) if data[at : at + 1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = _der_items(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2:
        return False
    tag, start, stop = inner[0]
    if tag == 0x02:
        # a version of one byte, then a key's numbers, octets or algorithm; or the two numbers of a public key
        version = stop - start == 1 and data[start] <= 3 and inner[1][0] in (0x02, 0x04, 0x30)
        return version or (len(inner) == 2 and inner[1][0] == 0x02 and stop - start >= 32)
    if tag == 0x30:
        named = _der_items(data, start, stop)
        return bool(named) and named[0][0] == 0x06 and inner[1][0] == 0x03
    return False


def ssh_key_end(data: bytes, at: int, stops: list[int]) -> int | None:
    """The first of ``stops`` that an SSH key or private key container at ``at`` can end at; None if there is none."""
    container = data.startswith(SSH_CONTAINER, at)
    place, fields, ends = at + len(SSH_CONTAINER) * container, 0, set()
    while place + 4 <= max(stops):
        size = int.from_bytes(data[place : place + 4], "big")
        if not container and fields == 0 and data[place + 4 : place + 4 + size] not in SSH_TYPES:
            return None
        if container and fields == 3:  # after cipher, key derivation and its options
            return next((stop for stop in stops if place + 4 <= stop), None)
        place, fields = place + 4 + size, fields + 1
        if fields > 1:
            ends.add(place)
    return None if container else next((stop for stop in stops if stop in ends), None)


def is_signed_token(token: bytes) -> bool:
    head = base64.urlsafe_b64decode(token[:16] + b"=" * (-len(token[:16]) % 4)) if b"." not in token[:16] else b""
    if re.match(rb"\s*\{\s*[^\s\"]", head):  # a long run is not decoded for each brace in it
        return False
    for place, part in enumerate(token.split(b".")[:2]):
        if len(part) % 4 == 1:
            return False
        try:
            value = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or (place == 0 and not isinstance(value.get("alg"), str)):
            return False
    return True


class _Body:
    """A run of base64 or hex characters, over one line or several; decoded once for each way its characters may pair up."""

    def __init__(self, source: bytes, marked: bytes, start: int, end: int):
        self.marked, self.end = marked, end
        # places of the characters in the text, blanks and line ends left out
        self.places = np.flatnonzero(np.frombuffer(marked, np.uint8, end - start, start) == 120) + start
        self.chars = np.frombuffer(source, np.uint8)[self.places].tobytes().replace(b"-", b"+").replace(b"_", b"/")
        self.opens = np.flatnonzero(np.diff(self.places, prepend=-2) > 1)  # characters that begin a line
        self.views: dict[tuple[int, int], bytes] = {}

    def _view(self, per_char: int, first: int) -> bytes:
        """The bytes of all characters from ``first`` on; ``per_char`` is 6 (base64) or 4 bits (hex)."""
        if (per_char, first) not in self.views:
            chars = self.chars[first:]
            if per_char == 4:
                chars = _OTHERS.sub(b"0", chars[: len(chars) // 2 * 2])
                self.views[per_char, first] = bytes.fromhex(chars.decode())
            else:
                chars = chars[: len(chars) - (len(chars) % 4 == 1)]
                self.views[per_char, first] = base64.b64decode(chars + b"=" * (-len(chars) % 4))
        return self.views[per_char, first]

    def keys(self) -> Iterator[tuple[int, int, int]]:
        """(start, kind, end) of the keys that begin a line, one after the other."""
        past, line_ends = 0, [*self.opens[1:].tolist(), len(self.chars)]
        for open_, line_end in zip(self.opens.tolist(), line_ends, strict=True):
            if open_ >= past and line_end - open_ >= MIN_RUN and (found := self._key(open_, line_end)):
                kind, past = found
                end = int(self.places[past - 1]) + 1
                while end < self.end and self.marked[end : end + 1] == b"=":
                    end += 1
                yield int(self.places[open_]), kind, end

    def _key(self, first: int, line_end: int) -> tuple[int, int] | None:
        """(kind, character after the last) of the key that begins at a character."""
        for bits, group, size in ((4, 2, 1), (6, 4, 3)):
            if bits == 4 and not _HEADS_HEX.match(self.chars, first):
                continue
            data, at = self._view(bits, first % group), first // group * size
            total = _declared(data, at)
            stop = first + -(-total * 8 // bits)
            if total and stop <= len(self.chars) and self._plain(bits, first, stop) and is_der_key(data, at, at + total):
                return 4, stop
            # an SSH key does not say its length: it ends with the body or with the line
            ends = [e for e in (len(self.chars), line_end) if (e - first) % 4 != 1 and (bits == 6 or (e - first) % 2 == 0)]
            stops = [at + (e - first) * bits // 8 for e in ends]
            stop = ssh_key_end(data, at, stops) if ends else None
            if stop is not None and self._plain(bits, first, ends[stops.index(stop)]):
                return 5, ends[stops.index(stop)]
        return None

    def _plain(self, bits: int, first: int, stop: int) -> bool:
        return bits == 6 or not _OTHERS.search(self.chars, first, stop)


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) in order; offsets in code points, the end exclusive."""
    if not text:
        return []
    points = text.encode("latin-1", "replace")
    found = []
    lowered = points.lower()
    if any(name in lowered for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if b"AKIA" in points:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    marked = points.translate(_HEX)
    if b"x" * MIN_HEX in marked:
        found += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(marked)]
    past = 0
    for m in _SIGNED.finditer(points):
        for brace in _BRACE.finditer(m[1]):
            start = m.start() + brace.start()
            if start >= past and is_signed_token(points[start : m.end(2)]):
                found.append((start, 3, past := m.end(2)))
                break
    plain = points
    for escape, blank in _ESCAPED:
        plain = plain.replace(escape, blank)
    plain = _QUOTED.sub(lambda m: b" " * (len(m[0]) - m[0].count(b"\n")) + b"\n", plain) if b"\n" in plain else plain
    keys: dict[int, tuple[int, int, int]] = {}
    for alphabet, wrapped in _ALPHABETS:
        source = plain if wrapped else points
        marked = source.translate(alphabet)
        if b"x" * MIN_RUN not in marked:
            continue
        for m in (_WRAPPED if wrapped else _RUN).finditer(marked):
            for key in _Body(source, marked, *m.span()).keys():
                keys.setdefault(key[0], key)
    found += keys.values()
    return sorted(found)


@F.pandas_udf(
    fields("n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string")
)
def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            spans = spans_of(text)
            named = [(kind, f"{KINDS[kind]}:{start}:{end}") for start, kind, end in spans]
            base = ",".join(name for kind, name in named if kind < len(BASE_KINDS))
            count = [sum(kind == k for kind, _ in named) for k in range(len(BASE_KINDS))]
            digest = hashlib.sha256(base.encode()).hexdigest()
            rows.append((*count, len(named) - sum(count), digest, ",".join(name for _, name in named)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"])


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans.

    A null text is an empty one: no spans, and the digest of the empty string. Rows are independent of each other, so ids may be null or
    repeated. Other columns are not read.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text)).alias("s")).select("doc_id", "s.*")
