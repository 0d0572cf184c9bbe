"""Secret scans with structural confirmation.

Base patterns give spans of their own.  Long runs of base64 or hex characters are candidates besides:
they are reported only if, decoded, they hold together as a secret: a private key whose nested
lengths fill it exactly, an OpenSSH key, a signed token whose header names an algorithm, or text in
which a base pattern matches.  Armoured keys (BEGIN ... PRIVATE KEY) are decoded likewise.  A candidate has
LEAST_BLOB characters or more: no key and hardly any password with its name has fewer.

Whole texts are scanned, whatever their length.  Null texts count as empty and have no span; every
row gives one row, repeated ids included; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches

#: Kinds in the order in which spans at one start are listed; the first three are the base patterns'.
KINDS = ("assign", "access", "hex", "pem", "token", "key", "encoded")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: Without one of these no ASSIGN matches.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*)-----END \1-----")
#: A token's header is a JSON object, with or without white space; its signature is not empty.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]+")
#: Base64's two alphabets; a candidate is a maximal run of one of them.
ALPHABETS = ("A-Za-z0-9+/", "A-Za-z0-9_-")
BLOBS = [re.compile(f"[{x}]+={{0,2}}") for x in ALPHABETS]
#: For each alphabet: its letters, lines of them with what follows, and one such line.
WRAPPED = [(re.sub(rb"[^%s]" % x.encode(), b"", bytes(range(128))), *(re.compile(p.encode()) for p in (rf"[{x}]+(?:[ \t]*\r?\n[ \t]*[{x}]+)+={{0,2}}", f"[{x}]+"))) for x in ALPHABETS]
ANY_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: A candidate has at least so many characters.
LEAST_BLOB = 24

RUN = np.zeros(256, bool)
RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True


def _unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """A DER length at ``at``: (length, where the content starts)."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    value = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return None if value < 0x80 or data[at + 1] == 0 else (value, at + 1 + n)


def _elements(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[at:end] exactly, constructed ones checked inside; None if they don't."""
    out = []
    while at < end:
        tag, got = data[at], _length(data, at + 1)
        if got is None or got[1] + got[0] > end:
            return None
        out.append((tag, got[1], got[1] + got[0]))
        if tag & 0x20 and (depth > 12 or _elements(data, got[1], got[1] + got[0], depth + 1) is None):
            return None
        at = got[1] + got[0]
    return out


def is_der_key(data: bytes | memoryview) -> bool:
    """A private key in DER: one sequence that fills the data and begins with a small version number,
    followed by the numbers of a key, an algorithm with its key, or an octet string."""
    outer = _elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    parts = _elements(data, outer[0][1], outer[0][2]) or []
    if len(parts) < 2 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 3:
        if len(parts) != 2 or [p[0] for p in parts] != [0x30, 0x04]:  # encrypted: an algorithm, then the key
            return False
        inner = _elements(data, parts[0][1], parts[0][2]) or []
        return bool(inner) and inner[0][0] == 0x06
    tags = [p[0] for p in parts[1:]]
    return tags[0] == 0x04 or tags[:2] == [0x30, 0x04] or len(tags) >= 5 and set(tags[:5]) == {0x02}


def is_openssh_key(data: bytes | memoryview) -> bool:
    """The OpenSSH container: magic, then length-prefixed fields that stay inside the data."""
    magic = b"openssh-key-v1\0"
    if data[: len(magic)] != magic:
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data)


def is_signed_token(text: str) -> bool:
    """A token of three parts whose first decodes to a JSON object that names an algorithm (other than ``none``), the second to a
    JSON object, and whose third isn't empty."""
    parts = text.split(".")
    if len(parts) != 3 or not parts[2]:
        return False
    for n, part in enumerate(parts[:2]):
        head = _unbase64(part[:4])
        if not head or head[:1] not in b"{ \t\r\n":
            return False
        try:
            value = json.loads((_unbase64(part) or b"").decode())
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict):
            return False
        if n == 0 and (not isinstance(value.get("alg"), str) or value["alg"].lower() in ("", "none")):
            return False
    return True


class _Covered:
    """Spans that were found, for asking whether one of them holds another; their unions would do, as no span lies across two."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        k = bisect_right(self.starts, a)
        if k and self.ends[k - 1] >= b:
            return
        while k < len(self.starts) and self.ends[k] <= b:
            del self.starts[k], self.ends[k]
        self.starts.insert(k, a)
        self.ends.insert(k, b)

    def __contains__(self, span: tuple[int, int]) -> bool:
        k = bisect_right(self.starts, span[0])
        return bool(k) and self.ends[k - 1] >= span[1]


def _base(text: str, raw: bytes, start: int = 0) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the assign and access patterns."""
    out = []
    lower = raw.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        out += [(start + m.start(), 0, start + m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"AKIA" in raw:
        out += [(start + m.start(), 1, start + m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out


def _holds_secret(data: bytes) -> bool:
    """Decoded bytes that are printable text in which a base pattern matches."""
    if not data.isascii() or any(b < 0x20 and b not in b"\t\n\r" for b in data):
        return False
    text = data.decode()
    return bool(_base(text, data)) or any(len(m[0]) >= LEAST_HEX for m in HEX.finditer(text))


def _in_run(run: str, at: int) -> list[tuple[int, int, int]]:
    """Hex spans and confirmed candidates in a long run of candidate characters that starts at ``at``."""
    out = [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if len(m[0]) >= LEAST_HEX]
    for m in TOKEN.finditer(run):
        # What stands before a compact header may be joined to it by a hyphen.
        for a in {0, max(0, m[0].find("eyJ", 0, m[0].index(".")))}:
            if is_signed_token(m[0][a:]):
                out.append((at + m.start() + a, 4, at + m.end()))
    seen = _Covered((a, b) for a, _, b in out)
    for m in ANY_HEX.finditer(run):
        if len(m[0]) >= LEAST_BLOB:
            data = bytes.fromhex(m[0][: len(m[0]) & ~1])
            kind = 5 if is_der_key(data) or is_openssh_key(data) else 6 if _holds_secret(data) else None
            if kind:
                out.append((at + m.start(), kind, at + m.end()))
                seen.add(at + m.start(), at + m.end())
    # A value may stand after an equals sign or a dot that belongs to the run, so each maximal blob is tried; the longer first,
    # as what is part of one alphabet's secret may be a blob of the other.
    blobs = {(m.start(), m.end()) for pattern in BLOBS for m in pattern.finditer(run) if m.end() - m.start() >= LEAST_BLOB}
    for a, b in sorted(blobs, key=lambda x: (x[0] - x[1], x)):
        if (at + a, at + b) in seen:
            continue
        data = _unbase64(run[a:b])
        kind = data and (5 if is_der_key(data) or is_openssh_key(data) else 6 if _holds_secret(data) else None)
        if kind:
            out.append((at + a, kind, at + b))
            seen.add(at + a, at + b)
    return out


def _in_lines(data: bytes, start: int, end: int) -> tuple[list[tuple[int, int, int]], int]:
    """(start, kind, end) in bytes of base64 that is wrapped over lines, the first of which ends the run of candidate
    characters data[start:end]; and where the lines end."""
    out, last = [], end
    for letters, block, line in WRAPPED:
        first = start + len(data[start:end].rstrip(letters))
        if end - first < LEAST_BLOB:
            continue
        m = block.match(data, first)
        if not m:
            continue
        last = max(last, m.end())
        lines = _Lines(data, [(x.start(), x.end()) for x in line.finditer(data, m.start(), m.end())])
        count, k = len(lines.spans), 0
        while k < count - 1:
            n, kind = lines.held(k)
            if kind:
                out.append((lines.spans[k][0], kind, m.end() if n == count - 1 else lines.spans[n][1]))
            k = n + 1 if kind else k + 1
    return out, last


class _Lines:
    """Lines of one alphabet.  Their letters are decoded once for each of the four places that a line may begin at in a group of four."""

    def __init__(self, data: bytes, spans: list[tuple[int, int]]):
        self.spans = spans
        self.letters = b"".join([data[a:b] for a, b in spans])
        self.before = [0, *accumulate(b - a for a, b in spans)]
        self._held: dict[int, memoryview] = {}

    def decoded(self, k: int, n: int) -> memoryview:
        """What lines k to n are, joined; nothing where so many letters can't be base64."""
        a, b = self.before[k], self.before[n + 1]
        if (b - a) % 4 == 1:
            return memoryview(b"")
        if a % 4 not in self._held:
            rest = self.letters[a % 4 :].decode()
            self._held[a % 4] = memoryview(_unbase64(rest + "A" * (-len(rest) % 4)) or b"")
        return self._held[a % 4][a // 4 * 3 :][: (b - a) * 6 // 8]

    def held(self, k: int) -> tuple[int, int | None]:
        """The last of the lines that hold a key or a secret together with line ``k``, its first, and the kind."""
        count = len(self.spans)
        head = bytes(self.decoded(k, k)[:18]) or bytes(self.decoded(k, min(k + 1, count - 1))[:18])
        got = _length(head, 1) if head[:1] == b"\x30" else None
        if got:  # the length says how many letters there are
            to = self.before[k] + -(-8 * sum(got) // 6)
            n = bisect_left(self.before, to) - 1
            if n < count:
                return n, 5 if self.before[n + 1] == to and n > k and is_der_key(self.decoded(k, n)) else None
        # What follows the last line of a value may be a word of the text; a text is tried from the first line on.
        if k == 0 or head.startswith(b"openssh-key-v1"):
            for n in (count - 1, count - 2):
                whole = self.decoded(k, n) if n > k else b""
                if is_openssh_key(whole):
                    return n, 5
                if k == 0 and whole and _holds_secret(bytes(whole)):
                    return n, 6
        return k, None


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of everything found in one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return _spans(text, raw, _long_runs(raw))


def _long_runs(raw: np.ndarray) -> list[tuple[int, int]]:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = RUN[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - starts >= LEAST_BLOB
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def _spans(text: str, raw: np.ndarray, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    data = raw.tobytes()
    out = _base(text, data)
    armoured = []
    if b"-----BEGIN " in data:
        for m in PEM.finditer(text):
            body = "".join(x for x in m[2].splitlines() if ":" not in x).replace(" ", "")
            key = _unbase64(body)
            if key and (is_der_key(key) or is_openssh_key(key) or "ENCRYPTED" in m[2]):
                armoured.append((m.start(), 3, m.end()))
    out += armoured
    held = _Covered((a, b) for a, _, b in armoured)
    before = at = wrapped = 0  # before: code points before byte ``at``
    for a, b in runs:
        before += int(np.count_nonzero((raw[at:a] & 0xC0) != 0x80))
        at = a
        out += _in_run(data[a:b].decode(), before)
        if a >= wrapped and data[b : b + 1] in (b"\n", b"\r", b" ", b"\t"):
            found, wrapped = _in_lines(data, a, b)
            found = [(before + x - a, kind, before + y - a) for x, kind, y in found]
            out += [f for f in found if (f[0], f[2]) not in held]
    return [(KINDS[k], a, b) for a, k, b in sorted(set(out))]


def redacted(text: str, mark: str = "[REDACTED]") -> str:
    """``text`` with each span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in spans(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) by start, then kind as listed in KINDS."""

    def run(it):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in it:
            for part in batches.slices(batch):
                data, offsets = batches.byte_view(part.column(1))
                found = []
                for k, text in enumerate(part.column(1).to_pylist()):
                    raw = data[offsets[k] : offsets[k + 1]]
                    found.append([{"kind": x, "start": a, "end": b} for x, a, b in _spans(text or "", raw, _long_runs(raw))])
                yield pa.record_batch([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return batches.by_id_text(df, id_col, text_col).mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``df`` with the secrets in its texts replaced; null texts stay null, other columns as they are."""
    batches.small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redacted(t, mark))

    return df.withColumn(text_col, clean(F.col(text_col)))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as one string."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda col: F.array_join(F.transform(col, shown), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
