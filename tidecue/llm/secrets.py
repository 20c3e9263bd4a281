"""Secret scans with structural confirmation.

Three kinds are patterns alone (assign, access, hex). Three more are reported only if decoding confirms them:

``jwt``      a signed token: its first two parts are base64url JSON objects, the first one names an ``alg``
``key``      base64 or hex that decodes to a private key: DER whose nested lengths fill the whole and whose
             members are those of PKCS#1, PKCS#8 or SEC 1, or an OpenSSH container whose length fields nest
``encoded``  base64 or hex of text (UTF-8, no control characters) that itself holds an assign or access secret or one of these

Spans are code points of the whole text, end exclusive. Texts are scanned once, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm.common import table, text_or_empty

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "key", "encoded")

#: The keywords letter by letter, as letters here means A-Z and a-z only.
_KEYWORD = r"[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("pass", "secret", "token", "api")

JWT = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*(?!\.?[A-Za-z0-9_-])")
#: A base64 run, perhaps wrapped over lines of 40 characters or more, before a line of dashes.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}\r?\n(?!-----))*(?:[A-Za-z0-9+/_-]{4,}={0,2}|[A-Za-z0-9+/_-]{2,3}={1,2})(?![A-Za-z0-9+/=_-])")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24}")
HEX_CODE = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
MIN_BASE64 = 24
#: Levels of encoding inside one another that are decoded.
MAX_DEPTH = 4
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three plain kinds, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The members (tag, start, end) of DER data that fill it exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:  # DER asks for the shortest form
                return None
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def _is_der_key(data: bytes) -> bool:
    outer = _der(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = _der(data, *outer[0][1:])
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    tags, version = [t for t, _, _ in inner], data[inner[0][1]]
    if version == 0 and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS#1
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        kind = _der(data, *inner[1][1:])
        return bool(kind) and kind[0][0] == 0x06  # PKCS#8
    return version == 1 and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC 1


def _is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, seen = len(magic), 0
    while at + 4 <= len(data):
        if seen == 3:  # the number of keys, between the fields
            at, seen = at + 4, seen + 1
            continue
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if at + n > len(data):
            return False
        at, seen = at + n, seen + 1
    return seen >= 5 and at == len(data)


def _kind_of(data: bytes, depth: int) -> str | None:
    """What decoded bytes are; text that is encoded once more is decoded again, down to ``MAX_DEPTH`` levels."""
    if not data:
        return None
    if (data[0] == 0x30 and _is_der_key(data)) or (data[:1] == b"o" and _is_openssh_key(data)):
        return "key"
    if len(data) < 12:
        return None
    try:
        inner = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if _CONTROL.search(inner):
        return None
    if any(m.end(1) - m.start(1) >= 12 for m in ASSIGN.finditer(inner)) or ACCESS.search(inner):
        return "encoded"
    return "encoded" if depth < MAX_DEPTH and confirmed_spans(inner, depth + 1) else None


def _unbase64(code: str) -> bytes:
    code = re.sub(r"[\r\n=]", "", code).translate(str.maketrans("-_", "+/"))
    if len(code) % 4 == 1:
        return b""
    try:
        return base64.b64decode(code + "=" * (-len(code) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _is_object(part: str, key: str | None = None) -> bool:
    try:
        value = json.loads(_unbase64(part))
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and (key is None or isinstance(value.get(key), str))


def confirmed_spans(text: str, depth: int = 1) -> list[tuple[str, int, int]]:
    """The spans that decoding confirms."""
    out = []
    if "ey" in text or "ew" in text:  # a JSON object in base64url starts with one: {" or { and a blank, or { and a line end or tab
        for m in JWT.finditer(text):
            head, body, _ = m[0].split(".")
            if _is_object(head, "alg") and _is_object(body):
                out.append(("jwt", *m.span()))
    if _RUN.search(text):
        for m in BASE64.finditer(text):
            if m.end() - m.start() >= MIN_BASE64 and (kind := _kind_of(_unbase64(m[0]), depth)):
                out.append((kind, *m.span()))
    for m in HEX_CODE.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _kind_of(bytes.fromhex(m[0]), depth)):
            out.append((kind, *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    of = lambda kind: sum(k == kind for k, _, _ in base)
    return of("assign"), of("access"), of("hex"), joined(base), joined(base + confirmed_spans(text))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans for every row of ``docs``.

    ``base`` and ``spans`` are kind:start:end by start, comma-joined; empty where nothing is found. A null text
    is an empty one; repeated rows are scanned one by one; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
