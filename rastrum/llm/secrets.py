"""Secret scan: pattern spans, and structural confirmation of base64 and hex candidates.

Pattern spans are the three base kinds (assign, access, hex). Beyond them, long runs of base64 or hex characters are decoded
and reported only if the bytes have the structure of key material: DER whose nested lengths add up, an OpenSSH key
container, a PEM block around either (or one whose headers say that it is encrypted), or a signed token whose header is JSON with an
algorithm and whose payload is what the header says. Line breaks inside base64 may be real or written as in a JSON string.

Defined cases: null texts count as empty; repeated rows are scanned one by one; only ``doc_id`` and ``text`` are read. Spans
are code points with an exclusive end, sorted by start, then kind.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, sha, texts_of, tidy

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
_BREAK = re.compile(r"(?:\\r)?\\n|\r?\n")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40,100}(?:(?:\\n|\r?\n)[\x20\t]{0,16}[A-Za-z0-9+/]{1,100})+={0,2}(?![A-Za-z0-9+/=_-])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
#: Decoded bytes below this can't be told from chance.
MIN_DER = 20
_HEX_RUN, _B64_RUN = b"h" * 24, b"b" * 32
_TO_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_TO_B64 = bytes(98 if chr(i).isascii() and chr(i).isalnum() or chr(i) in "+/_-" else 32 for i in range(256))


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the DER element at ``at``, if its length is in shortest form and fits."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def nested(data: bytes, start: int, end: int, depth: int = 0) -> int | None:
    """How many elements fill start..end exactly, those inside constructed ones included; None if they don't."""
    n = 0
    while start < end:
        x = tlv(data, start, end)
        if x is None or depth > 12:
            return None
        tag, s, e = x
        if tag & 0x20:
            inner = nested(data, s, e, depth + 1)
            if inner is None:
                return None
            n += inner
        elif tag == 0x02 and s == e or tag & 0x1F == 0x1F or tag == 0:
            return None
        start, n = e, n + 1
    return n


def structure(data: bytes) -> str | None:
    """'der' for one sequence that fills data with at least three inner elements, an integer, object id or octet string first; 'openssh' for its container."""
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 0
        while at + 4 <= len(data) and fields < 3:
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            fields += 1
        return "openssh" if fields == 3 and at <= len(data) else None
    if len(data) < MIN_DER or data[0] != 0x30:
        return None
    x = tlv(data, 0, len(data))
    if x is None or x[2] != len(data) or data[x[1]] not in (0x02, 0x06, 0x30, 0x04):
        return None
    return "der" if (nested(data, x[1], x[2]) or 0) >= 3 else None


def unbase64(text: str) -> bytes | None:
    s = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except binascii.Error:
        return None


def is_token(header: str, payload: str) -> bool:
    """Whether the first part decodes to a JSON object that names an algorithm, and the second decodes, for a header that says JWT to a JSON
    object."""

    def parsed(part: str) -> object:
        raw = unbase64(part)
        try:
            return json.loads(raw) if raw and raw[:1] == b"{" else None
        except (ValueError, RecursionError):
            return None

    got = parsed(header)
    if not isinstance(got, dict) or not isinstance(got.get("alg"), str):
        return False
    return isinstance(parsed(payload), dict) if str(got.get("typ")).upper() == "JWT" else unbase64(payload) is not None


def is_pem(body: str) -> bool:
    """Whether what stands between PEM marks is key material: headers, then base64 of a structure, or of whole cipher blocks where the headers
    say that it is encrypted."""
    lines = [x.strip() for x in _BREAK.split(body.strip())]
    heads = [x for x in lines if ":" in x]
    raw = unbase64("".join(x for x in lines if ":" not in x).replace("\\/", "/"))
    if not raw:
        return False
    if any(x.startswith("Proc-Type:") and x.endswith("ENCRYPTED") for x in heads):
        return any(x.startswith("DEK-Info:") for x in heads) and len(raw) % 8 == 0
    return structure(raw) is not None


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in raw.translate(_TO_HEX):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def confirmed(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """Spans of candidates whose decoded bytes have the structure of a key or token."""
    out = []
    if "-----BEGIN " in text:
        begin = None
        for m in _MARK.finditer(text):
            if m[1] == "END" and begin and begin[2] == m[2] and is_pem(text[begin.end() : m.start()]):
                out.append((begin.start(), m.end(), "pem"))
            begin = m if m[1] == "BEGIN" else None
    out += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_token(m[1], m[2])]
    mapped = raw.translate(_TO_B64)
    if _B64_RUN in mapped:
        for m in _RUN.finditer(text):
            s = m[0]
            kind = None
            if not len(s) % 2 and re.fullmatch("[0-9a-fA-F]+", s):
                kind = structure(bytes.fromhex(s))
            if kind is None and (body := unbase64(s)):
                kind = structure(body)
            if kind:
                out.append((m.start(), m.end(), kind))
        for m in _WRAPPED.finditer(text):
            lines = [x.strip() for x in _BREAK.split(m[0])]
            if len({len(x) for x in lines[:-1]}) == 1 and (body := unbase64("".join(lines))) and (kind := structure(body)):
                out.append((m.start(), m.end(), kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, spans confirmed by structure)."""
    raw = text.encode("utf-8", "surrogatepass")
    return base_spans(text, raw), confirmed(text, raw)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each covered stretch replaced by one mark; overlapping spans share one."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if e > at:
            if s >= at:
                out.append(text[at:s] + f"[{k}]")
            at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans, n_confirmed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_of(batch):
            base, more = spans_of(text)
            rows.append([*(sum(k == x for _, _, x in base) for k in BASE_KINDS), sha(joined(base)), joined(base + more), len(more)])
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return per_batch(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span, base and confirmed, replaced in ``text``; other columns as they were."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in batch.column(at).to_pylist():
            base, more = spans_of(t) if t else ([], [])
            out.append(redact(t, base + more) if base or more else t)
        cols = list(batch.columns)
        cols[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(tidy(lambda batches: map(run, batches)), docs.schema)
