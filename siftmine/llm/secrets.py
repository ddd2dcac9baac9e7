"""Secret scans with structural confirmation.

Three plain patterns always report. Beyond them, base64 and hex candidates are decoded and reported only if their
bytes parse as something secret: private keys in DER (PKCS#1, PKCS#8, encrypted PKCS#8, SEC1, DSA) whose nested lengths
fill the value exactly, OpenSSH private key containers, PEM blocks around either, and signed tokens whose header is a
JSON object that names its algorithm. Certificates and public keys parse too, but aren't secrets, and aren't reported.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, with_columns

# The plain kinds and their patterns, then the confirmed kinds, in the order of ties.
KINDS = ["assign", "access", "hex", "pem", "der", "ssh", "jwt"]
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

LONG_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
HEX_KEY = re.compile(r"(?=30(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4}|83[0-9a-f]{6})(?:02010[01]|30))")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----")
BREAK = re.compile(r"\\[rn]|[\r\n]")
ENCRYPTED = re.compile(r"^Proc-Type: *4,ENCRYPTED", re.M)
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")


def b64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64 with or without padding and white space; None if it is neither."""
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if not text or len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _tlv(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER element at a place; None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, n, at = raw[at], raw[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _elements(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly; None if none do."""
    out = []
    while at < end:
        e = _tlv(raw, at, end)
        if not e:
            return None
        out.append(e)
        at = e[2]
    return out


# Object identifiers of password-based encryption, PKCS #5 and PKCS #12, without their last numbers.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def is_der_key(raw: bytes) -> bool:
    """A private key in DER that fills the bytes."""
    top = _tlv(raw, 0, len(raw))
    if not top or top[0] != SEQUENCE or top[2] != len(raw) or len(raw) < 24:
        return False
    parts = _elements(raw, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]
    inside = _elements(raw, parts[0][1], parts[0][2]) if tags[0] == SEQUENCE else None
    if inside and inside[0][0] == OID:  # encrypted PKCS#8: algorithm, octets
        return tags == [SEQUENCE, OCTETS] and raw[inside[0][1] : inside[0][2]].startswith(PASSWORD_BASED)
    version = raw[parts[0][1] : parts[0][2]]
    if tags[0] != INTEGER or version not in (b"\0", b"\1"):
        return False
    if all(t == INTEGER for t in tags):  # DSA, and PKCS#1 with two primes
        return len(tags) in (6, 9)
    if tags[1] == INTEGER:  # PKCS#1 with more primes
        return tags[:9] == [INTEGER] * 9 and tags[9:] == [SEQUENCE] and version == b"\1"
    if tags[1] == OCTETS:  # SEC1
        return version == b"\1" and parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    algorithm = _elements(raw, parts[1][1], parts[1][2]) if tags[1] == SEQUENCE else None  # PKCS#8
    return bool(algorithm) and algorithm[0][0] == OID and len(tags) > 2 and tags[2] == OCTETS and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])


def is_ssh_key(raw: bytes) -> bool:
    """An OpenSSH private key container, whose fields fill the bytes."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + n > len(raw):
            return None
        out, at = raw[at + 4 : at + 4 + n], at + 4 + n
        return out

    cipher, method, options = field(), field(), field()
    if not cipher or not method or options is None:
        return False
    keys, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 64 or any(not field() for _ in range(keys)):
        return False
    private = field()
    return bool(private) and at == len(raw) and len(private) % 8 == 0


def der_length(raw: bytes) -> int:
    """Bytes of the DER element that begins here, by its head; 0 if it's none of a private key."""
    if len(raw) < 6 or raw[0] != SEQUENCE:
        return 0
    n, at = raw[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 3:
            return 0
        n, at = int.from_bytes(raw[2 : 2 + k], "big"), 2 + k
    return at + n if raw[at : at + 1] == b"\x30" or raw[at : at + 2] == b"\2\1" else 0


def keys_in_base64(run: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of key encodings in a run, at any place in it, as a path or a line end may stand before them."""
    out, at = [], 0
    body = run.rstrip("=")
    while True:
        at = min((x for x in (body.find("M", at), body.find("b3BlbnNzaC1rZXkt", at)) if x >= 0), default=-1)
        if at < 0:
            return out
        if body[at] == "b":
            raw = b64(run[at:])
            if raw and is_ssh_key(raw):
                out.append(("ssh", at, len(run)))
                return out
        elif body[at + 1 : at + 2] in set("ABCDEFGHI"):
            head = b64(body[at : at + 12])
            n = der_length(head) if head else 0
            end = at + -(-n * 4 // 3)
            if n >= 24 and end <= len(body):
                raw = b64(body[at:end])
                if raw and is_der_key(raw[:n]):
                    stop = len(run) if end == len(body) else end
                    out.append(("der", at, stop))
                    at = end
                    continue
        at += 1


def keys_in_hex(run: str) -> list[tuple[int, int]]:
    low, out, after = run.lower(), [], 0
    for m in HEX_KEY.finditer(low):
        at = m.start()
        n = der_length(bytes.fromhex(low[at : at + 12])) if at >= after else 0
        if 24 <= n and at + 2 * n <= len(low) and is_der_key(bytes.fromhex(low[at : at + 2 * n])):
            after = at + 2 * n
            out.append((at, after))
    return out


def is_pem_key(body: str) -> bool:
    """What lies between the lines of a PEM block: base64 of a private key, or of a whole number of ciphertext blocks
    under the heads that say so. Line ends may be written as backslash and letter."""
    lines = [x.strip(" \t\"',+") for x in BREAK.split(body)]
    heads = [x for x in lines if ": " in x]
    raw = b64("".join(x for x in lines if x not in heads))
    if not raw:
        return False
    if any(ENCRYPTED.match(x) for x in heads):
        return len(raw) >= 24 and len(raw) % 8 == 0
    return is_der_key(raw) or is_ssh_key(raw)


def is_token_header(text: str) -> bool:
    """base64url of a JSON object with an algorithm."""
    raw = b64(text)
    try:
        head = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def spans(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret value) in code points, end exclusive, by start and kind."""
    if not text:
        return []
    out, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        begun = list(PEM.finditer(text))
        for m, after in zip(begun, [*(x.start() for x in begun[1:]), len(text)]):
            end = f"-----END {m[1]}-----"
            at = text.find(end, m.end(), after)
            if at >= 0 and is_pem_key(text[m.end() : at]):
                out.append(("pem", m.start(), at + len(end), m.start()))
    for m in BASE64.finditer(text):
        out += [(kind, m.start() + a, m.start() + b, m.start() + a) for kind, a, b in keys_in_base64(m[0])]
    for m in LONG_HEX.finditer(text):
        out += [("der", m.start() + a, m.start() + b, m.start() + a) for a, b in keys_in_hex(m[0])]
    if "ey" in text or "ew" in text:
        out += [("jwt", m.start(), m.end(), m.start()) for m in JWT.finditer(text) if is_token_header(m[1])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, found: list[tuple[str, int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every secret value replaced by a mark; spans that overlap give one."""
    if not text or not found:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, _, end, value in sorted(found, key=lambda s: (s[3], s[2])):
        if merged and value <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([value, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        found = [spans(t) for t in texts]
        listed = pa.array([[dict(zip(("kind", "start", "end", "value"), s)) for s in f] for f in found], pa.list_(SPAN))
        cols, names = [*batch.columns[:-1], listed], [*batch.schema.names[:-1], "spans"]
        if with_text:
            cols.append(pa.array([redact(t, f) for t, f in zip(texts, found)], pa.string()))
            names.append("redacted")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """One row for each document: the kept columns, spans (kind, start, end, value; by start, then kind), and on
    request the text with every secret value replaced (`redacted`).

    A null or empty text has no spans and stays as it is. Spans of different kinds may overlap; of one kind they don't,
    and ties go by kind. Rows, repeated or not, are scanned one by one; no shuffle, and an empty table gives no rows.
    Texts of any length are scanned whole, one at a time. Where a kept column has a name that
    is added here, that gets underscores before it.
    """
    kinds = {"spans": "array<struct<kind: string, start: bigint, end: bigint, value: bigint>>"} | ({"redacted": "string"} if with_text else {})
    return with_columns(docs, keep, text, kinds, lambda b: _scan(b, with_text))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts of the plain kinds, the digest of their spans, and all spans, of every document."""
    from .common import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))
