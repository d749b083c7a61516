"""Secret scans: patterns, then candidates that are confirmed by their structure.

Base patterns give spans of the kinds assign, access and hex. Beside them, base64, hex and token
candidates are decoded, and reported only where the bytes are what they claim to be:

* `key`: a private key in DER, armoured, bare base64 or hex. Lengths must nest exactly at every
  level: PKCS#1 (nine integers, the two primes' product is the modulus), DSA, SEC1, PKCS#8 around
  one of these or an Edwards or Montgomery key, and encrypted PKCS#8.
* `ssh`: the `openssh-key-v1` layout, its nested lengths used up exactly; without encryption the
  two check numbers must agree.
* `jwt`: a signed token: header and claims are JSON objects, the header names an algorithm, and the
  signature has that algorithm's length.

Each text is scanned whole, in one task, by patterns that are linear in its length: runs are tried
only from their first character and aren't given back. Rows are handed over in batches of about
4 MB (one row at least); nothing is shuffled. Null and empty texts have no spans. Repeated rows
give repeated results, null ids stay null, and other columns are dropped, whatever their names. An
empty table gives an empty result. Spans of different kinds may overlap; within a kind they don't.
Keys in armour with a `Proc-Type` header are encrypted text without structure, and aren't reported.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "key", "ssh", "jwt")
#: The base patterns, and how long a match (for assign its value) must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:(?:[A-Za-z0-9+/]{64}\r?\n)++|(?:[A-Za-z0-9+/]{76}\r?\n)++)(?:[A-Za-z0-9+/]++={0,2})?")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}")
_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]++)")
_BREAKS = re.compile(r"\s|\\[nr]")

#: Object identifiers of keys, and the bytes of a signature by algorithm (RSA: at least).
RSA, DSA, EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
CURVE_KEYS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132}
RSA_SIGNATURES = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
_INT, _BITS, _OCTETS, _NULL, _OID, _SEQ = 2, 3, 4, 5, 6, 0x30
#: Bytes of the longest number taken for part of a key.
MOST = 4096


def fields(data: bytes) -> list[tuple[int, bytes]]:
    """The (tag, content) pairs that `data` consists of; ValueError where lengths don't use it up exactly or aren't the shortest."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 31 == 31:
            raise ValueError("no tag and length")
        tag, size, at = data[at], data[at + 1], at + 2
        if size > 127:
            n = size & 127
            if not 1 <= n <= 4 or at + n > len(data):
                raise ValueError("length of length")
            size, at = int.from_bytes(data[at : at + n]), at + n
            if size < 128 or size >> (8 * n - 8) == 0:
                raise ValueError("length isn't the shortest")
        if at + size > len(data):
            raise ValueError("content ends early")
        out.append((tag, data[at : at + size]))
        at += size
    return out


def _sequence(data: bytes) -> list[tuple[int, bytes]]:
    outer = fields(data)
    if len(outer) != 1 or outer[0][0] != _SEQ:
        raise ValueError("not one sequence")
    return fields(outer[0][1])


def _numbers(parts: list[tuple[int, bytes]]) -> list[int]:
    if any(t != _INT or not x or len(x) > MOST for t, x in parts):
        raise ValueError("not integers")
    return [int.from_bytes(x, signed=True) for _, x in parts]


def _rsa(parts: list[tuple[int, bytes]]) -> bool:
    version, n, e, d, p, q, *_ = _numbers(parts)
    return len(parts) == 9 and version in (0, 1) and p > 1 and q > 1 and p * q == n and 1 < e < n and 1 < d < n


def _dsa(parts: list[tuple[int, bytes]]) -> bool:
    version, p, q, g, y, x = _numbers(parts)
    return version == 0 and 0 < x < q < p and 1 < g < p and 1 < y < p and (p - 1) % q == 0


def _ec(parts: list[tuple[int, bytes]]) -> bool:
    return len(parts) in (2, 3, 4) and parts[0] == (_INT, b"\x01") and parts[1][0] == _OCTETS and 16 <= len(parts[1][1]) <= 66 and all(t in (0xA0, 0xA1) and len(fields(x)) == 1 for t, x in parts[2:])


def _wrapped(parts: list[tuple[int, bytes]]) -> bool:
    """PKCS#8: the algorithm says what the octets must be."""
    kind = fields(parts[1][1])
    name, inner = kind[0][1], parts[2][1]
    if kind[0][0] != _OID or parts[2][0] != _OCTETS or parts[0][1] not in (b"\x00", b"\x01"):
        return False
    if name == RSA:
        return _rsa(_sequence(inner))
    if name == EC:
        return _ec(_sequence(inner))
    if name == DSA:
        return [t for t, _ in fields(inner)] == [_INT]
    return name in CURVE_KEYS and [(t, len(x)) for t, x in fields(inner)] == [(_OCTETS, CURVE_KEYS[name])]


def private_key(data: bytes) -> bool:
    """Whether data is one private key in DER, to its last byte."""
    if data[:1] != b"\x30":
        return False
    try:
        parts = _sequence(data)
        tags = [t for t, _ in parts]
        if tags[:3] == [_INT, _SEQ, _OCTETS]:
            return _wrapped(parts)
        if tags == [_SEQ, _OCTETS]:  # encrypted: an algorithm with parameters, then blocks
            kind = fields(parts[0][1])
            return len(kind) == 2 and kind[0][0] == _OID and kind[1][0] == _SEQ and len(parts[1][1]) >= 32 and len(parts[1][1]) % 8 == 0
        return _rsa(parts) if len(tags) == 9 else _dsa(parts) if len(tags) == 6 else _ec(parts)
    except (ValueError, IndexError):
        return False


def _strings(data: bytes, n: int) -> tuple[list[bytes], bytes]:
    """The first n length-prefixed strings, and the rest."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[:4])
        if len(data) < 4 + size:
            raise ValueError("string ends early")
        out.append(data[4 : 4 + size])
        data = data[4 + size :]
    return out, data


def ssh_key(data: bytes) -> bool:
    """Whether data is an openssh-key-v1 file, to its last byte."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    try:
        (cipher, kdf, options), rest = _strings(data[15:], 3)
        count = struct.unpack(">I", rest[:4])[0]
        if not 1 <= count <= 16 or not cipher or not kdf:
            return False
        (*publics, private), rest = _strings(rest[4:], count + 1)
        if rest or not private or any(len(_strings(x, 1)[0][0]) < 4 for x in publics):
            return False
        return cipher != b"none" or (kdf == b"none" and not options and private[:4] == private[4:8] and _strings(private[8:], 1)[0][0] == _strings(publics[0], 1)[0][0])
    except (ValueError, struct.error):
        return False


def _decoded(text: str) -> bytes:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _from_url(text: str) -> bytes:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError):
        return b""


def _object(text: str) -> dict | None:
    data = _from_url(text)
    if not data.lstrip()[:1] == b"{":
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_token(header: str, claims: str, signature: str) -> bool:
    head = _object(header)
    algorithm = head.get("alg") if head else None
    if not isinstance(algorithm, str) or _object(claims) is None:
        return False
    size = len(_from_url(signature))
    if algorithm in RSA_SIGNATURES:
        return size >= 128
    return size in (64, 114) if algorithm == "EdDSA" else size == SIGNATURES.get(algorithm)


def kind_of(data: bytes) -> str | None:
    return "ssh" if ssh_key(data) else "key" if private_key(data) else None


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded bytes have the structure of a secret; of overlapping ones of a kind the longest."""
    found, opened = [], None
    for m in _ARMOUR.finditer(text):
        if m[1] == "END" and opened and opened[2] == m[2]:
            kind = kind_of(_decoded(_BREAKS.sub("", text[opened.end() : m.start()]).rstrip("=")))
            found += [(kind, opened.start(), m.end())] if kind else []
        opened = m if m[1] == "BEGIN" else None
    for pattern in (_WRAPPED, _BASE64):
        for m in pattern.finditer(text):
            run = m[0].rstrip()
            kind = kind_of(_decoded(_BREAKS.sub("", run).rstrip("=")))
            found += [(kind, m.start(), m.start() + len(run))] if kind else []
    for m in _HEX.finditer(text):
        kind = kind_of(bytes.fromhex(m[0])) if len(m[0]) % 2 == 0 else None
        found += [(kind, m.start(), m.end())] if kind else []
    found += [("jwt", m.start(), m.end()) for m in _TOKEN.finditer(text) if signed_token(m[1], m[2], m[3])]
    out: list[tuple[str, int, int]] = []
    for kind, a, z in sorted(found, key=lambda s: (s[0], s[1], -s[2])):
        if not out or out[-1][0] != kind or out[-1][2] <= a:
            out.append((kind, a, z))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = "struct<kind: string, start: long, `end`: long, confirmed: boolean>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans of each text by start, then kind, in code points, the end exclusive; `confirmed` marks those found by structure."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                extra = set(confirmed(text))
                out.append([{"kind": k, "start": a, "end": z, "confirmed": (k, a, z) in extra} for k, a, z in in_order([*base_spans(text), *extra])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], [id_col, "spans"])

    rows = docs.select(id_col, F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, spans array<{SPAN}>")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: ~s["confirmed"])
    return rows.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
