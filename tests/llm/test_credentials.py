"""Structural confirmation on keys built here, base spans against a walk over every start."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import time

import pytest

from siftwell.llm import credentials as C

from .conftest import ODD

#: The smallest tables hold no assigned secret.
TABLES = "/root/testdata/sf0.01"


def der(tag: int, *content: bytes) -> bytes:
    body = b"".join(content)
    size = len(body).to_bytes((len(body).bit_length() + 7) // 8) if len(body) > 127 else b""
    return bytes([tag, 128 + len(size)]) + size + body if size else bytes([tag, len(body)]) + body


def number(n: int) -> bytes:
    return der(2, n.to_bytes(n.bit_length() // 8 + 1))


P, Q = 2**521 - 1, 2**607 - 1  # primes
RSA = der(0x30, *map(number, (0, P * Q, 65537, pow(65537, -1, (P - 1) * (Q - 1)), P, Q, 3, 5, 7)))
EC = der(0x30, number(1), der(4, bytes(range(1, 33))), der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))))
PKCS8 = der(0x30, number(0), der(0x30, der(6, C.RSA), der(5)), der(4, RSA))
EDWARDS = der(0x30, number(0), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, bytes(range(32)))))
LOCKED = der(0x30, der(0x30, der(6, b"\x2a\x03"), der(0x30, number(9))), der(4, bytes(64)))


def string(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(4) + x for x in parts)


PUBLIC = string(b"ssh-ed25519", bytes(32))
SSH = b"openssh-key-v1\0" + string(b"none", b"none", b"") + (1).to_bytes(4) + string(PUBLIC, b"abcdabcd" + string(b"ssh-ed25519", bytes(32), bytes(64), b"me"))


def url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def token(alg: str = "HS256", size: int = 32, claims: object = {"sub": "x"}) -> str:  # noqa: B006
    return ".".join((url(json.dumps({"alg": alg}).encode()), url(json.dumps(claims).encode()), url(bytes(range(size)))))


def armour(data: bytes, label: str = "PRIVATE KEY", newline: str = "\n", width: int = 64) -> str:
    text = base64.b64encode(data).decode()
    lines = [text[i : i + width] for i in range(0, len(text), width)]
    return newline.join([f"-----BEGIN {label}-----", *lines, f"-----END {label}-----"])


@pytest.mark.parametrize("data", [RSA, EC, PKCS8, EDWARDS, LOCKED, SSH])
def test_structures_hold_to_the_last_byte(data):
    kind = "ssh" if data is SSH else "key"
    assert C.kind_of(data) == kind
    assert C.kind_of(data[:-1]) is None and C.kind_of(data + b"\0") is None and C.kind_of(b"") is None
    if data is not SSH:
        assert C.kind_of(bytes([0x31]) + data[1:]) is None


def test_numbers_and_checks_decide():
    wrong = der(0x30, *map(number, (0, P * Q + 2, 65537, 5, P, Q, 3, 5, 7)))
    assert C.kind_of(wrong) is None and C.kind_of(SSH.replace(b"abcdabcd", b"abcdabce")) is None
    long_form = RSA[:1] + b"\x83\x00" + RSA[2:]
    assert C.kind_of(long_form) is None


def test_tokens():
    assert C.signed_token(*token().split(".")) and C.signed_token(*token("RS256", 256).split(".")) and C.signed_token(*token("EdDSA", 64).split("."))
    for bad in (token("HS256", 31), token("none", 32), token("XX", 32), token(claims=[1]), token(alg=5)):
        assert not C.signed_token(*bad.split("."))


def planted(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """Prose with secrets in known places, and near misses."""
    text, spans = "", []
    good = [("key", armour(RSA, "RSA PRIVATE KEY")), ("key", armour(EC, "EC PRIVATE KEY", "\\n")), ("key", armour(LOCKED, "ENCRYPTED PRIVATE KEY", "\r\n", 76)), ("key", base64.b64encode(PKCS8).decode()), ("key", EDWARDS.hex().upper()), ("ssh", armour(SSH, "OPENSSH PRIVATE KEY")), ("ssh", SSH.hex().upper()), ("jwt", token()), ("jwt", token("ES256", 64))]
    bad = [armour(RSA[:-3], "RSA PRIVATE KEY"), base64.b64encode(bytes(range(200))).decode(), token("HS256", 30), "word " * 30, "é\U0001f511 ", "-----BEGIN PRIVATE KEY-----", "A" * 300]
    for _ in range(12):
        if rng.random() < 0.5:
            kind, s = rng.choice(good)
            spans.append((kind, len(text), len(text) + len(s)))
            text += s
        else:
            text += rng.choice(bad)
        text += rng.choice([" ", "\n\n", " , ", "é "])
    return text, sorted(spans)


def test_planted_secrets_are_found_and_nothing_else():
    rng = random.Random(5)
    for _ in range(150):
        text, spans = planted(rng)
        assert sorted(C.confirmed(text)) == spans


def brute(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by trying each start in turn, on the patterns as they are given."""
    text, out = text or "", []
    letters = "".join
    word = letters("(" + "|".join(letters(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")")
    for kind, pattern, group, least in (("assign", word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        at, rule = 0, re.compile(pattern)
        while at < len(text):
            m = rule.match(text, at)
            if m and len(m[group]) >= least:
                out.append((kind, *m.span()))
            at = m.end() if m else at + 1
    return out


def digests(text: str | None, extra=()) -> tuple:
    order = ("assign", "access", "hex", "key", "ssh", "jwt")
    line = lambda spans: ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (s[1], order.index(s[0]))))
    base = brute(text)
    n = [sum(k == kind for k, _, _ in base) for kind in order[:3]]
    return (*n, hashlib.sha256(line(base).encode()).hexdigest(), line([*base, *extra]))


def test_base_spans_on_odd_texts():
    rng = random.Random(3)
    bits = ["password", "PassWd", "toKen", "toKen", "ſecret", "api_key", "APIKEY", ":", "=", " ", "  ", '"', "'", "abc", "abcdef", "secret", "AKIA", "AKIA" + "Z" * 16, "Q7", "0123456789abcdef", "deadbeef", "g", "\n", "é", "."]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert sorted(C.base_spans(text)) == sorted(brute(text)), text


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in C.op12_secret_scan(spark, TABLES).collect()}
    assert got == {r.doc_id: digests(r.text) for r in rows} and any(x[0] for x in got.values())


def test_odd_rows(spark, make):
    text = f"key: {armour(RSA)} and token = {token()}"
    docs = make([*ODD, (1, text), (2, text)]).withColumnRenamed("D_Note", "spans")
    got = C.scan(docs).collect()
    assert len(got) == len(ODD) + 2 and all(not r.spans for r in got if r.doc_id not in (1, 2))
    assert all([(s.kind, s.confirmed) for s in r.spans] == [("key", True), ("assign", False), ("jwt", True)] for r in got if r.doc_id in (1, 2))
    assert C.scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["a", "0", "A", "password", "-----BEGIN PRIVATE KEY-----\n", "eyJ.", "a.", "token ", "MIIE", "M" * 64 + "\n"])
def test_very_long_texts_take_linear_time(unit):
    start = time.perf_counter()
    text = unit * (4_000_000 // len(unit))
    C.base_spans(text), C.confirmed(text)
    assert time.perf_counter() - start < 20
