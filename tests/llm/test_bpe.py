from __future__ import annotations

import base64
import random
from array import array

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from siftwell.llm import bpe

from .conftest import ODD

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
EXACT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = ["a", "A", "é", "ß", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "0", "½", "中", "😀", "'s", "'LL", "!", "_", "‍", "\xa0", "the", "ing", "zzzzzzz", "<|endoftext|>"]


def test_random_texts_and_long_runs():
    pack = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    draw = random.Random(5)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    for text in [*texts, "a" * 4000, " " * 3000, "ab" * 3000, "\n" * 999, "é" * 999, "x" * 100_000]:
        assert array("I", pack(text)).tolist() == EXACT.encode_ordinary(text)


def test_every_token_and_pair_of_bytes():
    vocab = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    for token in list(RANKS)[::97]:
        assert vocab.encode(token) == [RANKS[token]]
    draw = random.Random(6)
    for _ in range(2000):
        data = bytes(draw.randrange(256) for _ in range(draw.randint(1, 12)))
        assert b"".join(vocab.bytes_of[i] for i in vocab.encode(data)) == data
        if data not in RANKS:
            assert vocab.encode(data) == vocab.merged(data)


def test_round_trip(make):
    rows = [*ODD, (1, "Hello wörld " * 500), (2, "it's")]
    out = bpe.decode(bpe.encode(make(rows))).collect()
    assert len(out) == len(rows)
    assert sorted(bytes(r.decoded) for r in out) == sorted((t or "").encode() for _, t in rows)
    by = {r.doc_id: array("I", bytes(r.ids)).tolist() for r in out}
    assert by[2] == EXACT.encode_ordinary("it's") and by[901] == []


def test_empty(make):
    assert bpe.decode(bpe.encode(make([(1, "x")]).where(F.lit(False)))).count() == 0
