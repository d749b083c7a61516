"""Byte-level BPE encoding and decoding.

Bytes become Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds
every token that ends at a place. A piece is encoded from left to right with the longest match;
a token may follow another only if the plain merges of their joined bytes give back just these
two (memoised); where that fails, the next shorter token is tried, then the previous one is
taken back. A place once given up is never tried again, so the work is linear in the piece.

Null and empty texts have no ids and decode to nothing. Rows are independent: repeated rows give
repeated results, an empty table an empty one. Other columns are dropped.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches

#: Entries kept in each memo of a worker before it is emptied.
MEMO = 400_000
#: Longer pieces (in bytes) are not memoised.
MEMO_PIECE = 64
#: The piece pattern for ASCII text, where Python's faster `re` gives the same matches.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


class Vocabulary:
    """Ranks of byte strings, with the searches that encoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size = [len(b) for b in self.bytes_of]
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merges, lowest rank first, leftmost first among equals. For short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether b may follow a."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        known = self.shorter.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = self.shorter[token] = next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size = len(piece), self.size
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end - size[token] + 1
            if longest[start] < 0 or size[token] > size[longest[start]]:
                longest[start] = token
        usable, out, at = bytearray(b"\1" * (n + 1)), [], 0
        token = longest[0] if n else -1
        while at < n or token >= 0:
            while token >= 0 and not (usable[at + size[token]] and (not out or self.adjacent(out[-1], token))):
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                usable[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                token = out.pop()
                at -= size[token]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


class _Packed(dict):
    """piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        ids = array("I", self.vocab.encode(data))
        if array("H", [1]).tobytes()[0] != 1:
            ids.byteswap()
        packed = ids.tobytes()
        if len(data) <= MEMO_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """text -> packed ids. White space is Unicode's White_Space, as in the Rust tokenizer."""
    import public_tokenizers
    import regex

    packed = _Packed(vocabulary(path))
    every = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    ascii_only = re.compile(ASCII_PATTERN).findall if pattern == public_tokenizers.PATTERN else every
    one = packed.__getitem__
    return lambda text: b"".join(map(one, (ascii_only if text.isascii() else every)(text)))


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids holds the token ids as little-endian unsigned 32-bit integers."""
    import public_tokenizers

    path, pattern = path or ranks_path(), pattern or public_tokenizers.PATTERN
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = encoder(path, pattern)
        for batch in pieces(batches, "text"):
            ids = [pack(text) if text else b"" for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids binary")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): the bytes that the ids stand for."""
    path = path or ranks_path()
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bytes_of = vocabulary(path).bytes_of.__getitem__
        for batch in pieces(batches, "ids"):
            out = [b"".join(map(bytes_of, np.frombuffer(ids or b"", "<u4").tolist())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], [id_col, "ids", "decoded"])

    rows = encoded.select(id_col, "ids")
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids binary, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
