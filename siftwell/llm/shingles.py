"""Word shingles of whole texts, for many texts at once.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A batch's distinct words
are looked up by content and each is named by 64 bits of a cryptographic hash; a shingle's hash
mixes those of its words in order. For comparisons within a batch, shingles get exact numbers.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each byte, and whether it is white space."""
    codes = np.arange(256, dtype=np.uint8)
    codes[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return codes, space


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, at least n of each."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, _U)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=_U)
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more at the end). Nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code, distinct words that the codes name, text) of all words in order."""
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    lower, space = _letters()
    blank = space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, blank[1:]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(lower[data[~blank]])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.searchsorted(offsets, starts, "right") - 1


def _runs(of: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where shingles of `width` words begin; texts with fewer words; where each text's words begin."""
    counts = np.bincount(of, minlength=n_texts)
    inside = max(len(of) - width + 1, 0)
    whole = np.flatnonzero(of[:inside] == of[width - 1 : width - 1 + inside])
    return whole, np.flatnonzero((counts > 0) & (counts < width)), np.append(np.cumsum(counts) - counts, len(of))


def _columns(words: np.ndarray, of: np.ndarray, n_texts: int, width: int, nothing: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each shingle, one array per place, and its text. Fewer words than width: all of them as one, `nothing` in place of the rest."""
    whole, short, first = _runs(of, n_texts, width)
    columns = []
    for k in range(width):
        there = first[short] + k < first[short + 1]
        lone = np.full(len(short), nothing, words.dtype)
        lone[there] = words[first[short[there]] + k]
        columns.append(np.concatenate([words[whole + k], lone]))
    return columns, np.concatenate([of[whole], short])


def _sets(shingles: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, and where each text's begin."""
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[new], owner[new]
    return shingles, np.searchsorted(owner, np.arange(n_texts + 1))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hashes, where each text's begin)."""
    data, offsets = buffers(texts)
    codes, distinct, of = words_of(data, offsets)
    names = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in distinct.to_pylist()), _U) | _U(1)
    columns, owner = _columns(names[codes], of, len(offsets) - 1, width, 0)
    total = np.zeros(len(owner), _U)
    for column, odd in zip(columns, stream(width, 99)):
        total = mix(total + column * odd)
    return _sets(total, owner, len(offsets) - 1)


def exact_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_sets, but numbers in place of hashes: equal within this batch only for equal words in order."""
    data, offsets = buffers(texts)
    codes, distinct, of = words_of(data, offsets)
    columns, owner = _columns(codes + 1, of, len(offsets) - 1, width, 0)
    total = columns[0]
    for column in columns[1:]:
        total = np.unique(total * (len(distinct) + 1) + column, return_inverse=True)[1]
    return _sets(total, owner, len(offsets) - 1)
