"""Content-chosen anchors of byte strings.

Every string of LENGTH bytes has one anchor: the leftmost of its GRAM-byte substrings with the
smallest hash. Equal strings have it at the same place, so strings can only be equal where their
anchors are. Strings that begin at consecutive places and share an anchor form a block.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .shingles import mix, powers, stream

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1


class Blocks(NamedTuple):
    """Blocks of a batch; places count from the batch's first byte."""

    text: np.ndarray
    first: np.ndarray  # place of the first string
    count: np.ndarray  # strings in the block
    anchor: np.ndarray  # place of the anchor
    gram: np.ndarray  # hash of the anchor


def prefix_sums(data: np.ndarray, seed: int = 3) -> np.ndarray:
    codes = stream(256, seed)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks(data: np.ndarray, offsets: np.ndarray) -> Blocks:
    """All blocks of the texts data[offsets[i]:offsets[i + 1]]."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return Blocks(e, e, e, e, e.astype(np.uint64))
    sums = prefix_sums(data)
    starts = np.arange(len(data) - GRAM + 1)
    up, down = powers(len(sums))
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(starts)])
    least = sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64), SPAN)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n, bool)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= LENGTH)
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, offsets[long], 1)
    np.add.at(marks, offsets[long] + sizes[long] - LENGTH + 1, -1)
    inside = np.cumsum(marks[:-1]) > 0
    new = np.empty(n, bool)
    new[0] = inside[0]
    new[1:] = inside[1:] & (~inside[:-1] | (anchor[1:] != anchor[:-1]))
    new[offsets[long]] = True
    first = np.flatnonzero(new)
    stop = np.empty(n + 1, bool)
    stop[0] = False
    stop[1:-1] = inside[:-1] & (~inside[1:] | new[1:])
    stop[-1] = inside[-1]
    count = np.flatnonzero(stop) - first
    at = anchor[first]
    return Blocks(np.searchsorted(offsets, first, "right") - 1, first, count, at, grams[at])
