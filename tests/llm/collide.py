"""Two words of 64 letters with the same xxHash64, by solving one lane of its second stripe."""

from __future__ import annotations

import random

MASK = (1 << 64) - 1
P1, P2 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F


def _lane(state: int, value: int) -> int:
    state = (state + value * P2) & MASK
    return ((state << 31 | state >> 33) & MASK) * P1 & MASK


def words(seed: int = 42) -> tuple[str, str]:
    draw, start = random.Random(1), (seed + P1 + P2) & MASK
    letters = lambda n: bytes(draw.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    word = letters(64)
    before = _lane(start, int.from_bytes(word[:8], "little"))
    while True:
        head = letters(8)
        after = _lane(start, int.from_bytes(head, "little"))
        lane = (int.from_bytes(word[32:40], "little") + (before - after) * pow(P2, -1, 1 << 64)) & MASK
        other = head + word[8:32] + lane.to_bytes(8, "little") + word[40:]
        if other != word and all(33 <= b < 127 for b in other):
            return word.decode(), other.decode()
