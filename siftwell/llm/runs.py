"""Front-coded sorted runs of byte strings, and their merge by a loser tree.

A run keeps of each string only what follows the prefix it shares with the one before. In the
tree every candidate carries the length of its common prefix with the last string put out: of
two candidates the one with the longer prefix is smaller, and only where these are equal are
bytes compared, from there on. So no byte of a known prefix is compared again.
"""

from __future__ import annotations

from collections.abc import Iterator


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least `at`: the rests as numbers differ from their first unequal byte on."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[at:n]) ^ int.from_bytes(b[at:n])).bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted strings of at most 255 bytes as (shared lengths, rest lengths, rests)."""
    shared, rests, last = bytearray(), [], b""
    for s in strings:
        k = common(last, s)
        shared.append(k)
        rests.append(s[k:])
        last = s
    return bytes(shared), bytes(map(len, rests)), b"".join(rests)


def front_decode(shared: bytes, sizes: bytes, rests: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(shared, sizes):
        last = last[:k] + rests[at : at + n]
        at += n
        out.append(last)
    return out


def merge(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in the run, prefix shared with the string before) in sorted order.

    runs: sorted strings, and the prefix each shares with the one before it in its run.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * len(runs)
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser's known prefix becomes that of the two."""
        x, y = heads[a], heads[b]
        if y is None:
            return True
        if x is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        n = common(x, y, known[a])
        first = n == len(x) or (n < len(y) and x[n] < y[n])
        known[b if first else a] = n
        return first

    winners = list(range(-k, k))  # winners[node]; leaves are the runs
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while runs and heads[best] is not None:
        yield best, at[best], known[best]
        at[best] += 1
        strings, shared = runs[best]
        if at[best] < len(strings):
            heads[best], known[best] = strings[at[best]], shared[at[best]]
        else:
            heads[best] = None
        node = (best + k) // 2
        while node:
            if not beats(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2
