"""The trie against a walk over plain Python prefixes, and contraction on trees of every shape."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftwell.llm import tries

TURNS = "conv_id long, turn long, role string, text string, depth int"


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {n: [m for m in nodes if m[: len(n)] == n] for n in nodes}
    out = set()
    for n, members in nodes.items():
        leaves = [m for m in below[n] if len(below[m]) == 1]
        saved = sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in below[n] if m)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(n))
        children = sum(len(m) == len(n) + 1 for m in below[n])
        out.add((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), 101, 203, 500]:
        kind = c % 7 if c < 40 else 9
        for t in range(rng.choice([1, 2, 4, 9, 12]) if c < 101 else 75):  # past two blocks of turns
            text = "same" if kind < 4 else rng.choice(["a", "b", "é" * t])
            rows.append((c, t if rng.random() > 0.02 or t else None, rng.choice(["user", "user", None]) if kind > 4 else "user", None if rng.random() < 0.03 else text, 3))
    rows += [(None, 1, "user", "left out", 3)]
    got = tries.trie(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(rows)


def test_one_hot_conversation_and_repeated_rows(spark):
    rows = [(5, t, "user", f"{t % 3}", 0) for t in range(1500)] + [(7, 1, "user", "x", 0)] * 3 + [(9, None, None, None, 0)]
    got = {tuple(r) for r in tries.trie(spark.createDataFrame(rows, TURNS).repartition(7)).collect()}
    assert got == brute(rows) and max(r[1] for r in got) == 1500


def test_empty_table(spark):
    assert tries.trie(spark.createDataFrame([], TURNS)).collect() == []


def shapes(rng):
    yield "chain", [None, *range(60)]
    yield "star", [None] + [0] * 40
    yield "comb", [None] + [i - 1 if i % 2 else i - 2 for i in range(1, 50)]
    yield "random", [None] + [rng.randrange(max(0, i - 5), i) for i in range(1, 120)]
    yield "two roots", [None, None, 0, 1, 2, 2]


def test_contraction_on_every_shape(spark):
    for name, parents in shapes(random.Random(4)):
        weight = [i % 7 + 1 for i in range(len(parents))]
        want = list(weight)
        for i in reversed(range(len(parents))):
            if parents[i] is not None:
                want[parents[i]] += want[i]
        tree = spark.createDataFrame([(i, p, w, 1) for i, (p, w) in enumerate(zip(parents, weight))], "node long, parent long, w long, one long")
        got = {r.node: r.w for r in tries.subtree_totals(tree, "w", "one").collect()}
        assert got == dict(enumerate(want)), name
        assert tries.subtree_totals(tree, "w", "one").where("node = 0").agg(F.sum("one")).first()[0] <= len(parents)
