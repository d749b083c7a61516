from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from siftwell.llm import minhash
from siftwell.llm.components import components
from siftwell.llm.shingles import exact_sets, shingle_sets

from .conftest import DOCS, ODD

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(list(zip((i for i, _ in rows), sets)), 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def near_copies(draw, words, n):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"new{draw.randrange(10**9)}"
    return " ".join(out)


def test_shingle_sets_count_like_python():
    draw = random.Random(1)
    texts = ["".join(draw.choice("aB é\t\n\x1c\x0b x") for _ in range(draw.randint(0, 60))) for _ in range(500)] + [None, "", " ", "one", "one two"]
    for width in (1, 3, 5):
        _, cuts = shingle_sets(pa.array(texts), width)
        assert cuts.tolist() == exact_sets(pa.array(texts), width)[1].tolist()
        assert np.diff(cuts).tolist() == [len(shingles(t, width)) for t in texts]
        _, cuts = shingle_sets(pa.array(["zz", *texts]).slice(1), width)
        assert np.diff(cuts).tolist() == [len(shingles(t, width)) for t in texts]


def test_components_are_exact(make):
    draw = random.Random(2)
    rows, n = [*ODD], 0
    for g in range(25):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([4, 30, 120, 400]))]
        for _ in range(draw.randint(1, 8)):
            rows.append((n * 37 % 1009, near_copies(draw, base, draw.randrange(0, max(2, len(base) // 15)))))
            n += 1
    # a chain whose ends are far apart
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        rows.append((2000 + (k * 5) % 12, " ".join(chain[4 * k :] + [f"d{i}" for i in range(4 * k)])))
    for width, percent in ((3, 85), (5, 80)):
        got = sorted((tuple(r) for r in minhash.near_duplicates(make(rows), width, percent).collect()), key=str)
        assert got == brute(rows, width, percent)


def test_repeated_rows_lose_no_link_of_a_large_family(make):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(300)]

    def copy(places):
        return " ".join(f"new{draw.randrange(10**9)}" if i in places else w for i, w in enumerate(base))

    # smaller ids just below the threshold take the buckets of two rows above it
    rows = [(i, copy(set(draw.sample(range(5, 295, 5), 9)))) for i in range(30)]
    rows += [(100, " ".join(base)), (101, copy(set(range(10, 290, 40))))] * 8
    got = sorted((tuple(r) for r in minhash.near_duplicates(make(rows), 3, 85).collect()), key=str)
    assert got == brute(rows, 3, 85)


def test_words_with_equal_polynomials_differ(make):
    """Words of Thue-Morse order and their complements, which polynomial hashes modulo 2^64 can't tell apart."""
    bits = "0"
    while len(bits) < 1024:
        bits += bits.translate(str.maketrans("01", "10"))
    t, u = bits.translate(str.maketrans("01", "ab")), bits.translate(str.maketrans("01", "ba"))
    rows = [(1, f"{t} x y"), (2, f"{u} x y"), (3, f"{t} {u} {t} {u} {t} x"), (4, f"{t} x y")]
    got = sorted((tuple(r) for r in minhash.near_duplicates(make(rows), 3, 85).collect()), key=str)
    assert got == brute(rows, 3, 85) and [r[3] for r in got] == [True, True, True, False]


def test_exact_sets():
    """Sets of equal hashes are compared word by word."""
    a, b = pa.array(["a b c d", "x y", "p q r"]), pa.array(["a b c e", "x z", "p q r"])
    exact, cuts = exact_sets(pa.concat_arrays([a, b]), 3)
    sets = [set(exact[i:j].tolist()) for i, j in zip(cuts, cuts[1:])]
    assert [len(sets[k] & sets[k + 3]) for k in range(3)] == [1, 0, 1]


def test_ids_with_several_texts(make):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "k l m n"), (3, "k l m n"), (4, "other words all over")]
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(make(rows), 3, 85).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_likelihood_keeps_what_is_near():
    rng = np.random.default_rng(3)
    for share, least, keeps in ((0.9, 0.85, True), (0.85, 0.85, True), (0.4, 0.85, False)):
        n = 400
        common = round(2 * n * share / (1 + share))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
        x, y = minhash.registers(a, np.array([0])), minhash.registers(b, np.array([0]))
        assert abs((x == y).mean() - share) < 0.15
        assert minhash.likely(x, y, np.array([float(n)]), np.array([float(n)]), least)[0] == keeps


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101)], "a long, b long").repartition(4)
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
    assert components(links.limit(0)).count() == 0


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
