from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import lines

from .conftest import DOCS, ODD


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def brute(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = [], {}
    for i, t in order:
        kept = []
        parts = (t or "").split("\n")
        for line in parts:
            if line.strip(" \t\n\r\x0b\x0c"):
                if line not in seen and not (len(line) >= 16 and any(len(s) >= 16 and distance_at_most_one(line, s) for s in seen)):
                    kept.append(line)
                seen.append(line)
            else:
                kept.append(line)
        out[i, t] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def test_against_brute_force(make):
    draw = random.Random(8)
    pool = ["".join(draw.choice("ab é") for _ in range(draw.choice([3, 15, 16, 17, 23, 24, 25, 48, 100, 301]))) for _ in range(60)]

    def edited(s):
        for _ in range(draw.choice([0, 1, 1, 2])):
            k = draw.randrange(len(s) + 1)
            s = draw.choice([s[:k] + "c" + s[k:], s[:k] + s[k + 1 :], s[:k] + "d" + s[k + 1 :]])
        return s

    rows = [(i * 31 % 211, "\n".join(edited(draw.choice(pool)) for _ in range(draw.randrange(0, 8)))) for i in range(200)] + ODD
    rows += [(300, "x" * 16), (301, "x" * 17), (302, "x" * 15), (303, " " * 20), (304, " " * 20), (305, "y" * 20 + "\n" + "y" * 20)]
    want = brute(rows)
    got = lines.without_repeated_lines(make(rows), ("source",)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == sorted((str(i), *want[i, t]) for i, t in rows)


def test_hot_near_lines(make):
    rows = [(i, f"common line number {chr(97 + i % 26)} of the set\nown {i} line that nobody else has {i * 7919}") for i in range(400)]
    got = {r.doc_id: r.n_dropped for r in lines.without_repeated_lines(make(rows)).collect()}
    want = brute(rows)
    assert got == {i: want[i, t][1] for i, t in rows}


def test_short_equal_lines(make, spark):
    rows = [(1, "yes\nno\nyes\n\n \n\nmaybe so"), (2, "no\nnot\nmaybe so\n\n \na line that is long enough"), (3, "a line that is long enougH\nnor\nyes\r")]
    want = {1: "yes\nno\n\n \n\nmaybe so", 2: "not\n\n \na line that is long enough", 3: "nor\nyes\r"}
    assert {r.doc_id: r.text for r in lines.without_repeated_lines(make(rows)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, make(rows), "").collect()} == want
    kept = {i: t for i, t in rows} | {3: "nor\nyes\r"}
    assert {r.doc_id: r.text for r in lines.without_repeated_lines(make(rows), shortest=16).collect()} == kept


def test_very_long_lines(make):
    draw = random.Random(3)
    line = "".join(draw.choice("abcdefgh ") for _ in range(1_000_000))
    rows = [(1, line), (2, line[:700_000] + "X" + line[700_001:]), (3, line[:5] + line[6:]), (4, line[:5] + "X" + line[6:-1])]
    assert {r.doc_id: r.n_dropped for r in lines.without_repeated_lines(make(rows)).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_equal_hashes_do_not_decide(make, monkeypatch):
    """All keys of the narrowing collide, and all variants of equal role: the comparison of the lines decides."""
    draw = random.Random(4)
    pool = ["".join(draw.choice("abc ") for _ in range(20)) for _ in range(12)]
    rows = [(i, "\n".join(draw.choice(pool)[: draw.choice([20, 19])] for _ in range(3))) for i in range(12)]
    monkeypatch.setattr(lines.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    want = brute(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.without_repeated_lines(make(rows)).collect()} == {i: want[i, t] for i, t in rows}


def test_empty(spark):
    assert lines.without_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0
