from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np

from siftwell.llm import quality

from .collide import words
from .conftest import DOCS, ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 5))
    rows = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(rows) - len(set(rows)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_base_counts(make):
    draw = random.Random(9)
    rows = [(i, "".join(draw.choice(["a ", "b ", "cé ", "\n", "#", "* ", "\x1c", "\t", "😀 "]) for _ in range(draw.randrange(0, 120)))) for i in range(300)] + ODD
    got = quality.judge(make(rows)).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(((i, *base(t)) for i, t in rows), key=key)
    assert not any(r.kept and r.base_failed for r in got)


def test_words_of_one_hash_are_no_repeat(spark, make):
    one, other = words()
    a, b = spark.createDataFrame([(one,), (other,)], "w string").selectExpr("xxhash64(w) AS h").collect()
    assert one != other and a.h == b.h
    tail = "one two three four"
    rows = [(1, " ".join(f"w{i}" for i in range(8)) + f" {one} {tail} {other} {tail}"), (2, f"{one} {tail} {one} {tail} five")]
    got = {r.doc_id: r.n_repeat_words for r in quality.judge(make(rows)).collect()}
    assert got == {i: base(t)[4] for i, t in rows} == {1: 0, 2: 10}


def clean(draw):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(30, 200)))


def test_outliers_go_and_clean_documents_stay(make):
    draw = random.Random(10)
    rows = [(i, clean(draw), "en" if i % 2 else "de", f"s{i % 2}") for i in range(600)]
    rows += [(1000 + i, "### ".join(clean(draw).split()), "en", "s1") for i in range(40)]
    rows += [(2000, clean(draw), None, None), (2001, "x" * 50 + " " + clean(draw), "fr", "rare")]
    got = {r.doc_id: r.kept for r in quality.judge(make(rows)).collect()}
    assert all(got[i] for i in range(600)) and got[2000] and got[2001]
    assert not any(got[1000 + i] for i in range(40))


def test_a_third_of_copies_goes(make):
    draw = random.Random(12)
    junk = " ".join(f"{draw.randrange(10**4, 10**6)}##&&%" for _ in range(60))
    rows = [(i, clean(draw), "en", f"s{i % 2}") for i in range(400)]
    rows += [(1000 + i, junk, "en", "s0") for i in range(100)] + [(2000, junk, "en", "s1")] * 100
    got = quality.judge(make(rows)).collect()
    assert not any(r.base_failed for r in got) and all(r.kept == (r.doc_id < 1000) for r in got)


def table(spark, rows, source="s"):
    return spark.createDataFrame([(False, "en", source, *map(int, r)) for r in rows], "base_failed boolean, lang string, source string, v0 long, v1 long, v2 long, v3 long")


def test_copies_in_the_tie_bin_count_with_the_missing_weight(spark):
    noise = np.random.default_rng(1).normal(size=(200, 4)) * np.array([40, 40, 0, 0])
    rows = np.abs(np.round(np.array([430, 0, 0, 0]) + noise)).astype(int).tolist() + [[430, 105, 0, 0]] * 100
    fit = quality.fits(quality.grouped(table(spark, rows), 20)[0])
    copies = spark.createDataFrame([(430, 105, 0, 0)], "v0 long, v1 long, v2 long, v3 long")
    assert quality.distance(copies.crossJoin(fit)).first().d2 > 5


def regularised(y):
    return quality.GROW * np.cov(y.T, bias=True) + np.diag(np.array(quality.FLOORS) ** 2)


def test_least_determinant_of_all_halves(spark):
    """A small group, against every subset of half its size."""
    rng = np.random.default_rng(5)
    for seed in range(3):
        x = np.round(np.vstack([rng.normal([400, 60, 30, 40], [30, 40, 20, 40], (9, 4)), rng.normal([700, 300, 150, 200], 30, (4, 4))])).astype(int)
        h = (len(x) + quality.P + 1) // 2
        y = x / quality.SCALE
        least = min(np.linalg.det(regularised(y[list(s)])) for s in itertools.combinations(range(len(x)), h))
        fit = quality.fits(quality.grouped(table(spark, x), 5)[0]).first()
        assert least * (1 - 1e-9) <= fit.det <= least * 1.05


def test_distances_match_numpy_at_the_fixed_point(make):
    """The fit is that of the half nearest to it, and distances are those of numpy."""
    draw = random.Random(11)
    rows = [(i, ("## " if i % 3 == 0 else " ").join(clean(draw).split()), "en", "s") for i in range(300)]
    stats = quality.statistics(make(rows)).toPandas().sort_values("doc_id")
    got = quality.judge(make(rows)).toPandas().sort_values("doc_id")
    assert not stats["base_failed"].any()
    y, d2 = stats[quality.V].to_numpy() / quality.SCALE, got["distance"].to_numpy()
    core = y[np.argsort(d2, kind="stable")[: (len(y) + quality.P + 1) // 2]]
    z = np.linalg.solve(np.linalg.cholesky(regularised(core)), (y - core.mean(axis=0)).T)
    assert np.allclose(d2, (z**2).sum(axis=0), rtol=0.05, atol=0.02)
    again = quality.judge(make(rows, 7)).toPandas().sort_values("doc_id")
    assert (d2 == again["distance"].to_numpy()).all()


def test_small_groups_use_their_language(make):
    draw = random.Random(13)
    rows = [(i, clean(draw), "en", "big") for i in range(60)] + [(100 + i, clean(draw), "en", "small") for i in range(5)] + [(200, clean(draw), "de", 'a"],["b')]
    vectors, chosen = quality.grouped(quality.statistics(make(rows)), 20)
    assert {(r._lang, r._source): r.g for r in chosen.collect()} == {("=en", "=big"): '["=en","=big"]', ("=en", "=small"): '["=en"]', ("=de", '=a"],["b'): "[]"}
    assert {r.g: r.n for r in vectors.select("g", "n").distinct().collect()} == {'["=en","=big"]': 60, '["=en"]': 65, "[]": 66}


def test_chi_square():
    assert abs(quality.chi_square_at(0.95, 4) - 9.487729) < 1e-5 and abs(quality.chi_square_at(0.5, 6) - 5.348121) < 1e-5


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0
