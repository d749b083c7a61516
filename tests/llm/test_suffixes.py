from __future__ import annotations

import hashlib
import random

import numpy as np

from siftwell.llm import runs, suffixes

from .collide import words
from .conftest import DOCS, ODD


def brute(rows):
    seen, out = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    for i, t in order:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if seen.setdefault(w, (i, t, p)) != (i, t, p):
                cover[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[i, t] = (len(b), len(b) - len(kept), sum(cover[k] and not (k and cover[k - 1]) for k in range(len(b))), kept)
    return out


def cases():
    draw = random.Random(3)
    base = "".join(draw.choice("abcdeé \n") for _ in range(400))
    rows = []
    for k in range(60):
        text = ""
        while draw.random() < 0.8:
            a = draw.randrange(300)
            text += base[a : a + draw.randrange(20, 300)] + "".join(draw.choice("xyz") for _ in range(draw.randrange(0, 60)))
        rows.append((k, text))
    return [*rows, *ODD, (200, "a" * 1000), (201, "b" + "a" * 500), (204, "ab" * 300), (205, base * 5), (206, base[:99]), (206, base[:99]), (207, rows[5][1])]


def check(make, rows):
    want = brute(rows)
    got = suffixes.without_repeats(make(rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((str(i), *want[i, t]) for i, t in rows)


def test_against_brute_force(make):
    check(make, cases())


def test_split_anchors_and_long_texts(make, spark):
    rows = cases()
    want = brute(rows)
    got = suffixes.without_repeats(make(rows), part=2, text_bytes=700).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((str(i), *want[i, t]) for i, t in rows)


def test_texts_of_one_id_and_one_hash(make, spark):
    one, other = words()
    draw = random.Random(5)
    tail = "".join(draw.choice("pqrst") for _ in range(150))
    a, b = spark.createDataFrame([(one + tail,), (other + tail,)], "t string").selectExpr("xxhash64(t) AS h").collect()
    assert one != other and a.h == b.h
    check(make, [(7, one + tail), (7, other + tail), (None, one + tail), (None, other + tail), (7, tail), (7, tail)])


def periodic():
    draw = random.Random(6)
    noise = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    rows = []
    for k in range(60):
        text = noise(draw.randrange(0, 150))
        for _ in range(draw.randrange(1, 4)):
            unit = noise(draw.randrange(1, 22)) if draw.random() < 0.5 else draw.choice(["a", "ab", "&nbsp;", "- ", "aab"])
            text += unit * draw.randrange(1, 400 // len(unit)) + noise(draw.choice([0, 1, 60, 130]))
        rows.append((k, text))
    return [*rows, *[(100 + k, "z" * k) for k in (99, 100, 101, 116)], (300, "ab" * 50), (301, "ab" * 50 + "a"), (302, "z" * 5000)]


def test_runs_of_short_periods(make):
    check(make, periodic())
    rows = periodic()
    want = brute(rows)
    got = suffixes.without_repeats(make(rows), part=2, text_bytes=333).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((str(i), *want[i, t]) for i, t in rows)


def test_nearby_repeats_against_brute_force():
    texts = [t.encode() for _, t in periodic()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [{x for x in range(1, len(t) - 99) if any(x >= p and t[x : x + 100] == t[x - p : x - p + 100] for p in range(1, 17))} for t in texts]
    places = lambda found: {x for a, b in zip(*found) for x in range(a, b)}
    assert places(suffixes.nearby(data, offsets)) == {offsets[i] + x for i, s in enumerate(want) for x in s}
    assert all(places(suffixes.nearby_in_text(t, most)) == s for t, s in zip(texts, want) for most in (50, 333, 1 << 20))


def test_a_long_run_needs_no_search():
    text = np.full(1 << 20, 32, np.uint8)
    ends = np.array([0, len(text)])
    assert len(suffixes.blocks(text, ends).first) > 1_000_000 and len(suffixes._searched(suffixes.blocks(text, ends), text, ends).first) == 1


def test_merge_of_runs():
    draw = random.Random(4)
    for n_runs in (0, 1, 2, 3, 5, 8):
        lists = [sorted(bytes(draw.choice(b"ab") for _ in range(draw.randrange(0, 40))) for _ in range(draw.randrange(0, 30))) for _ in range(n_runs)]
        coded = [runs.front_code(x) for x in lists]
        assert [runs.front_decode(*c) for c in coded] == lists
        out = list(runs.merge([(x, c[0]) for x, c in zip(lists, coded)]))
        strings = [lists[r][i] for r, i, _ in out]
        assert strings == sorted(s for x in lists for s in x)
        assert [k for _, _, k in out] == [runs.common(a, b) for a, b in zip([b"", *strings], strings)]


def test_empty(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], DOCS)).count() == 0
