from __future__ import annotations

import random

from pyspark.sql import functions as F

from siftwell.llm import licenses as L

from .conftest import ODD


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rising():
    draw = random.Random(12)
    for _ in range(300):
        p = draw.sample(range(30), draw.randrange(0, 12))
        got = [p[i] for i in L.rising(p)]
        assert got == sorted(got)
        best = [1] * len(p)
        for i in range(len(p)):
            best[i] += max((best[j] for j in range(i) if p[j] < p[i]), default=0)
        assert len(got) == max(best, default=0)


def test_alignment_is_common_and_best_without_repeats():
    draw = random.Random(13)
    for _ in range(300):
        a, b = ([draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(0, 15))] for _ in range(2))
        found = L.align(a, b)
        assert all(a[x] == b[y] for x, y in found) and all(x < u and y < v for (x, y), (u, v) in zip(found, found[1:]))
        assert len(found) <= lcs(a, b)
        p, q = draw.sample(range(40), 12), draw.sample(range(40), 12)
        assert len(L.align(p, q)) == lcs(p, q)


def test_scan_finds_planted_templates(make):
    draw = random.Random(14)
    noise = lambda n: " ".join(draw.choice(["the", "of", "software", "license", "and", "to", "any", "lorem", "ipsum", "dolor"]) for _ in range(n))
    rows, want = [*ODD], {}
    for i, (name, text) in enumerate(L.TEMPLATES.items()):
        words = text.split()
        cut = [w for k, w in enumerate(words) if len(words) < 15 or k % 12]
        rows += [(i, noise(300) + "\n" + text.upper() + "\n" + noise(300)), (100 + i, noise(7) + " " + " ".join(cut)), (200 + i, text + "\n" + text)]
        want |= {i: name, 100 + i: name, 200 + i: name}
    rows += [(500 + i, noise(400)) for i in range(20)]
    got = {r.doc_id: {m.license for m in r.licenses} for r in L.scan(make(rows)).collect()}
    assert all(name in got[i] for i, name in want.items())
    assert not any(got[500 + i] for i in range(20)) and not any(got[i] for i in (900, 901, 902, 903))


def densest_alignment(words, template):
    """Matched words of the best local alignment: a match gives 1, a text word skipped inside it costs GAP_COST, template words may be skipped."""
    none = (0.0, 0)
    row, best = [none] * (len(template) + 1), none
    for w in words:
        new = [none] * (len(template) + 1)
        for j, t in enumerate(template, 1):
            skipped = row[j][0] - L.GAP_COST
            options = [none, new[j - 1], (skipped, row[j][1]) if skipped > 0 else none]
            if w == t:
                options.append((row[j - 1][0] + 1, row[j - 1][1] + 1))
            new[j] = max(options)
        row = new
        best = max(best, *row)
    return best[1]


def test_scan_against_every_alignment(make):
    """Templates with words left out, replaced and put in, at any place: found where the best alignment covers them."""
    draw = random.Random(15)
    names = ["GPL-3.0 (notice)", "ISC (text)", "Apache-2.0 (notice)", "MIT"]
    rows = []
    for i in range(60):
        words = [w for w in L.tokens(L.TEMPLATES[names[i % 4]]) if draw.random() > draw.choice([0, 0.1, 0.3])]
        rate = draw.choice([0, 0.1, 0.3, 0.8])
        words = [x for w in words for x in ([f"n{draw.randrange(99)}"] if draw.random() < rate else []) + [w]]
        rows.append((i, " ".join([*(f"a{draw.randrange(99)}" for _ in range(draw.randrange(120))), *words, *(f"b{k}" for k in range(draw.randrange(80)))])))
    chosen = {n: L.TEMPLATES[n] for n in names}
    got = {r.doc_id: {m.license: m.matched for m in r.licenses} for r in L.scan(make(rows), chosen).collect()}
    for i, text in rows:
        for name in names:
            template = L.tokens(chosen[name])
            best = densest_alignment(L.tokens(text), template)
            assert got[i].get(name, 0) <= best
            if best >= 0.86 * len(template):
                assert got[i].get(name, 0) >= 0.93 * best, (i, name)
            if best < 0.8 * len(template):
                assert name not in got[i]


def test_folder_long_texts_and_clashing_columns(spark, make, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do with this text whatever you like,\nbut never call it yours.")
    assert L.templates_in(spark, str(tmp_path)) == {"Own-1.0": "You may do with this text whatever you like,\nbut never call it yours."}
    rows = [(1, "pad " * 200_000 + "you may do with this text whatever you like but never call it yours")]
    frame = make(rows).withColumns({c: F.lit(1) for c in ("licenses", "words", "license")})
    (r,) = L.scan(frame, L.templates_in(spark, str(tmp_path))).collect()
    assert [(m.license, m.matched, m["first"]) for m in r.licenses] == [("Own-1.0", 14, 200_000)]


def test_places_and_empty(make):
    out = {r.doc_id: r.licenses for r in L.scan(make([(1, "a b c Released under the MIT License. d")])).collect()}
    (m,) = out[1]
    assert (m.license, m.matched, m.words, m["first"], m["last"]) == ("MIT", 5, 5, 3, 7)
    assert L.scan(make([(1, "x")]).limit(0)).count() == 0
