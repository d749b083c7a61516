from __future__ import annotations

import itertools
from fractions import Fraction

from siftwell.llm import mixing

from .conftest import DOCS, ODD


def test_targets():
    assert mixing.targets({"a": 10, "b": 10}, {"a": 1, "b": 3}, 20) == {"a": 5, "b": 15}
    assert mixing.targets({"a": 100, "b": 1, "c": 10}, {"a": 1, "b": 2, "c": 3}, 111) == {"b": 3, "c": 30, "a": 78}
    assert mixing.targets({"a": 0, "b": 0}, {"a": 1, "b": 2}, 0) == {"a": 0, "b": 0}
    assert mixing.targets({}, {}, 0) == {}
    shares = mixing.targets({"a": 7, "b": 0, "c": 9}, {"a": 1, "b": 2, "c": 3}, 16)
    assert sum(shares.values()) == 16 and all(isinstance(x, Fraction) for x in shares.values()) and shares["b"] == 0


def test_flow_is_cheapest():
    groups = {("a",): 2, ("a", "b"): 2, ("b",): 1}
    quotas = {"a": 4, "b": 5}
    given = mixing.min_cost_flow(groups, quotas)
    best = None
    for flows in itertools.product(range(7), range(7), range(7), range(4)):  # a, ab to a, ab to b, b
        x, y, z, w = flows
        if x + y == 4 and z + w == 5 and y + z <= 6 and x <= 6 and w <= 3:
            cost = sum(k * k * max(0, min(n, used - n * (k - 1))) for n, used in ((2, x), (2, y + z), (1, w)) for k in (1, 2, 3))
            best = cost if best is None else min(best, cost)
    cost = sum(k * k * max(0, min(groups[g], sum(to.values()) - groups[g] * (k - 1))) for g, to in given.items() for k in (1, 2, 3))
    assert cost == best
    assert {s: sum(to.get(s, 0) for to in given.values()) for s in quotas} == quotas


def test_ties_meet_the_target(make):
    """Rows that nothing tells apart: a part of them is taken."""
    rows = [(None, "ten words that are the same in all of these rows", "en", "a")] * 1000 + [(i, "some other words", "en", "b") for i in range(2000)]
    frame = mixing.mix(make(rows), ("source",)).toPandas()
    for source, part in frame.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() / 2 + 0.5


def test_mix_meets_targets(make):
    rows = [(i, "w " * (1 + i * 7919 % 50), "en", None if i % 7 == 0 else f"s{min(i % 9, 3)}") for i in range(3000)] + [(i, t, "en", "odd") for i, t in ODD]
    frame = mixing.mix(make(rows), ("doc_id", "source")).toPandas()
    assert len(frame) == len(rows) and (frame["taken"] <= 3 * frame["size"]).all() and (frame["taken"] % frame["size"].clip(lower=1) == 0).all()
    total = frame["size"].sum()
    names = sorted({s for s in frame["source"] if s is not None and s == s}) + [None]
    sizes = {s: int(frame[frame["source"].isna() if s is None else frame["source"] == s]["size"].sum()) for s in names}
    want = mixing.targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, int(total))
    for s in names:
        part = frame[frame["source"].isna() if s is None else frame["source"] == s]
        assert abs(part["taken"].sum() - want[s]) <= 50 and part["target"].iloc[0] == float(want[s]) and part["source_size"].iloc[0] == sizes[s]
    again = mixing.mix(make(rows, 7), ("doc_id", "source")).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, frame[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_overlapping_sources(spark):
    """What each pattern takes is the cheapest way to meet the quotas, by trying all."""
    sizes = {("x",): 2, ("x", "y"): 3, ("y", "z"): 1, (None,): 2}
    rows = [(100 * i + k, "w", list(g) if g != (None,) else None) for i, (g, n) in enumerate(sizes.items()) for k in range(n)] + [(900, None, ["x"]), (901, "", [])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, held array<string>"), ("doc_id", "held"), sources="held").collect()
    assert len(out) == len(rows)
    order = ["x", "y", "z", None]
    held = {s: sum(n for g, n in sizes.items() if s in g) for s in order}
    want = mixing.targets(held, dict(zip(order, (1, 2, 3, 1))), sum(sizes.values()))
    quotas = {s: round(want[s]) for s in order}
    arcs = [(g, s) for g in sizes for s in g]
    best = None
    for flow in itertools.product(*(range(min(3 * sizes[g], quotas[s]) + 1) for g, s in arcs)):
        used = {g: sum(f for f, a in zip(flow, arcs) if a[0] == g) for g in sizes}
        got = {s: sum(f for f, a in zip(flow, arcs) if a[1] == s) for s in order}
        if all(used[g] <= 3 * sizes[g] for g in sizes) and all(got[s] <= quotas[s] for s in order):
            key = (-sum(flow), sum(k * k * max(0, min(n, used[g] - n * (k - 1))) for g, n in sizes.items() for k in (1, 2, 3)))
            best = min(best or key, key)
    taken = {g: sum(r.taken for r in out if tuple(r.held or [None]) == g) for g in sizes}
    assert (-sum(taken.values()), sum(k * k * max(0, min(n, taken[g] - n * (k - 1))) for g, n in sizes.items() for k in (1, 2, 3))) == best


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
