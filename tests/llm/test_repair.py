"""Repairs against every sequence of edits of small conversations, and against a plain table walk for long ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from siftwell.llm import repair as R

TURNS = "conv_id long, turn long, role string, text string, copies int"


def after_damage(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        kept = out.setdefault(c, [])
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        code, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        role = "user" if code == 4 else role
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, role, text)] * (2 if code == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r))) for c, rows in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_way(rows, kinds):
    """All edits with at most two inserts in a row, each judged by the whole grammar at the end."""
    steps = []
    for (_, role, _), kind in zip(rows, kinds):
        left = kind == "truncated"
        own = [("D", 3, "")]
        if kind in ("", "truncated"):
            own += [("K", left, role[:1] or "?"), ("R", 2 + left, "u"), ("R", 2 + left, "a")]
        steps += [[("", 0, ""), *(("I" * len(x), 2 * len(x), x) for x in ("u", "a", "ua", "au"))], own]
    steps.append([("", 0, ""), *(("I" * len(x), 2 * len(x), x) for x in ("u", "a", "ua", "au"))])
    best = None
    for way in itertools.product(*steps):
        if re.fullmatch("(s?(ua)+)?", "".join(w[2] for w in way)):
            item = (sum(w[1] for w in way), "".join(w[0] for w in way))
            best = item if best is None or item < best else best
    return best


def by_table(rows, kinds):
    """The same by a table over rows and states, for conversations of any length."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    table = {"": (0, "")}

    def put(new, q, cost, audit):
        if q is not None and (q not in new or (cost, audit) < new[q]):
            new[q] = (cost, audit)

    def inserted(table):
        for _ in range(3):
            for q, (cost, audit) in list(table.items()):
                put(table, "a" if q == "u" else "u", cost + 2, audit + "I")
        return table

    for (_, role, _), kind in zip(rows, kinds):
        new = {}
        for q, (cost, audit) in inserted(dict(table)).items():
            put(new, q, cost + 3, audit + "D")
            if kind in ("", "truncated"):
                left = kind == "truncated"
                put(new, step.get((q, role[:1])), cost + left, audit + "K")
                put(new, "a" if q == "u" else "u", cost + 2 + left, audit + "R")
        table = new
    return min(v for q, v in inserted(table).items() if q in ("", "a"))


def brute(rows, best):
    out = {}
    for c, kept in after_damage(rows).items():
        kinds, turns = faults(kept), [r[0] for r in kept if r[0] is not None]
        cost, audit = best(kept, kinds)
        source, said, text = iter(kept), 0, []
        for e in audit:
            row = next(source) if e != "I" else (None, None, "")
            if e == "D":
                continue
            said += not (e == "K" and row[1][0] == "s")
            text.append(f"{row[1] if e == 'K' else 'user' if said % 2 else 'assistant'}:{row[2]}")
        initials = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def answers(spark, rows, parts=5, most=R.ROWS):
    got = [tuple(r) for r in R.repair(spark.createDataFrame(rows, TURNS).repartition(parts), most).collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def small(rng, c):
    for t in range(rng.choice([1, 2, 3] if c % 20 else [4])):
        yield (c, t if rng.random() > 0.1 else rng.choice([None, 7, 3]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(["Hi.", "so", "Well! \n", " \t", "", None, "é?", "ok.", "a. b"]), 0)


def test_against_every_way(spark):
    rng = random.Random(11)
    rows = [r for c in range(120) for r in small(rng, c)] + [(None, 1, "user", "Hi.", 0), (None, 2, "assistant", "so", 0)]
    assert answers(spark, rows) == brute(rows, every_way)


@pytest.mark.parametrize("limit", [R.ROWS, 7])
def test_long_conversations_in_blocks(spark, limit):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "again.", ""]), 0) for c, n in ((1, 2500), (2, 300), (3, 90), (4, 1)) for t in range(n)]
    rows += rows[:50]
    assert answers(spark, rows, 3, limit) == brute(rows, by_table)


def test_blocks_of_every_size_agree():
    """Items joined block by block, whatever the cuts, are those of the whole."""
    rng = random.Random(8)
    for _ in range(300):
        edits = [(rng.choice("suat"), rng.random() < 0.2, rng.choice([1, 1, 3]), rng.randrange(2)) for _ in range(rng.randrange(1, 14))]
        whole, states, at = R.derive(edits, R.START), {R.START: (0, "")}, 0
        while at < len(edits):
            size = rng.randrange(1, 5)
            reached = {}
            for q, (cost, audit) in states.items():
                for r, (more, piece) in R.derive(edits[at : at + size], q).items():
                    item = (cost + more, audit + piece)
                    reached[r] = min(reached.get(r, item), item)
            states, at = reached, at + size
        assert states == whole
        assert next(iter(R.derive(edits, R.START, R.ACCEPTING).values())) == min(v for q, v in whole.items() if q in R.ACCEPTING)


def test_hot_copies_and_empty_table(spark):
    rows = [(1, 5, "user", "the same.", 0)] * 3000 + [(1, 6, "assistant", "Yes.", 0)]
    got = answers(spark, rows)[1]
    assert got == brute(rows, by_table)[1] and got[2] >= 2999
    assert answers(spark, []) == {}
