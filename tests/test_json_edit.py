"""Edits in place against Python's json: the spans come from its decoder, everything else must be the same text."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from siftwell.functions import json_edit as E

SPACE = re.compile(r"[ \t\n\r]*")


def members(text):
    """(key, value start, value end) of the outer object, by json's own scanner."""
    decoder, out = json.JSONDecoder(), []
    at = SPACE.match(text, text.index("{") + 1).end()
    while text[at] != "}":
        key, at = decoder.raw_decode(text, at)
        at = SPACE.match(text, SPACE.match(text, at).end() + 1).end()
        _, end = decoder.raw_decode(text, at)
        out.append((key, at, end))
        at = SPACE.match(text, end).end()
        if text[at] == ",":
            at = SPACE.match(text, at + 1).end()
    return out


def brute(text, values):
    found = members(text)
    out = text
    for key, a, z in reversed(found):
        if values.get(key) is not None:
            out = out[:a] + values[key] + out[z:]
    for key, value in values.items():
        if value is not None and key not in [k for k, _, _ in found]:
            done = members(out)
            if done:
                first = SPACE.match(out, out.index("{") + 1).end()
                lead = out[out.index("{") + 1 : first]
                colon = out[json.JSONDecoder().raw_decode(out, first)[1] : done[0][1]]
                end = done[-1][2]
                out = out[:end] + f",{lead}{json.dumps(key)}{colon}{value}" + out[end:]
            else:
                at = out.index("{") + 1
                out = out[:at] + f"{json.dumps(key)}:{value}" + out[at:]
    return out


def odd(rng, depth=0):
    space = lambda: rng.choice(["", "", " ", "\n  ", "\t"])
    string = lambda: rng.choice(['"a"', '"id"', '"k,{["', r'"\"}"', r'"\\"', '"é\U0001f511"', r'"A"', r'"id"', '""'])
    kind = rng.randrange(7) if depth < 3 else rng.randrange(4)
    if depth == 0 or kind == 5:
        one = lambda: space() + string() + space() + ":" + space() + odd(rng, depth + 1) + space()
        return "{" + (",".join(one() for _ in range(rng.randrange(5))) or space()) + "}"
    if kind >= 4:
        return "[" + (",".join(space() + odd(rng, depth + 1) + space() for _ in range(rng.randrange(3))) or space()) + "]"
    return rng.choice([string(), "1.50", "-0.0", "1e5", "1E400", "12345678901234567890123456789012345678901234567", "null", "true", string()])


def edit(spark, texts, values):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").repartition(4)
    return [r.out for r in rows.withColumn("out", E.edited(F.col("raw"), {k: F.lit(v) for k, v in values.items()})).orderBy("i").collect()]


def test_against_the_decoder(spark):
    rng = random.Random(1)
    texts = [space + odd(rng) + space for _ in range(1500) for space in [rng.choice(["", " ", "\n"])]]
    for values in ({"id": '"B1"'}, {"a": '"x"', "new": "[1,{}]", "id": None}):
        got = edit(spark, texts, values)
        assert got == [brute(t, values) for t in texts]
        for text, out in zip(texts, got):
            want = json.loads(text) | {k: json.loads(v) for k, v in values.items() if v}
            assert json.loads(out) == want


def test_what_is_no_object_stays(spark):
    texts = ["[1]", "nope", "", "{} {}", "{}, {}", '{"a":1', '"{}"', "{'a':1}", '{"a":01}', None]
    assert edit(spark, texts, {"a": "2"}) == texts
    frame = spark.createDataFrame([(t,) for t in [*texts, " {} ", '{"a":{"a":1,"a":2}}']], "raw string")
    assert [r[0] for r in frame.select(E.is_object(F.col("raw"))).collect()] == [False] * len(texts) + [True, True]


def test_long_documents_and_strings(spark):
    deep = "[" * 900 + "]" * 900
    texts = ['{"big": "' + 'x\\n{"' [:4] * 300_000 + '", "id": 1}', '{"id": 1, "deep": ' + deep + "}", "{" + ",".join(f'"k{i}": {i}' for i in range(20_000)) + ', "id": 0}']
    assert edit(spark, texts, {"id": "7"}) == [brute(t, {"id": "7"}) for t in texts]


def test_json_strings(spark):
    texts = ["", 'q"\\', "a\nb\t\x01", "é\U0001f511", "/"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(E.json_string(F.col("t"))).collect()
    assert [json.loads(r[0]) for r in rows] == texts
