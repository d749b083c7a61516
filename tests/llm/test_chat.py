from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftwell.llm import chat

CALLS = "id string, at int, name string, arguments string, after string"
SCHEMAS = {"f": {"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "string", "maxLength": 3}}}}


def linked(spark, calls, results):
    out = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "id string, at int, content string"), SCHEMAS)
    return sorted(out.collect(), key=lambda r: (str(r.id), r.status, r.at))


def test_links_and_levels(spark):
    calls = [("c1", 1, "f", '{"b":"x","a":1}', None), ("c2", 3, "f", '{"a":2}', "c1"), ("c3", 5, "f", '{"a":3}', "c2"), ("c4", 6, "f", '{"a":3}', "gone"), ("p", 7, "f", '{"a":1}', "q"), ("q", 8, "f", '{"a":1}', "p"), ("s", 9, "f", '{"a":1}', "s")]
    rows = {r.id: r for r in linked(spark, calls, [("c1", 2, "r é\n"), ("c3", 6, None), ("o", 1, "lost")])}
    assert {k: r.status for k, r in rows.items()} == {"c1": "linked", "c2": "missing_result", "c3": "linked", "c4": "missing_result", "p": "missing_result", "q": "missing_result", "s": "missing_result", "o": "orphan_result"}
    assert {k: r.level for k, r in rows.items()} == {"c1": 0, "c2": 1, "c3": 2, "c4": None, "p": None, "q": None, "s": None, "o": None}
    assert rows["c1"].message == json.dumps({"arguments": {"a": 1, "b": "x"}, "content": "r é\n", "id": "c1", "name": "f"}, ensure_ascii=False, separators=(",", ":"))


def test_long_chain(spark):
    calls = [(f"c{i}", i, "f", '{"a":1}', f"c{i - 1}" if i else None) for i in range(100)]
    assert {r.id: r.level for r in linked(spark, calls, [])} == {f"c{i}": i for i in range(100)}


def test_arguments(spark):
    texts = ['{"a":1}', '{"a":-1}', '{"a":"x"}', "{}", '{"a":1,"b":"long","z":1,"y":2}', "[1]", "nope", None, '{"a":1.5}']
    rows = {r.at: r.errors for r in linked(spark, [(f"c{i}", i, "f", t, None) for i, t in enumerate(texts)] + [("x", 50, "g", "{}", None)], [])}
    assert [rows[i] for i in range(9)] == [[], ["a: too small"], ["a: not of type integer"], ["a: missing"], ["b: too long", "y: unexpected", "z: unexpected"], ["arguments: not an object"], ["arguments: not an object"], ["arguments: not an object"], ["a: not of type integer"]]
    assert rows[50] == ["unknown function g"]


def test_nested_arguments(spark):
    schema = {
        "required": ["to"],
        "properties": {
            "to": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string", "minLength": 2, "pattern": "^[A-Z]"}, "zip": {"enum": ["1", 2]}}},
            "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "integer", "maximum": 9}},
            "any": {"additionalProperties": True, "properties": {"x": {"const": 1}}},
        },
    }
    cases = [
        ({"to": {"city": "Ulm", "zip": 2}, "tags": [1, 9], "any": {"x": 1, "y": 2}}, []),
        ({"to": {"zip": 3}}, ["to.city: missing", "to.zip: not an allowed value"]),
        ({"to": {"city": "u", "k": 1}, "tags": [1, 10, "x"]}, ["to.city: does not match", "to.city: too short", "to.k: unexpected", "tags: too many items", "tags[]: too large", "tags[]: not of type integer"]),
        ({"to": None, "tags": []}, ["to: not of type object", "tags: too few items"]),
        ({"to": {"city": 5}, "any": {"x": 2}}, ["to.city: not of type string", "any.x: not an allowed value"]),
    ]
    calls = spark.createDataFrame([(f"c{i}", i, "f", json.dumps(a), None) for i, (a, _) in enumerate(cases)], CALLS)
    out = chat.link(calls, spark.createDataFrame([], "id string, at int, content string"), {"f": schema}).collect()
    assert {r.at: sorted(r.errors) for r in out} == {i: sorted(e) for i, (_, e) in enumerate(cases)}


def test_duplicates_and_nulls(spark):
    calls = [("c", 1, "f", '{"a":1}', None), ("c", 1, "f", '{"a":1}', None), ("c", 2, "f", '{"a":2}', None), (None, 3, "f", "{}", None)]
    rows = linked(spark, calls, [("c", 5, "x"), ("c", 5, "x"), ("c", 7, None), (None, 6, "y"), (None, 6, "y")])
    assert [(r.id, r.at, r.status) for r in rows] == [(None, 3, "call_without_id"), *[(None, 6, "result_without_id")] * 2, ("c", 1, "duplicate_call"), ("c", 2, "duplicate_call"), ("c", 5, "duplicate_result"), ("c", 7, "duplicate_result"), ("c", 1, "linked")]
    assert rows[0].message == '{"arguments":{},"content":null,"id":null,"name":"f"}' and rows[1].message == '{"arguments":null,"content":"y","id":null,"name":null}'


def test_turns_give_a_row_each_with_clashing_columns(spark):
    turns = [(1, 0, "system", "be\nkind"), (1, 1, "user", "q"), (1, 2, "assistant", "a" * 100_000), (1, 3, None, None), (2, 0, "assistant", ""), (2, 1, "tool", "é")]
    frame = spark.createDataFrame([(*t, 7, 7) for t in turns], "conv_id long, turn long, role string, text string, id int, at int")
    out = chat.link(*chat.from_turns(frame)[:2], chat.SCHEMAS, chat.from_turns(frame)[2]).collect()
    assert sorted((r.at.conv_id, r.at.turn, r.status) for r in out) == [(1, 0, "context"), (1, 1, "linked"), (1, 3, "context"), (2, 0, "orphan_result"), (2, 1, "context")]
    assert {r.message for r in out if r.status == "context"} == {'{"content":"be\\nkind","role":"system"}', '{"content":null,"role":null}', '{"content":"é","role":"tool"}'}


def test_empty(spark):
    assert linked(spark, [], []) == []


def test_schemas_are_checked_or_refused(spark):
    schema = {"f": {"properties": {"a": {"type": ["string", "null"]}, "n": {"type": "integer"}, 'q"x': {"type": "null"}, "it's": {"type": "string"}}}}
    cases = [
        ('{"a":null}', []), ('{"a":"x"}', []), ('{"a":1}', ["a: not of type string or null"]), ('{"n":1.0}', []), ('{"n":9223372036854775808}', []), ('{"n":1e3}', []), ('{"n":1.5}', ["n: not of type integer"]),
        ('{"n":12345678901234567.5}', ["n: not of type integer"]), ('{"q\\"x":null,"it\'s":"y"}', []), ('{"q\\"x":1}', ['q"x: not of type null']), ('{"a":"x","a":"y"}', ["not an object"]),
    ]
    rows = spark.createDataFrame([(i, "f", a) for i, (a, _) in enumerate(cases)], "i int, name string, arguments string")
    got = rows.select("i", chat.argument_errors(F.col("name"), F.try_parse_json("arguments"), schema).alias("e")).orderBy("i").collect()
    assert [(c[0], r.e if len(c[1]) != 1 or "object" not in c[1][0] else ["not an object"] * bool(r.e)) for c, r in zip(cases, got)] == cases
    for bad in ({"anyOf": []}, {"properties": {"a": {"$ref": "#"}}}, {"items": {"type": "text"}}, {"additionalProperties": {}}, {"properties": {"a'\"": {}}}):
        with pytest.raises(ValueError):
            chat.argument_errors(F.col("name"), F.try_parse_json("arguments"), {"f": bad})
