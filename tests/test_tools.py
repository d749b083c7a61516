from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftwell.operators import tools


def facts(spark):
    lines = spark.createDataFrame([("src/a.c", 1, "int f() {"), ("src/a.c", 2, "  g(); "), ("src/a.c", 3, "}"), ("src/b.c", 1, "")], "file string, ln int, text string")
    functions = spark.createDataFrame([("f", "src/a.c", 1, 3), ("_ZC2E", "src/b.c", 1, 1)], "function_name string, filename string, start_line int, end_line int")
    return tools.Facts(
        spark.createDataFrame([("src/a.c",), ("src/b.c",)], "path string"), lines, functions,
        spark.createDataFrame([("f", "g", "src/a.c", 2), ("f", "g", "src/a.c", 9)], "caller string, callee string, fl string, ln int"),
        spark.createDataFrame([("src/a.c:1", "src/a.c:2", p, e, "call", "src/a.c", e) for p, e in ((1, 1), (1, 2), (2, 2))], "start string, target string, path_no int, event_no int, type string, fl string, ln int"),
    )


def answers(spark, *calls):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "req_id int, tool string, arguments string")
    out = {}
    for r in tools.results(rows, facts(spark)).collect():
        out.setdefault(r.req_id, []).append((json.loads(r.result), r.context))
    return [sorted(out[i], key=str) for i in range(len(calls))]


def test_each_tool(spark):
    f = {"function_name": "f", "filename": "src/a.c", "start_line": 1, "end_line": 3, "function_body": "int f() {\n  g(); \n}"}
    call = lambda tool, **a: (tool, json.dumps(a))
    event = lambda e, code: {"event_no": e, "type": "call", "location": f"src/a.c:{e}", "code": code}
    cases = [
        (call("dump_source_snippet", file_name="x/src/a.c", start_line=2, end_line=9), ["  g(); \n}"]),
        (call("dump_source_snippet", file_name="none.c", start_line=2, end_line=9), ["No such file, please check filename."]),
        (call("dump_source_line", file_name="a.c", line_number="2"), ["g();"]),
        (call("dump_source_line", file_name="none.c", line_number=2), ["No such file, please check filename."]),
        (call("dump_source_line", file_name="b.c", line_number=1), [""]),
        (call("find_current_function", source_location="./a.c:2"), [f]),
        (call("find_current_function", file_name="a.c", line_number=3), [f]),
        (call("find_callee", source_location="src/a.c:2"), [f]),
        (call("find_callee", source_location="a.c:2"), [{"error": "no function at this location"}]),
        (call("find_callers", function_name="g"), [{"location": "src/a.c:2", "code": "g();"}, {"location": "src/a.c:9", "code": "The line number is invalid or out of range for the file."}]),
        (call("find_callers", function_name="nobody"), [[]]),
        (call("find_function_body", function_name="_ZC1E"), [{"function_name": "_ZC2E", "filename": "src/b.c", "start_line": 1, "end_line": 1, "function_body": ""}]),
        (call("find_function_body", function_name=" "), [{"error": "function_name must be a non-empty string"}]),
        (call("get_path_cond_func_", start="src/a.c:1", start_code="f()", target="src/a.c:1", target_code="g()"), [[event(1, "int f() {"), event(2, "g();")], [event(2, "g();")]]),
        (call("get_path_cond_func_", start="src/a.c:1", start_code="f()", target="src/a.c:1", target_code="zzz"), [{"error": "target code was not found near its line"}]),
        (call("set_conclusion", alert_ids=["a"], classification="TP", reason="r", semantic_candidates=[]), [{"received": ["a"]}]),
        (call("set_conclusion", alert_ids=[], classification="TP", reason="r"), [{"error": "alert_ids must be a non-empty string array"}]),
    ]
    got = answers(spark, *(c for c, _ in cases))
    for (c, want), rows in zip(cases, got):
        assert [v for v, _ in rows] == sorted(want, key=str) and {x for _, x in rows} == {"batch"}, c


def test_calls_that_cannot_run(spark):
    cases = [
        (("dump_source_line", "{nope"), "invalid tool arguments: not a JSON object", "parse_arguments"), (("dump_source_line", "[1]"), "invalid tool arguments: not a JSON object", "parse_arguments"),
        (("dump_source_line", ""), "invalid tool arguments: file_name is missing", "parse_arguments"), (("dump_source_line", None), "invalid tool arguments: file_name is missing", "parse_arguments"),
        (("dump_source_line", '{"file_name":"a.c","line_number":null}'), "invalid tool arguments: line_number is missing", "parse_arguments"),
        (("dump_source_line", '{"file_name":"a.c","line_number":[1]}'), "invalid tool arguments: line_number is not of type int", "parse_arguments"),
        (("find_callers", '{"function_name":"g","z":1,"b":2}'), "invalid tool arguments: unexpected b, z", "parse_arguments"), (("nope", "{}"), "unknown tool: nope", "unknown_tool"), ((None, "{}"), "unknown tool: null", "unknown_tool"),
    ]
    assert [r for (r,) in answers(spark, *(c for c, _, _ in cases))] == [({"error": e}, x) for _, e, x in cases]


def test_failures_are_those_of_the_log(spark):
    rows = spark.createDataFrame([(0, "dump_source_line", '{"file_name":"a.c","line_number":77}'), (1, "dump_source_line", '{"file_name":"a.c","line_number":1}'), (2, "x", "{}")], "req_id int, tool string, arguments string")
    assert {(r.req_id, r.failure_kind, r.context) for r in tools.failed(tools.results(rows, facts(spark))).collect()} == {(0, "invalid_line", "batch"), (2, "error_dict", "unknown_tool")}


def test_answers_are_not_shuffled_again(spark):
    """Answers, which may be long, come straight from what found them; lines meet single places once and ranges once; other columns stay."""
    rows = spark.createDataFrame([(0, "dump_source_line", '{"file_name":"a.c","line_number":2}', "p"), (1, "find_callers", '{"function_name":"g"}', "q"), (2, "find_function_body", '{"function_name":"f"}', "r")], "req_id int, tool string, arguments string, origin string")
    out = tools.results(rows, facts(spark))
    assert out.columns == ["req_id", "tool", "arguments", "origin", "context", "result"]
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
    assert sorted((r.req_id, r.tool, r.origin, json.loads(r.arguments)) for r in out.collect()) == [(0, "dump_source_line", "p", {"file_name": "a.c", "line_number": 2}), *[(1, "find_callers", "q", {"function_name": "g"})] * 2, (2, "find_function_body", "r", {"function_name": "f"})]


def test_lines_meet_all_tools_once(spark):
    """Texts of lines are read and sent once for ranges, single lines, anchors and paths; of call sites, only those of names that are asked for."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        read.add(1)
        return value

    lines = spark.createDataFrame([("a.c", n, f"line {n}") for n in range(1, 51)], "file string, ln int, text string").withColumn("text", counted("text"))
    sites = spark.createDataFrame([("f", "g", "a.c", 2), ("f", "g", "a.c", 3), ("f", "h", "a.c", 4)], "caller string, callee string, fl string, ln int")
    functions = spark.createDataFrame([("f", "a.c", 1, 3)], "function_name string, filename string, start_line int, end_line int")
    paths = spark.createDataFrame([("a.c:1", "a.c:2", 1, n, "call", "a.c", n) for n in (1, 2)], "start string, target string, path_no int, event_no int, type string, fl string, ln int")
    given = tools.Facts(spark.createDataFrame([("a.c",)], "path string"), lines, functions, sites, paths)
    calls = [
        ("dump_source_snippet", {"file_name": "a.c", "start_line": 4, "end_line": 5}), ("dump_source_line", {"file_name": "a.c", "line_number": 6}), ("find_callers", {"function_name": "g"}),
        ("find_function_body", {"function_name": "f"}), ("get_path_cond_func_", {"start": "a.c:1", "start_code": "1", "target": "a.c:2", "target_code": "2"}),
    ]
    rows = spark.createDataFrame([(i, t, json.dumps(a)) for i, (t, a) in enumerate(calls)], "req_id int, tool string, arguments string")
    out = tools.results(rows, given)
    got = sorted((r.req_id, r.result) for r in out.collect())
    assert len(got) == 6 and [json.loads(v) for i, v in got if i < 2] == ["line 4\nline 5", "line 6"] and [e["code"] for e in json.loads(got[-1][1])] == ["line 1", "line 2"]
    assert read.value == 50 and "Join LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_and_paths_across_blocks(spark):
    """Ranges and paths within a block, over several and over files, with places that aren't there; ends far beyond the file; paths asked twice and paths of one pair."""
    lines = spark.createDataFrame([(f, n, f" {f} {n} ") for f in ("a.c", "b.c") for n in range(1, 301)], "file string, ln int, text string")
    events = [(1, [("a.c", 3), ("a.c", 1)]), (2, [("a.c", 63), ("a.c", 64)]), (3, [("a.c", 5), ("b.c", 5)]), (4, [("b.c", 200)]), (5, [(None, 5), ("b.c", 5)]), (6, [("b.c", None)]), (7, [("b.c", 300), ("b.c", 301)])]
    paths = [("a.c:1", "b.c:2", p, e, "call", fl, ln) for p, places in events for e, (fl, ln) in enumerate(places)] + [("a.c:9", "a.c:8", 1, 1, "call", "gone.c", 1)]
    given = tools.Facts(
        spark.createDataFrame([("a.c",), ("b.c",)], "path string"), lines, spark.createDataFrame([("long", "b.c", 60, 260)], "function_name string, filename string, start_line int, end_line int"),
        spark.createDataFrame([], "caller string, callee string, fl string, ln int"), spark.createDataFrame(paths, "start string, target string, path_no int, event_no int, type string, fl string, ln int"),
    )
    asked = {"start": "a.c:1", "start_code": "a.c 1", "target": "b.c:2", "target_code": "b.c 2"}
    ranges = [(1, 64), (63, 64), (64, 64), (128, 2**31 - 1), (-(2**31), 2), (300, 400), (301, 2**31 - 1), (9, 3)]
    calls = [("get_path_cond_func_", asked), ("get_path_cond_func_", asked), ("get_path_cond_func_", {"start": "a.c:9", "start_code": "", "target": "a.c:8", "target_code": ""}), ("get_path_cond_func_", {**asked, "target": "b.c:90", "target_code": "b.c 90"}), ("find_function_body", {"function_name": "long"})]
    calls += [("dump_source_snippet", {"file_name": "a.c", "start_line": s, "end_line": e}) for s, e in ranges]
    rows = spark.createDataFrame([(i, t, json.dumps(a)) for i, (t, a) in enumerate(calls)], "req_id int, tool string, arguments string")
    got = {}
    for r in tools.results(rows, given).collect():
        got.setdefault(r.req_id, []).append(r.result)
    none = "The line number is invalid or out of range for the file."

    def event(e, fl, ln):
        place = {} if None in (fl, ln) else {"location": f"{fl}:{ln}"}
        return {"event_no": e, "type": "call", **place, "code": f"{fl} {ln}" if place and fl != "gone.c" and ln <= 300 else none}

    want = sorted(json.dumps([event(e, *p) for e, p in enumerate(places)]) for _, places in events)
    assert sorted(json.dumps(json.loads(r)) for r in got[0]) == want and sorted(got[0]) == sorted(got[1])
    assert [json.loads(r) for r in got[2]] == [[event(1, "gone.c", 1)]] and got[3] == ["[]"]
    text = lambda f, s, e: "\n".join(f" {f} {n} " for n in range(max(s, 1), min(e, 300) + 1))
    assert [json.loads(r)["function_body"] for r in got[4]] == [text("b.c", 60, 260)]
    assert [[json.loads(r) for r in got[5 + i]] for i in range(len(ranges))] == [[text("a.c", s, e)] for s, e in ranges]


def test_arguments_are_typed_for_their_tool_alone(spark):
    """Values are read where the tool has such an argument; a value of another tool's name is an error of its own."""
    text = '{"function_name":"g","file_name":"a.c"}'
    rows = tools.typed(spark.createDataFrame([(0, "find_callers", '{"function_name":"g"}'), (1, "find_callers", text), (2, "find_current_function", '`{"file_name":"a.c","line_number":"2",}`'), (3, "find_callers", '{"function_name":"g","file_name":null}')], "req_id int, tool string, arguments string"))
    got = {r.req_id: (r.error, r.function_name, r.file_name, r.line_number) for r in rows.collect()}
    assert got[0] == (None, "g", None, None) and got[2] == (None, None, "a.c", 2)
    assert {got[i] for i in (1, 3)} == {("invalid tool arguments: unexpected file_name", "g", None, None)}
