from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import lookups
from siftwell.sources import documents


def test_path_resolution(spark):
    files = ["a.c", "src/a.c", "src/deep/util.c", "lib/util.c", "x/y/only.c", "p/q/r.c", "z/q/r.c"]
    wanted = {
        "lib/a.c": "a.c", "a.c": "a.c", "/project/src/a.c": "src/a.c", "../../src/a.c": "a.c", "util.c": "lib/util.c", "build/deep/util.c": "src/deep/util.c",
        "k/only.c": "x/y/only.c", "k/r.c": None, "./src//deep/../a.c": "a.c", "none.c": None, " ": None, "h/q/r.c": "p/q/r.c",
    }
    frame = spark.createDataFrame([(n,) for n in wanted] + [("a.c",)], "name string")
    got = lookups.resolve_paths(frame, spark.createDataFrame([(f,) for f in files], "path string")).collect()
    assert len(got) == len(wanted) + 1
    assert {r.name: r.file for r in got} == wanted


def test_one_base_name_for_all_files(spark):
    files = spark.range(3000).select(F.concat(F.lit("m/"), F.col("id") % 7, F.lit("/k"), "id", F.lit("/main.c")).alias("path"))
    names = spark.createDataFrame([("x/3/k10/main.c",), ("main.c",), ("k11/main.c",), ("m/4/k11/main.c",), ("other/main.c",)], "name string")
    got = {r.name: r.file for r in lookups.resolve_paths(names, files).collect()}
    assert got == {"x/3/k10/main.c": "m/3/k10/main.c", "main.c": "m/0/k0/main.c", "k11/main.c": "m/4/k11/main.c", "m/4/k11/main.c": "m/4/k11/main.c", "other/main.c": None}


def test_locations_and_errors(spark):
    rows = [("a.c", 3, 4, None), (None, None, None, "b.c:9"), ("a.c", None, None, "c.c:1"), (None, None, None, "b.c:99999999999"), ("a.c", 1 << 40, None, None), (None, None, None, None)]
    got = lookups.located(spark.createDataFrame(rows, "fl string, ln long, cl long, text string")).collect()
    assert [r["at"] and tuple(r["at"]) for r in got] == [("a.c", 3, 4), ("b.c", 9, None), ("c.c", 1, None), None, ("a.c", None, None), None]
    nodes = [("x:1", "a", None, 2, None), ("", "a", None, 2, 3), (None, "", "f.c", None, 5), (None, None, None, 1, None)]
    frame = spark.createDataFrame(nodes, "location string, fl string, filename string, ln int, line int")
    assert [r.location for r in lookups.with_locations(frame).collect()] == ["x:1", "a:2", "f.c:5", None]
    errors = spark.createDataFrame([(e,) for e in ("false", '""', "null", "0", None, '"bad"', "true", '{"a":1}')], "error string")
    assert [r.error for r in lookups.without_false_errors(errors).collect()] == [None] * 5 + ['"bad"', "true", '{"a":1}']


def test_project_files_and_source_lines(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a b.c").write_text("one\n\ntwo\n")
    (tmp_path / "c.h").write_text("")
    assert sorted(r.path for r in documents.project_files(spark, str(tmp_path)).collect()) == ["c.h", "src/a b.c"]
    assert [(r.file, r.ln, r.text) for r in documents.source_lines(spark, str(tmp_path)).orderBy("ln").collect()] == [("src/a b.c", 1, "one"), ("src/a b.c", 2, ""), ("src/a b.c", 3, "two")]


def lines(spark):
    return documents.lines_of(spark.createDataFrame([("a.c", "one\n\n  two(x)  \nthree\n"), ("b.c", ""), ("c.c", None)], "file string, text string"))


def test_lines(spark):
    assert [(r.file, r.ln, r.text) for r in lines(spark).orderBy("file", "ln").collect()] == [("a.c", 1, "one"), ("a.c", 2, ""), ("a.c", 3, "  two(x)  "), ("a.c", 4, "three")]


def test_snippets_and_lines(spark):
    wanted = spark.createDataFrame([(1, "a.c", 2, 9), (2, "a.c", 8, 9), (3, None, 1, 2), (4, "a.c", 1, 1)], "req_id int, file string, start_line int, end_line int")
    got = {r.req_id: r.snippet for r in lookups.snippets(wanted, lines(spark)).collect()}
    assert got == {1: "\n  two(x)  \nthree", 2: "", 3: "No such file, please check filename.", 4: "one"}
    one = spark.createDataFrame([("a.c", 2), ("a.c", 3), ("a.c", 7)], "fl string, ln int")
    assert {r.ln: r.line_text for r in lookups.source_lines_of(one, lines(spark)).collect()} == {2: "", 3: "two(x)", 7: "The line number is invalid or out of range for the file."}


def test_functions(spark):
    f = spark.createDataFrame([("outer", "a.c", 1, 3000), ("inner", "a.c", 1500, 1510), ("fC2Ev", "a.c", 1, 3)], "function_name string, filename string, start_line int, end_line int")
    at = spark.createDataFrame([(1, "a.c", 1505), (2, "a.c", 2500), (3, "b.c", 1), (4, None, 1)], "req_id int, file string, ln int")
    assert {r.req_id: r.function_name for r in lookups.current_function(at, f).collect()} == {1: "inner", 2: "outer", 3: None, 4: None}
    names = spark.createDataFrame([(1, "fC1Ev"), (2, "gone"), (3, " "), (4, None), (5, "qC1EC3E")], "req_id int, name string")
    f = f.withColumn("error", F.lit(None).cast("string")).union(spark.createDataFrame([("qC1EC3E", None, None, None, "no body"), ("qC1EC2E", None, None, None, "later")], "a string, b string, c int, d int, e string"))
    got = {r.req_id: (r.resolved_name, r.alias, r.snippet, r.error) for r in lookups.function_bodies(names, f, lines(spark)).collect()}
    assert got == {
        1: ("fC2Ev", "fC2Ev", "one\n\n  two(x)  ", None),
        2: (None, None, None, "Function body unavailable for 'gone'. unknown function"),
        3: (None, None, None, "function_name must be a non-empty string"),
        4: (None, None, None, "function_name must be a non-empty string"),
        5: (None, None, None, "Function body unavailable for 'qC1EC3E'. later"),
    }


def test_reanchor(spark):
    wanted = spark.createDataFrame([(1, "a.c", 3, "two"), (2, "a.c", 4, " one "), (3, "a.c", 1, "nope"), (4, "a.c", 40, "one")], "req_id int, fl string, ln int, code string")
    assert {r.req_id: r.anchor for r in lookups.reanchored(wanted, lines(spark)).collect()} == {1: 3, 2: 1, 3: None, 4: None}


def test_reanchor_at_the_edges_and_without_a_broadcast(spark):
    """Blocks meet at every 32nd line; numbers that are far off give none; rows made by explode() are never sent to the driver."""
    text = documents.lines_of(spark.createDataFrame([("a.c", "\n".join("x" if n % 9 else "hit" for n in range(1, 101)))], "file string, text string"))
    asked = spark.range(-10, 120).withColumnRenamed("id", "req_id").select("req_id", F.lit("a.c").alias("fl"), F.col("req_id").cast("int").alias("ln"), F.lit("hit").alias("code"))
    asked = asked.union(spark.createDataFrame([(1000, "a.c", 2**31 - 1, "x"), (1001, "a.c", None, "x"), (1002, "a.c", 3, None), (1003, None, 3, "x")], "req_id long, fl string, ln int, code string"))
    found = lookups.reanchored(asked, text)
    hits = range(9, 101, 9)
    want = {n: n if n in hits else next((h for h in hits if n - 5 <= h <= n + 4), None) for n in range(-10, 120)} | dict.fromkeys(range(1000, 1004))
    assert {r.req_id: r.anchor for r in found.collect()} == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_return_fallback_and_ties(spark):
    facts = spark.createDataFrame([(1, "x", "x"), (1, "y", "x"), (2, "y", "q"), (2, "z", "q"), (3, "y", None)], "req_id int, location string, wanted string")
    assert sorted((r.req_id, r.location) for r in lookups.return_locations(facts).collect()) == [(1, "x"), (2, "y"), (2, "z"), (3, "y")]
    events = spark.createDataFrame([(1, 2, 1), (1, 1, 1), (1, 0, 1), (1, 0, 2)], "req_id int, path_no int, event_no int")
    assert [(r.path_no, r.event_no) for r in lookups.shortest_path(events).collect()] == [(1, 1)]


def test_tags_and_marker(spark):
    tags = spark.createDataFrame([("!_TAG\tx\ty",), ("f\ta.c\t12;\"\tf\tline:30",), ("g\tb.c\t12;\"\tf\tline:x",), ("h\tc.c",), ("k\td.c\t/^x$/",)], "value string")
    assert sorted(tuple(r) for r in documents.tags_of(tags).collect()) == [("f", "a.c:30"), ("g", "b.c:12")]
    text = spark.createDataFrame([("a", "x\n##### 1\ny\n#####\nz"), ("b", "q")], "file string, text string")
    assert sorted((r.file, r.text) for r in documents.after_marker(documents.lines_of(text)).collect()) == [("a", "z"), ("b", "q")]


def test_texts(spark):
    def one(column, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]

    assert one(T.body_aliases, "_ZN1AC1Ev", "plain", "xD0EvC3E") == [["_ZN1AC1Ev", "_ZN1AC2Ev"], ["plain"], ["xD0EvC3E", "xD0EvC2E", "xD2EvC3E"]]
    assert one(T.described_location, 'dbg { "ln": 790, "cl": 7, "fl": "t.c" }', 'q { "ln": 5, "fl": "u.c" }', "none") == ["t.c:790", "u.c:5", None]
    assert one(lambda c: F.to_json(T.tolerant_json(c)), "", "`{'a': 1}`", '{"a": [1,],}', 'say {"a": 2} ok', "{bad") == ["{}", '{"a":1}', '{"a":[1]}', '{"a":2}', None]
    assert [r and (r.fl, r.ln) for r in one(T.parse_location, "a:b.c:7", ":7", "a.c:", "a.c:7x", "a.c:99999999999")] == [("a:b.c", 7), None, None, None, None]
    assert one(T.stripped, "\x1c\u2003 x y\x85\xa0\t", "", "\x1f") == ["x y", "", ""] and one(lambda c: F.to_json(T.tolerant_json(c)), None) == ["{}"]
    assert one(T.call_names, "if (f(x) && g (y)) f(z)") == [["f", "g"]]


def test_dispatch(spark):
    calls = spark.createDataFrame([(1, "up", "a"), (2, "what", "b"), (3, None, "c")], "req_id int, tool string, arg string")
    got = {r.req_id: (r.result, r.error) for r in lookups.dispatched(calls, {"up": lambda c: c.select("req_id", F.upper("arg").alias("result"))}).collect()}
    assert got == {1: ("A", None), 2: (None, "unknown tool: what"), 3: (None, "unknown tool: null")}


def test_innermost_functions_by_a_sweep(spark):
    """Nested, equal and crossing functions, against all enclosing ones; ten thousand nested ones are swept once."""
    import random
    import time

    rng = random.Random(6)
    functions = [(rng.choice("abcd"), rng.choice(["x.c", "y.c"]), s, s + rng.randrange(0, 300)) for s in (rng.randrange(1, 400) for _ in range(60))] + [("z", None, 1, 5), ("w", "x.c", 9, 3)]
    requests = [(f"{f}{n}", f, n) for f in ("x.c", "y.c", "gone", None) for n in range(-1, 720)]
    got = lookups.current_function(spark.createDataFrame(requests, "req_id string, file string, ln int").repartition(3), spark.createDataFrame(functions, "function_name string, filename string, start_line int, end_line int").repartition(3)).collect()
    want = {}
    for r, f, n in requests:
        inside = [(e - s, name, s, e) for name, file, s, e in functions if file and file == f and s <= n <= e]
        want[r] = min(inside)[1:] if inside else (None, None, None)
    assert len(got) == len(requests)
    for r in got:
        assert (r.function_name is None) == (want[r.req_id][0] is None)
        if r.function_name:
            assert (r.end_line - r.start_line, r.function_name) == (want[r.req_id][2] - want[r.req_id][1], want[r.req_id][0]) and r.start_line <= r.ln <= r.end_line
    nested = [(f"f{i}", i, 40_000 - i) for i in range(10_000)]
    start = time.perf_counter()
    assert list(lookups.innermost(nested))[9_999] == (9_999, 30_001, "f9999", 9_999, 30_001) and time.perf_counter() - start < 2


def test_paths_of_one_event_stay_with_their_line(spark):
    """Lines of one-event paths aren't gathered; sizes counted here or given make no difference, unknown files neither."""
    rows = [(1, "a", 1, "call", "a.c", 4), (1, "b", 2, "call", "a.c", 1), (1, "b", 1, "condition", None, 3), (2, "a", 1, "call", "a.c", 9), (2, "b", 3, "call", "a.c", 3), (2, "b", 1, "call", "a.c", 3)]
    events = spark.createDataFrame(rows, "req_id int, path_no string, event_no int, type string, fl string, ln int")
    none = "The line number is invalid or out of range for the file."
    want = {(1, "a"): [(1, "call", "a.c:4", "three")], (1, "b"): [(1, "condition", None, none), (2, "call", "a.c:1", "one")], (2, "a"): [(1, "call", "a.c:9", none)], (2, "b"): [(1, "call", "a.c:3", "two(x)"), (3, "call", "a.c:3", "two(x)")]}
    for given in (events, events.withColumn("n_events", F.when(F.col("path_no") == "a", 1).otherwise(2))):
        found = lookups.path_code(given, lines(spark))
        assert found.columns == ["req_id", "path_no", "events"] and {(r.req_id, r.path_no): [tuple(e) for e in r.events] for r in found.collect()} == want
        assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_return_locations_in_one_pass(spark):
    """The facts are read, shuffled and sorted once; equal rows and requests without a wanted place stay."""
    facts = spark.createDataFrame([(1, "x", "x"), (1, "x", "x"), (1, None, "x"), (2, None, None), (None, "y", "z")], "req_id int, location string, wanted string")
    found = lookups.return_locations(facts)
    assert sorted(((r.req_id, r.location) for r in found.collect()), key=str) == [(1, "x"), (1, "x"), (2, None), (None, "y")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_snippets_within_and_across_blocks(spark):
    """Ranges of every length at the edges of blocks and buckets; short ones are cut out where they meet their block."""
    many = documents.lines_of(spark.createDataFrame([("a.c", "\n".join(map(str, range(1, 2101))))], "file string, text string"))
    ranges = [(s, e) for s in (-3, 0, 1, 60, 63, 64, 65, 999, 1000, 2090) for e in (-1, 0, 5, 63, 64, 127, 128, 999, 1000, 2099, 2100, 2200)] + [(None, 5), (5, None)]
    wanted = spark.createDataFrame([(i, "a.c", s, e) for i, (s, e) in enumerate(ranges)] + [(900, None, 1, 2), (901, None, 1, 200), (902, "gone.c", 1, 200)], "req_id int, file string, start_line int, end_line int")
    found = lookups.snippets(wanted, many)
    text = {i: "\n".join(str(n) for n in range(max(s, 1), min(e, 2100) + 1)) if None not in (s, e) else "" for i, (s, e) in enumerate(ranges)}
    missing = "No such file, please check filename."
    assert {r.req_id: r.snippet for r in found.collect()} == text | {900: missing, 901: missing, 902: ""}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "SortMergeJoin" in plan
