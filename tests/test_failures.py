from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftwell.operators import failures
from siftwell.sources import sinks

NO_FILE = "No such file, please check filename."


def kinds(spark, *responses):
    frame = spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in enumerate(responses)], "i int, response string")
    return [(r.f.kind, r.f.detail) if r.f else None for r in frame.select("i", failures.classify(F.col("response")).alias("f")).orderBy("i").collect()]


def test_kinds(spark):
    got = kinds(spark, None, f" {NO_FILE}\n", {"error": "out of memory", "n": 1}, {"function_body": NO_FILE, "error": None, "start_line": 4}, {"callers": [], "function_body": "static void g(void) {}"}, "return total;")
    assert [g and g[0] for g in got] == ["null_response", "no_such_file", "error_dict", "degraded_no_such_file", None, None]


def test_text_that_is_not_json_is_a_string(spark):
    frame = spark.createDataFrame([("ERROR: gone",), ("plain words",), ("null",), ("",)], "response string")
    assert [r.f and (r.f.kind, r.f.detail) for r in frame.select(failures.classify(F.col("response")).alias("f")).collect()] == [("error_string", "ERROR: gone"), None, ("null_response", "tool returned None"), None]


def test_a_response_is_parsed_once(spark):
    plan = failures.failures(spark.createDataFrame([("t", "{}")], "tool string, response string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 2


def test_quirks(spark):
    got = kinds(spark, [{"error": "x"}], {"error": True}, {"error": 0, "function_body": "Error: y"}, {"error": {"a": 1}}, {"error": ""}, " \t", "x " + NO_FILE, "File not found: q", "The line number is invalid or out of range for the file.", {"error": "e" * 600}, 5)
    assert got[0] is None and got[1] == ("error_dict", "True") and got[2][0] == "degraded_error_string" and got[3][0] == "error_dict"
    assert got[4] is None and got[5] is None and got[6][0] == "no_such_file" and got[7][0] == "file_not_found" and got[8][0] == "invalid_line"
    assert len(got[9][1]) == 500 and got[10] is None


def test_compact(spark):
    frame = spark.createDataFrame([(json.dumps("x" * 501),), (json.dumps({"function_body": "y" * 301, "n": 1}),), (json.dumps([1]),)], "response string")
    got = [json.loads(r[0]) for r in frame.select(failures.compact(F.col("response"))).collect()]
    assert got == ["x" * 500 + "...", {"function_body": "y" * 300 + "...", "n": 1}, [1]]


def test_record_and_summary(spark, tmp_path):
    events = spark.createDataFrame([("B7", 1, "read_lines", json.dumps(NO_FILE)), ("B9", 2, "list_calls", '{"calls":[]}')], "batch_id string, turn int, tool string, response string")
    found = failures.failures(events)
    sinks.append_failures(found, str(tmp_path / "log"))
    sinks.append_failures(found, str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log"))
    assert back.count() == 2 and {r.failure_kind for r in back.collect()} == {"no_such_file"}
    assert {(r.by, r.name, r.n) for r in failures.summary(back).collect()} == {("total", None, 2), ("tool", "read_lines", 2), ("kind", "no_such_file", 2)}
    sinks.write_summary(failures.summary(back), str(tmp_path / "summary"))
    assert sinks.read_version(spark, str(tmp_path / "summary")).count() == 3
