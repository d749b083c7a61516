"""Tool calls from their text to their results and logged failures, for whole tables of calls at once.

Arguments are read tolerantly, checked against the tool's own fields and typed, once for all calls.
Then each kind of lookup runs once for all tools that need it: names of files are resolved together,
places find their functions together, and all lines meet the same blocks of their files. A call that can't run
gives an error of its own instead of ending the job. Callers and paths give a row each, since there
is no bound on how many a name has; every other call gives one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_edit import json_string
from ..functions.text import SOURCE_LOCATION, parse_location, tolerant_json
from ..work import saved
from . import failures, ledger, lookups


@dataclass(frozen=True)
class Tool:
    """Arguments by name and type."""

    required: dict[str, str] = field(default_factory=dict)
    optional: dict[str, str] = field(default_factory=dict)


#: The tools and their arguments.
TOOLS = {
    "set_conclusion": Tool({"alert_ids": "array<string>", "classification": "string", "reason": "string"}, {"semantic_candidates": "variant"}),
    "dump_source_snippet": Tool({"file_name": "string", "start_line": "int", "end_line": "int"}),
    "dump_source_line": Tool({"file_name": "string", "line_number": "int"}),
    "find_callee": Tool({"source_location": "string"}),
    "find_current_function": Tool({}, {"source_location": "string", "file_name": "string", "line_number": "int"}),
    "find_callers": Tool({"function_name": "string"}),
    "find_function_body": Tool({"function_name": "string"}),
    "get_path_cond_func_": Tool({"start": "string", "start_code": "string", "target": "string", "target_code": "string"}),
}
ARGUMENTS = {name: kind for tool in TOOLS.values() for name, kind in (tool.required | tool.optional).items()}


@dataclass(frozen=True)
class Facts:
    """What the tools look up: files (path), lines (file, ln, text), functions, call sites (callee, fl, ln), paths (start, target, path_no, event_no, type, fl, ln)."""

    files: DataFrame
    lines: DataFrame
    functions: DataFrame
    call_sites: DataFrame
    paths: DataFrame


def _error(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("error")))


def argument_error(tool: Tool, value: Column) -> Column:
    """The first thing wrong with a call's arguments, or null."""
    checks = []
    for name, kind in (tool.required | tool.optional).items():
        part = F.try_variant_get(value, f"$.{name}", "variant")
        there = part.isNotNull() & ~F.coalesce(F.is_variant_null(part), F.lit(True))
        if name in tool.required:
            checks.append(F.when(~there, f"{name} is missing"))
        checks.append(F.when(there & F.try_variant_get(value, f"$.{name}", kind).isNull(), f"{name} is not of type {kind}"))
    known = F.array(*map(F.lit, tool.required | tool.optional))
    more = F.array_except(F.map_keys(F.try_variant_get(value, "$", "map<string, variant>")), known)
    return F.coalesce(*checks, F.when(F.size(more) > 0, F.concat(F.lit("unexpected "), F.array_join(F.array_sort(more), ", "))))


def typed(calls: DataFrame) -> DataFrame:
    """calls (req_id, tool, arguments: text) with the typed arguments of their tool, `error`, and `context`: where the error arose."""
    value, is_object, wrong = map(F.col, ("_value", "_object", "_wrong"))
    problem = F.lit(None).cast("string")
    for name, tool in TOOLS.items():
        problem = F.when(F.col("tool") == name, argument_error(tool, value)).otherwise(problem)
    # columns of their own, so that each is worked out once
    rows = calls.withColumn("_value", tolerant_json(F.col("arguments"))).withColumn("_object", F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)))
    rows = rows.withColumn("_wrong", F.when(is_object, problem))
    unknown = ~F.coalesce(F.col("tool").isin(list(TOOLS)), F.lit(False))
    error = (
        F.when(~is_object, "invalid tool arguments: not a JSON object")
        .when(unknown, F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit("null"))))
        .when(wrong.isNotNull(), F.concat(F.lit("invalid tool arguments: "), wrong))
    )
    context = F.when(~is_object | (~unknown & wrong.isNotNull()), "parse_arguments").when(unknown, "unknown_tool").otherwise("batch")
    owners = {name: [t for t, tool in TOOLS.items() if name in tool.required | tool.optional] for name in ARGUMENTS}
    values = [F.when(F.col("tool").isin(owners[name]), F.try_variant_get(value, f"$.{name}", kind)).alias(name) for name, kind in ARGUMENTS.items()]
    return rows.select(*calls.columns, error.alias("error"), context.alias("context"), *values)


def _results(rows: DataFrame, result: Column) -> DataFrame:
    return rows.select("req_id", "call", result.alias("result"))


def _body(snippet: Column, missing: Column) -> Column:
    """The JSON of a function with its text, or the error."""
    found = F.to_json(F.struct("function_name", F.col("file").alias("filename"), "start_line", "end_line", snippet.alias("function_body")))
    return F.when(F.col("function_name").isNull(), _error(missing)).otherwise(found)


def _event(event_no: Column, kind: Column, fl: Column, ln: Column, text: Column) -> Column:
    return F.struct(event_no.alias("event_no"), kind.alias("type"), F.concat(fl, F.lit(":"), ln).alias("location"), lookups.line_shown(text).alias("code"))


def _between(calls: DataFrame, facts: Facts) -> tuple[DataFrame, DataFrame]:
    """Paths between two places, each of which moves to the line that holds its code: calls with a path within one block of lines, or with none or an error; and with the answer of longer paths.

    Events are gathered without their texts. Those of one block find them where a call's lines do; only the texts of longer paths are sent on to meet.
    """
    ends = F.explode(F.array(*(F.struct(F.lit(end).alias("end"), F.col(end).alias("text"), F.col(f"{end}_code").alias("code")) for end in ("start", "target"))))
    rows = calls.select("req_id", ends.alias("e")).select(F.struct("req_id", "e.end").alias("req_id"), "e.text", "e.code", parse_location(F.col("e.text")).alias("at"))
    wanted = rows.where(F.col("text").rlike(SOURCE_LOCATION)).select("req_id", "at.fl", "at.ln", "code")
    moved = lookups.reanchored(wanted, facts.lines).where("anchor is not null").select("req_id.req_id", "req_id.end", F.concat("fl", F.lit(":"), "anchor").alias("place"))
    both = moved.groupBy("req_id").agg(*(F.max(F.when(F.col("end") == end, F.col("place"))).alias(end) for end in ("start", "target")))
    known = calls.select("req_id", "call").join(both, "req_id", "left")
    paths = lookups.path_extents(facts.paths)
    error = F.when(F.col("start").isNull(), "start code was not found near its line").when(F.col("target").isNull(), "target code was not found near its line")
    near = known.join(paths, ["start", "target"], "left").where("far is null or not far").select("req_id", "call", "file", "start_line", "end_line", "events", error.alias("error"))
    events = paths.where("far").select("start", "target", "path_no", F.explode("events").alias("e")).select("start", "target", "path_no", "e.*", F.col("e.fl").alias("file"), F.col("e.ln").alias("start_line"), F.col("e.ln").alias("end_line"))
    event = _event(*map(F.col, ("event_no", "type", "fl", "ln")), F.get("found", F.lit(0))["text"])
    coded = lookups.lines_in_block(events, facts.lines).select("start", "target", "path_no", event.alias("event")).repartition("start", "target")
    coded = coded.groupBy("start", "target", "path_no").agg(F.to_json(F.array_sort(F.collect_list("event"))).alias("events"))
    return near, _results(known.join(coded, ["start", "target"]), F.col("events"))


def results(calls: DataFrame, facts: Facts) -> DataFrame:
    """(req_id, tool, context, arguments, result: JSON text) of calls (req_id, tool, arguments), with their other columns.

    What a call came with goes along as `call`, so that answers, which may be long, need no join with their calls.
    """
    others = [c for c in calls.columns if c != "req_id"]
    rows = saved(typed(calls)).withColumn("call", F.struct(*others, "context"))
    good = rows.where("error is null")

    def of(*names: str) -> DataFrame:
        return good.where(F.col("tool").isin(*names))

    # every place that is named by a file: one resolution for the three tools that resolve
    place, null = parse_location(F.col("source_location")), F.lit(None).cast("string")
    named = of("dump_source_snippet", "dump_source_line", "find_current_function").select("req_id", "call", "tool", "start_line", "end_line", F.coalesce(place["fl"], "file_name").alias("name"), F.coalesce(place["ln"], "line_number").alias("ln"))
    resolved = saved(lookups.resolve_paths(named, facts.files))
    # functions around places
    direct = of("find_callee").select("req_id", "call", place["fl"].alias("file"), place["ln"].alias("ln"))
    around = resolved.where("tool = 'find_current_function'").select("req_id", "call", "file", "ln").unionByName(direct)
    # ranges of lines: those asked for, of functions around places, and of functions by name
    columns = ("req_id", "call", "file", "start_line", "end_line", "function_name", "error")
    ranges = resolved.where("tool = 'dump_source_snippet'").withColumns({"function_name": null, "error": null}).select(*columns)
    functions = lookups.current_function(around, facts.functions).withColumn("error", F.lit("no function at this location")).select(*columns)
    bodies = lookups.found_functions(of("find_function_body").select("req_id", "call", F.col("function_name").alias("name")), facts.functions)
    bodies = bodies.withColumn("function_name", F.when(F.col("error").isNull(), F.col("resolved_name"))).select(*columns)
    texts = saved(ranges.unionByName(functions).unionByName(bodies))
    # single lines: those asked for, and of call sites; only sites of names that are asked for are sent on
    single = resolved.where("tool = 'dump_source_line'").select("req_id", "call", "file", F.col("ln").alias("start_line"), F.col("ln").alias("end_line"))
    asked = of("find_callers").select("req_id", "call", F.col("function_name").alias("callee"))
    called = facts.call_sites.join(saved(asked.select("callee").distinct()), "callee", "left_semi")
    sites = asked.join(called.select("callee", F.col("fl").alias("file"), F.col("ln").alias("start_line"), F.col("ln").alias("end_line"), F.lit(True).alias("site")), "callee", "left").drop("callee")
    near, far = _between(of("get_path_cond_func_"), facts)
    # all that lies in one block of lines meets it at once, and is answered there
    short = texts.where(~lookups.crosses_blocks())
    for more in (single, sites, near):
        short = short.unionByName(more, allowMissingColumns=True)
    tool, file, found = F.col("call.tool"), F.col("file"), F.col("found")
    text = F.get(found, F.lit(0))["text"]
    snippet = lookups.snippet_of(file, found)
    line = json_string(F.when(file.isNull(), failures.NO_FILE).otherwise(lookups.line_shown(text)))
    site = F.to_json(F.struct(F.concat("file", F.lit(":"), "start_line").alias("location"), lookups.line_shown(text).alias("code")))
    events = F.array_sort(F.transform("events", lambda e: _event(e["event_no"], e["type"], e["fl"], e["ln"], F.get(F.filter(found, lambda x: x["ln"] == e["ln"]), F.lit(0))["text"])))
    ranged = F.when(tool == "dump_source_snippet", json_string(snippet)).otherwise(_body(snippet, F.col("error")))
    answer = (
        F.when(tool == "dump_source_line", line)
        .when(tool == "find_callers", F.when(F.col("site"), site).otherwise("[]"))
        .when(tool == "get_path_cond_func_", F.when(F.col("error").isNotNull(), _error(F.col("error"))).otherwise(F.coalesce(F.to_json(events), F.lit("[]"))))
        .otherwise(ranged)
    )
    shape = ledger.conclusion_error(F.col("alert_ids"), F.col("classification"), F.col("reason"))
    parts = [
        _results(lookups.lines_in_block(short, facts.lines), answer),
        _results(lookups.lines_across_blocks(texts.where(lookups.crosses_blocks()), facts.lines), ranged),
        far,
        _results(of("set_conclusion"), F.when(shape.isNotNull(), _error(shape)).otherwise(F.to_json(F.struct(F.col("alert_ids").alias("received"))))),
        _results(rows.where("error is not null"), _error(F.col("error"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*(F.col("req_id" if c == "req_id" else f"call.{c}") for c in calls.columns), "call.context", "result")


def failed(answered: DataFrame) -> DataFrame:
    """The answers that failed, with failure_kind and detail: what the failure log gets."""
    return failures.failures(answered.withColumnRenamed("result", "response"))
