"""Chat formatting: links tool calls with their results.

Calls and results meet by a hash join on the identifier. A call may name another that must come
first; its level is its distance from a call without one, found by pointer doubling, so calls
ordered by level are in topological order. Arguments are checked against the schema of the
called function, and each call with its result becomes one line of canonical JSON: keys in code
point order, no blanks.

Every call, result and other message gives a row. Of several calls with one id the earliest counts,
the others are `duplicate_call`; of several results the earliest is taken, the others are
`duplicate_result`. A call without a result is `missing_result`, a result without a call
`orphan_result`. Null ids never link: such calls are `call_without_id`, such results
`result_without_id`. Other messages are `context`. Only linked, missing and orphan rows have levels
and errors; all but duplicates have a message. Calls on a cycle, or that wait for one that doesn't
exist, have no level. Arguments that aren't an object, or repeat a key, are invalid; whole numbers are
integers however they are spelled; a schema with keywords that aren't checked is refused. Numbers are
spelled as the variant type spells them. Repeated rows are duplicates of
each other. Texts of any length are kept whole; null and empty ones are null and empty in the
message. Other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: Variant types that pass for a schema's type.
TYPES = {"null": ("VOID",), "string": ("STRING",), "integer": ("BIGINT", "DECIMAL", "DOUBLE"), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
#: Keywords of a schema that are checked, and those that say nothing about a value.
CHECKED = ("type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems", "items", "required", "properties", "additionalProperties")
SILENT = ("title", "description", "default", "examples", "deprecated", "$schema", "$id", "$comment")
#: The one function that the query's calls go to.
SCHEMAS = {"reply": {"required": ["text", "turn"], "properties": {"text": {"type": "string", "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}}}


def errors_of(value: Column, rule: dict, at: str = "") -> Column:
    """Array of texts: what a variant that is there has against a JSON schema.

    type, enum, const, pattern, minLength, maxLength, minimum, maximum, minItems, maxItems, items,
    required, properties; objects with properties take no others unless additionalProperties is true.
    """
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    name = at or "arguments"
    checks: list[Column] = []

    def bad(condition: Column, what: str) -> None:
        checks.append(F.when(F.coalesce(condition, F.lit(False)), f"{name}: {what}"))

    is_text, is_list, is_number = kind.startswith("STRING"), kind.startswith("ARRAY"), F.lit(False)
    for t in TYPES["number"]:
        is_number = is_number | kind.startswith(t)
    if "type" in rule:
        exact = F.try_variant_get(value, "$", "decimal(38,18)")
        whole = F.coalesce(exact % 1 == 0, number == F.floor(number), F.lit(False))
        right, types = F.lit(False), [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        for t in types:
            fits = F.lit(False)
            for k in TYPES[t]:
                fits = fits | kind.startswith(k)
            right = right | ((fits & whole) if t == "integer" else fits)
        bad(~right, f"not of type {' or '.join(types)}" if at else f"not an {' or '.join(types)}")
    for allowed in ([rule["const"]],) if "const" in rule else (rule["enum"],) if "enum" in rule else ():
        bad(~F.to_json(value).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in allowed]), "not an allowed value")
    if "pattern" in rule:
        bad(is_text & ~text.rlike(rule["pattern"]), "does not match")
    for key, wrong, what in (("minLength", F.char_length(text).__lt__, "too short"), ("maxLength", F.char_length(text).__gt__, "too long")):
        if key in rule:
            bad(is_text & wrong(rule[key]), what)
    for key, wrong, what in (("minimum", number.__lt__, "too small"), ("maximum", number.__gt__, "too large")):
        if key in rule:
            bad(is_number & wrong(rule[key]), what)
    items = F.try_variant_get(value, "$", "array<variant>")
    for key, wrong, what in (("minItems", F.size(items).__lt__, "too few items"), ("maxItems", F.size(items).__gt__, "too many items")):
        if key in rule:
            bad(is_list & wrong(rule[key]), what)
    out = [F.array_compact(F.array(*checks)).cast("array<string>")]
    none = F.array().cast("array<string>")
    if "items" in rule:
        out.append(F.when(is_list, F.array_distinct(F.flatten(F.transform(items, lambda x: errors_of(x, rule["items"], f"{name}[]"))))))
    fields = rule.get("properties", {})
    inner = []
    for field in {**fields, **dict.fromkeys(rule.get("required", ()), {})}:
        path = f"{at}.{field}" if at else field
        quote = "'" if '"' in field else '"'
        part = F.try_variant_get(value, f"$[{quote}{field}{quote}]", "variant")
        missing = F.array(F.lit(f"{path}: missing")) if field in rule.get("required", ()) else none
        inner.append(F.when(part.isNull(), missing).otherwise(errors_of(part, fields.get(field, {}), path)))
    if fields and not rule.get("additionalProperties"):
        keys = F.array_sort(F.array_except(F.map_keys(F.from_json(F.to_json(value), "map<string, variant>")), F.array(*map(F.lit, fields))))
        inner.append(F.transform(keys, lambda k: F.concat(F.lit(f"{at}." if at else ""), k, F.lit(": unexpected"))))
    if inner:
        out.append(F.when(kind.startswith("OBJECT"), F.flatten(F.array(*(F.coalesce(x, none) for x in inner)))))
    return F.flatten(F.array(*(F.coalesce(x, none) for x in out)))


def check_schema(rule: dict, at: str = "schema") -> None:
    """Raise ValueError where a schema asks for what errors_of doesn't check, instead of taking wrong arguments for valid."""
    if not isinstance(rule, dict) or (unknown := [k for k in rule if k not in CHECKED + SILENT]):
        raise ValueError(f"{at}: {'not an object' if not isinstance(rule, dict) else 'keywords not supported: ' + ', '.join(unknown)}")
    types = rule.get("type", [])
    if unknown := [t for t in ([types] if isinstance(types, str) else types) if t not in TYPES]:
        raise ValueError(f"{at}: unknown types: {', '.join(map(str, unknown))}")
    if not isinstance(rule.get("additionalProperties", False), bool):
        raise ValueError(f"{at}: additionalProperties must be true or false")
    for field in {**rule.get("properties", {}), **dict.fromkeys(rule.get("required", ()))}:
        if '"' in field and "'" in field:
            raise ValueError(f"{at}: names with both kinds of quotes aren't supported: {field}")
    for field, inner in rule.get("properties", {}).items():
        check_schema(inner, f"{at}.{field}")
    if "items" in rule:
        check_schema(rule["items"], f"{at}[]")


def argument_errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """Array of texts, empty for valid arguments. `arguments` is a variant, null if it isn't JSON."""
    for schema in schemas.values():
        check_schema(schema)
    out = F.array(F.concat(F.lit("unknown function "), F.coalesce(name, F.lit("null"))))
    for function, schema in schemas.items():
        out = F.when(name == function, errors_of(arguments, {"type": "object"} | schema)).otherwise(out)
    return out


def levels(nodes: DataFrame) -> DataFrame:
    """(id, level) for nodes (id, after): how many others come first; null on cycles and behind missing ones.

    Each round doubles the distance that is known, so the rounds are the logarithm of the longest chain.
    """
    here = nodes.select("id", "after", F.when(F.col("after").isNotNull(), 1).otherwise(0).cast("long").alias("level"))
    here = saved(here.groupBy("id").agg(F.min("after").alias("after"), F.min("level").alias("level")))
    rounds = max(here.count(), 1).bit_length() + 1
    while rounds and here.where("after is not null").limit(1).count():
        up = here.select(F.col("id").alias("after"), F.col("after").alias("next"), F.col("level").alias("more"), F.lit(True).alias("there"))
        waiting = here.where("after is not null").join(up, "after", "left")
        # behind a missing one: no level
        moved = waiting.select("id", F.when(F.col("there"), F.col("next")).alias("after"), F.when(F.col("there"), F.col("level") + F.col("more")).alias("level"))
        here = saved(here.where("after is null").select("id", "after", "level").union(moved))
        rounds -= 1
    return here.select("id", F.when(F.col("after").isNull(), F.col("level")).alias("level"))


def _rows_of(rows: DataFrame, status: Column | str, message: Column | None = None) -> DataFrame:
    """Rows that link with nothing."""
    null = F.lit(None)
    status = F.lit(status) if isinstance(status, str) else status
    return rows.select("id", "at", status.alias("status"), null.cast("long").alias("level"), null.cast("array<string>").alias("errors"), (null.cast("string") if message is None else message).alias("message"))


def _json(*columns: Column) -> Column:
    """Canonical JSON of columns given in code point order of their names."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _later(rows: DataFrame, *columns: str) -> DataFrame:
    """(id, at) of rows with an id that aren't the earliest of it; of rows that are alike one may be."""
    counted = rows.where("id is not null").groupBy("id", *columns).agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("id").agg(F.min(F.struct(*columns)).alias("first"))
    n = F.when(F.struct(*columns) == F.col("first"), F.col("n") - 1).otherwise(F.col("n"))
    return counted.join(first, "id").withColumn("n", n).where("n > 0").select("id", "at", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_")).drop("_")


def link(calls: DataFrame, results: DataFrame, schemas: dict, context: DataFrame | None = None) -> DataFrame:
    """calls (id, at, name, arguments: JSON text, after), results (id, at, content), context (at, role, content): one row per call and result that link, and per one that doesn't.

    `at` orders calls and results; any comparable type. Returns id, at, status, level, errors, message.
    """
    calls, results = calls.select("id", "at", "name", "arguments", "after"), results.select("id", "at", "content")
    first = calls.where("id is not null").groupBy("id").agg(F.min(F.struct("at", "name", "arguments", "after")).alias("call"))
    result = results.where("id is not null").groupBy("id").agg(F.min(F.struct("at", "content")).alias("result"))
    depth = levels(first.select("id", "call.after"))
    linked = first.join(result, "id", "full").join(depth, "id", "left").withColumn("parsed", F.try_parse_json("call.arguments"))
    errors = F.when(F.col("call").isNotNull(), argument_errors(F.col("call.name"), F.col("parsed"), schemas))
    message = _json(F.col("parsed").alias("arguments"), F.col("result.content").alias("content"), F.col("id"), F.col("call.name").alias("name"))
    status = F.when(F.col("call").isNull(), "orphan_result").when(F.col("result").isNull(), "missing_result").otherwise("linked")
    rows = linked.select("id", F.coalesce("call.at", "result.at").alias("at"), status.alias("status"), F.when(F.col("call").isNotNull(), F.col("level")).alias("level"), errors.alias("errors"), message.alias("message"))
    rows = rows.unionByName(_rows_of(_later(calls, "at", "name", "arguments", "after"), "duplicate_call")).unionByName(_rows_of(_later(results, "at", "content"), "duplicate_result"))
    nameless = _json(F.try_parse_json("arguments").alias("arguments"), F.lit(None).cast("string").alias("content"), "id", "name")
    rows = rows.unionByName(_rows_of(calls.where("id is null"), "call_without_id", nameless))
    null = F.lit(None).cast("string")
    rows = rows.unionByName(_rows_of(results.where("id is null"), "result_without_id", _json(null.alias("arguments"), F.col("content"), F.col("id"), null.alias("name"))))
    if context is None:
        return rows
    return rows.unionByName(_rows_of(context.withColumn("id", null), "context", _json(F.col("content"), F.col("role"))))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and context of conversations: a user's turn calls `reply`, an assistant's is the result of the turn before it, others are context; a call waits for that two turns before."""
    turns = turns.select("conv_id", "turn", "role", "text")

    def name(turn: Column) -> Column:
        return F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)

    at = F.struct("conv_id", "turn").alias("at")
    user = turns.where("role = 'user'")
    arguments = F.to_json(F.struct("text", "turn"))
    earlier = user.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("_earlier")).distinct()
    calls = user.join(earlier, ["conv_id", "turn"], "left").select(name(F.col("turn")).alias("id"), at, F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(F.col("_earlier"), name(F.col("turn") - 2)).alias("after"))
    results = turns.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("id"), at, F.col("text").alias("content"))
    context = turns.where("role is null or role not in ('user', 'assistant')").select(at, "role", F.col("text").alias("content"))
    return calls, results, context


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, context = from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rows = link(calls, results, SCHEMAS, context)
    return rows.select("at.conv_id", "at.turn", F.col("id").alias("call_id"), "status", "level", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", "; ").alias("errors"), F.sha2("message", 256).alias("message_sha256"))


OP5_SQL = r"""
WITH u AS (
  SELECT conv_id, turn, text, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM conversations WHERE role = 'user'
), c AS (
  SELECT conv_id, turn, text, 'c' || conv_id || '-' || turn AS id, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM u
), r AS (
  SELECT conv_id, turn, text, 'c' || conv_id || '-' || (turn - 1) AS id FROM conversations WHERE role = 'assistant'
), j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.id, r.id) AS id, c.id AS call, r.id AS result, level,
         CASE WHEN c.id IS NOT NULL THEN json_object('text', c.text, 'turn', c.turn) END AS arguments, r.text AS content, length(c.text) > 400 AS long
  FROM c FULL JOIN r ON c.id = r.id
)
SELECT conv_id, turn, id AS call_id,
       CASE WHEN call IS NULL THEN 'orphan_result' WHEN result IS NULL THEN 'missing_result' ELSE 'linked' END AS status,
       level, CASE WHEN call IS NOT NULL THEN CASE WHEN long THEN 1 ELSE 0 END END::bigint AS n_errors,
       CASE WHEN call IS NOT NULL THEN CASE WHEN long THEN 'text: too long' ELSE '' END END AS errors,
       sha256('{"arguments":' || coalesce(arguments::varchar, 'null') || ',"content":' || coalesce(to_json(content)::varchar, 'null') || ',"id":' || to_json(id)::varchar || ',"name":' || CASE WHEN call IS NULL THEN 'null' ELSE '"reply"' END || '}') AS message_sha256
FROM j
UNION ALL SELECT conv_id, turn, NULL, 'context', NULL, NULL, NULL, sha256('{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}')
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
