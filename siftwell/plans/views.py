"""Stand-in tables: alerts, facts, calls and responses derived from the given tables.

Each view has a DataFrame form here and a SQL form in VIEWS_SQL; both must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scanners import LEADING, NOT_ASSIGNED, NOT_CALLED  # noqa: F401
from ..functions.text import KEYWORDS
from ..schemas import CATEGORIES, PRIMARY_ROLES, RULE_KINDS
from ..sources.documents import lines_of


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


#: Alert documents as they are found: on one line, indented with nested and repeated keys and odd numbers, and without an id of its own.
_DEEP = '"deep": {"b": [1.50, 1e5, {"alert_id": "@id"}], "a": 12345678901234567890123456789, "a": null},'
RAW = (
    '{"alert_id":"@id","category":"@cat","n":@n}',
    f'{{\n  "category": "@cat",\n  "alert_id" : "@id",\n  {_DEEP}\n  "classification": null\n}}\n',
    r'{ "n": 1e400, "s": "\"alert_id\": {", "reason" : [] }',
)
#: The same after the id was replaced, and after a conclusion was written back.
RAW_SHORT = (
    '{"alert_id":"@short","category":"@cat","n":@n}',
    f'{{\n  "category": "@cat",\n  "alert_id" : "@short",\n  {_DEEP}\n  "classification": null\n}}\n',
    r'{ "n": 1e400, "s": "\"alert_id\": {", "reason" : [], "alert_id": "@short" }',
)
RAW_WRITTEN = (
    '{"alert_id":"@id","category":"@cat","n":@n,"classification":"@class","reason":"@why"}',
    f'{{\n  "category": "@cat",\n  "alert_id" : "@id",\n  {_DEEP}\n  "classification": "@class",\n  "reason": "@why"\n}}\n',
    r'{ "n": 1e400, "s": "\"alert_id\": {", "reason" : "@why", "classification": "@class" }',
)


def raw_document(shape: Column, **values: Column) -> Column:
    """One of RAW with its marks filled."""
    out = F.get(F.array(*map(F.lit, RAW)), shape.cast("int"))
    for name, value in values.items():
        out = F.replace(out, F.lit(f"@{name}"), value.cast("string"))
    return out


def raw_sql(texts: tuple[str, ...], shape: str, **values: str) -> str:
    """The same for the oracle."""
    out = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + f"][({shape} + 1)::int]"
    for name, value in values.items():
        out = f"replace({out}, '@{name}', {value}::varchar)"
    return out


def _node(role: Column, file: Column, line: Column, column: Column) -> Column:
    return F.struct(role.alias("role"), F.struct(file.alias("file"), line.cast("string").alias("line"), column.cast("long").cast("string").alias("column")).alias("location"))


def alerts(spark: SparkSession, d: str, with_paths: bool = True) -> DataFrame:
    """One alert per order; its path are the order's line items. Without paths, line items aren't read."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_tax")
    paths = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    node = lambda x: _node(_pick(PRIMARY_ROLES, x["l_linenumber"] % 6), F.concat(F.lit("src/f"), x["l_partkey"] % 50, F.lit(".c")), x["l_suppkey"], F.when(x["l_tax"] != 0, F.round(x["l_tax"] * 100)))
    o = table(spark, d, "orders")
    o = o.join(paths, F.col("o_orderkey") == F.col("l_orderkey"), "left") if with_paths else o.withColumn("items", F.lit(None).cast("array<struct<l_linenumber: int, l_partkey: bigint, l_suppkey: bigint, l_tax: double>>"))
    own = F.concat(F.lit("src/f"), F.col("o_custkey") % 50, F.lit(".c"))
    path = F.transform("items", node)
    category = _pick(CATEGORIES, F.col("o_orderkey") % 5)
    alert_id = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return o.select(
        alert_id.alias("alert_id"),
        category.alias("category"),
        path.alias("path"),
        F.when(F.col("o_orderstatus") == "F", _node(F.lit("allocation"), own, F.col("o_custkey"), F.lit(None))).alias("allocation"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.struct(F.slice(path, 1, 2).alias("path")))).alias("paths"),
        F.lit(None).cast("string").alias("leak_condition"),
        F.struct(F.col("o_orderpriority").alias("kind"), F.struct(own.alias("file"), F.col("o_custkey").cast("string").alias("line"), F.lit(None).cast("string").alias("column")).alias("location")).alias("access"),
        F.struct(F.struct(F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("t"), F.col("o_custkey") % 7)).alias("type"), F.col("o_orderpriority").alias("descriptor")).alias("memory_object")).alias("evidence"),
        F.lit(None).cast("string").alias("range_analysis"),
        F.when(F.col("o_orderstatus") == "F", "TP").when(F.col("o_orderstatus") == "P", "FP").alias("classification"),
        F.lit(None).cast("string").alias("reason"),
        F.concat(F.lower(category), F.lit("/"), alert_id, F.lit(".json")).alias("file_path"),
        raw_document(F.col("o_orderkey") % 3, id=alert_id, cat=category, n=F.col("o_custkey")).alias("raw"),
    )


def source_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files (file, text)."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.lit("src/"), "lang", F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", F.lit("/d"), F.col("doc_id") % 50, F.lit(".c")).alias("file"), "text")


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(source_texts(spark, d))


def documents_of(keys: Column, n: int) -> Column:
    """One of n documents for each key."""
    return F.pmod(keys * 7919, F.lit(n)).alias("doc_id")


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of ten lines, and one function around each file."""
    sizes = source_lines(spark, d).groupBy("file").agg(F.max("ln").alias("n"))
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 10).cast("int")))
    inner = sizes.select("file", "n", block.alias("b")).select(F.concat(F.lit("f"), "b", F.lit("_"), F.element_at(F.split("file", "/"), -2), F.when(F.col("b") % 2 == 0, "C2E").otherwise("x")).alias("function_name"), F.col("file").alias("filename"), (F.col("b") * 10 + 1).alias("start_line"), F.least(F.col("b") * 10 + 10, F.col("n")).alias("end_line"))
    outer = sizes.select(F.concat(F.lit("whole_"), F.element_at(F.split("file", "/"), -2)).alias("function_name"), F.col("file").alias("filename"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"))
    return inner.unionByName(outer)


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    """Line items as call edges; the place is a line of some document."""
    n = table(spark, d, "documents").count()
    return table(spark, d, "lineitem").select(F.concat(F.lit("g"), "l_orderkey").alias("caller"), F.concat(F.lit("g"), "l_partkey").alias("callee"), documents_of(F.col("l_orderkey"), n), F.col("l_linenumber").cast("int").alias("ln"))


def path_events(spark: SparkSession, d: str) -> DataFrame:
    """Line items as events: a request per order, a path per flag pair."""
    n = table(spark, d, "documents").count()
    order = W.partitionBy("l_orderkey", "l_returnflag", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_tax")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", F.row_number().over(order).alias("event_no"), F.count(F.lit(1)).over(W.partitionBy("l_orderkey", "l_returnflag", "l_linestatus")).alias("n_events"))
    return rows.select(F.col("l_orderkey").alias("req_id"), F.concat("l_returnflag", "l_linestatus").alias("path_no"), "event_no", "n_events", F.when(F.col("l_linenumber") % 2 == 0, "call").otherwise("condition").alias("type"), documents_of(F.col("l_partkey"), n), F.col("l_linenumber").cast("int").alias("ln"))


def with_file(rows: DataFrame, spark: SparkSession, d: str, name: str = "fl") -> DataFrame:
    """rows (doc_id) with the file of that document."""
    return rows.join(source_texts(spark, d).select("doc_id", F.col("file").alias(name)), "doc_id").drop("doc_id")


def tool_events(spark: SparkSession, d: str) -> DataFrame:
    return tool_responses(table(spark, d, "events"))


def tool_responses(events: DataFrame) -> DataFrame:
    """Events as tool responses of nine shapes."""
    k, n = F.col("event_id") % 9, F.col("event_id")
    no_file = "No such file, please check filename."
    response = (
        F.when(k == 0, F.concat(F.lit('{"error":"failed '), n, F.lit('"}')))
        .when(k == 1, F.lit(f'"{no_file}"'))
        .when(k == 2, F.lit(f'{{"error":false,"function_body":" {no_file} "}}'))
        .when(k == 3, F.lit(None).cast("string"))
        .when(k == 4, F.concat(F.lit('{"function_body":"'), F.repeat(F.lit("int x; "), 60), n, F.lit('"}')))
        .when(k == 5, F.concat(F.lit('"ERROR: '), F.repeat(F.lit("long "), 120), n, F.lit('"')))
        .when(k == 6, F.lit('[{"error":"in a list"}]'))
        .when(k == 7, F.concat(F.lit('{"error":{"code":'), n % 3, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"error":'), n % 2, F.lit(',"function_body":"File not found: a.c"}')))
    )
    return events.select(F.col("event_id"), "ts", F.col("user_id").cast("string").alias("batch_id"), F.lit(1).alias("turn"), F.col("event_type").alias("tool"), F.lit("").alias("context"), F.col("props").alias("arguments"), response.alias("response"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Four alerts per conversation."""
    convs = table(spark, d, "conversations").select("conv_id").distinct()
    return convs.select(F.concat(F.lit("B"), "conv_id").alias("batch_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("batch_id", F.concat("batch_id", F.lit("-A"), "i").alias("short_id"), F.sha2(F.concat("batch_id", F.lit(":"), "i"), 256).alias("alert_id"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return conclusion_calls(table(spark, d, "conversations"))


def conclusion_calls(turns: DataFrame) -> DataFrame:
    """Turns as conclusion calls about two alerts; overlaps, repeats and unknown ids occur."""
    c = turns.select("conv_id", "turn")
    b = F.concat(F.lit("B"), "conv_id")
    short = lambda i: F.concat(b, F.lit("-A"), i)
    ids = F.array(short((F.col("conv_id") + F.col("turn")) % 4), short((F.col("conv_id") * F.col("turn") + 1) % 5))
    kind = _pick(("TP", "FP", "UNCERTAIN", "MAYBE"), (F.col("conv_id") + 2 * F.col("turn")) % 4)
    return c.select(b.alias("batch_id"), F.col("turn").cast("int").alias("turn"), F.lit(0).alias("call_idx"), ids.alias("alert_ids"), kind.alias("classification"), F.concat(F.lit(" because "), "turn").alias("reason"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.concat(F.lit("B"), "conv_id").alias("batch_id"), F.col("turn").cast("int").alias("turn"), F.when(F.col("turn") % 3 > 0, 1).otherwise(0).alias("n_calls"), (F.col("conv_id") % 5 + 1).cast("int").alias("n_alerts"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rule candidates; one kind of ten is not allowed."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey"),
        _pick((*RULE_KINDS, "nonsense"), F.col("p_size") % 10).alias("kind"),
        F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.concat("p_name", F.lit(" "))).alias("function"),
        _pick(("exact", "substring", "fuzzy"), F.col("p_partkey") % 3).alias("match"),
        F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(' "é"\n'))).otherwise("").alias("effect"),
        F.when(F.col("p_size") % 3 == 0, (F.col("p_size") % 4).cast("string")).alias("target_arg"),
        F.when(F.col("p_size") % 5 == 0, "x").alias("source_arg"),
        F.lit(None).cast("string").alias("length_arg"),
        F.lit(None).cast("string").alias("field_path"),
        F.lit(None).cast("string").alias("pair"),
        F.concat(F.lit("0."), F.col("p_size") % 7).alias("confidence"),
        F.lit(None).cast("string").alias("reason"),
        F.concat(F.lit("a"), "p_partkey").alias("source_alert_id"),
    )


def code_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of pages between `<` as code lines."""
    p = table(spark, d, "pages")
    return p.where("html is not null").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("file"), F.posexplode(F.split("html", "<", -1)).alias("ln", "text"))


def listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_HEAD = r"'([a-zA-Z_][a-zA-Z0-9_]*)\s*$'"
#: The same views for the oracle.
VIEWS_SQL = {
    "alerts_v": """
  SELECT sha256(o_orderkey::varchar) AS alert_id, o_orderkey,
    ['MEMORY_LEAK', 'DOUBLE_FREE', 'USE_AFTER_FREE', 'UNINIT_USE', 'BUFFER_OVERFLOW'][(o_orderkey % 5 + 1)::int] AS category,
    o_orderpriority AS kind, 'src/f' || (o_custkey % 50) || '.c' AS own, o_custkey,
    CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 't' || (o_custkey % 7) END AS mem_type, o_orderstatus,
    CASE o_orderstatus WHEN 'F' THEN 'TP' WHEN 'P' THEN 'FP' END AS classification FROM orders""",
    "items_v": """
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax) AS n,
    ['use', 'second_free', 'free', 'first_free', 'allocation', 'object_origin'][l_linenumber % 6 + 1] AS role,
    'src/f' || (l_partkey % 50) || '.c' AS file, l_suppkey AS line, CASE WHEN l_tax <> 0 THEN round(l_tax * 100)::bigint END AS col FROM lineitem""",
    "nodes_v": """
  SELECT alert_id, category, n AS pos, role, file, line, col FROM alerts_v JOIN items_v ON o_orderkey = l_orderkey
  UNION ALL SELECT alert_id, category, 1000, 'allocation', own, o_custkey, NULL FROM alerts_v WHERE o_orderstatus = 'F'
  UNION ALL SELECT alert_id, category, 2000 + n, role, file, line, col FROM alerts_v JOIN items_v ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' AND n <= 2""",
    "primary_v": """
  SELECT alert_id, category, file AS fl, line AS ln, coalesce(col, 0) AS cl FROM (
    SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY list_position(['use', 'second_free', 'free', 'first_free', 'allocation', 'object_origin'], role), pos DESC) AS r FROM nodes_v)
  WHERE r = 1 AND category <> 'BUFFER_OVERFLOW'
  UNION ALL SELECT alert_id, category, own, o_custkey, 0 FROM alerts_v WHERE category = 'BUFFER_OVERFLOW'""",
    "keys_v": """
  SELECT a.alert_id, a.category, CASE a.category
    WHEN 'MEMORY_LEAK' THEN '(''' || a.category || ''', ''' || a.alert_id || ''')'
    WHEN 'DOUBLE_FREE' THEN '(''' || a.category || ''', ''' || a.alert_id || ''')'
    WHEN 'USE_AFTER_FREE' THEN '(''' || a.category || ''', ''' || f.file || ''', ' || f.line || ')'
    WHEN 'UNINIT_USE' THEN '(''' || a.category || ''', ''' || coalesce(nullif(mem_type, ''), kind) || ''')'
    ELSE '(''' || a.category || ''', ''' || kind || ''')' END AS batch_key, classification
  FROM alerts_v a LEFT JOIN (SELECT l_orderkey, arg_min(file, n) AS file, arg_min(line, n) AS line FROM items_v WHERE role = 'free' GROUP BY 1) f ON o_orderkey = l_orderkey""",
    "pending_v": """
  SELECT k.* FROM keys_v k JOIN primary_v USING (alert_id) WHERE classification IS NULL AND batch_key IS NOT NULL""",
    "batches_v": """
  SELECT alert_id, no AS batch_no, 'B' || CASE WHEN no < 10000 THEN lpad(no::varchar, 4, '0') ELSE no::varchar END AS batch_id, (rn % 8 + 1)::int AS pos FROM (
    SELECT alert_id, rn, dense_rank() OVER (ORDER BY batch_key, rn // 8) AS no FROM (
      SELECT alert_id, batch_key, row_number() OVER (PARTITION BY batch_key ORDER BY lower(category) || '/' || alert_id) - 1 AS rn FROM pending_v))""",
    "files_v": """
  SELECT doc_id, 'src/' || lang || '/' || coalesce(source, 'none') || '/' || doc_id || '/d' || (doc_id % 50) || '.c' AS file, text FROM documents""",
    "lines_v": """
  SELECT doc_id, file, ln, line AS text FROM (
    SELECT doc_id, file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln, len(string_split(text, chr(10))) AS n FROM files_v WHERE text IS NOT NULL)
  WHERE line <> '' OR ln < n""",
    "functions_v": """
  SELECT 'f' || b || '_' || doc_id || CASE WHEN b % 2 = 0 THEN 'C2E' ELSE 'x' END AS function_name, file AS filename, b * 10 + 1 AS start_line, least(b * 10 + 10, n) AS end_line
  FROM (SELECT doc_id, file, n, unnest(range((n - 1) // 10 + 1)) AS b FROM (SELECT doc_id, file, max(ln) AS n FROM lines_v GROUP BY 1, 2))
  UNION ALL SELECT 'whole_' || doc_id, file, 1, max(ln) FROM lines_v GROUP BY doc_id, file""",
    "sites_v": """
  SELECT 'g' || l_orderkey AS caller, 'g' || l_partkey AS callee, file AS fl, l_linenumber AS ln FROM lineitem JOIN files_v ON doc_id = l_orderkey * 7919 % (SELECT count(*) FROM documents)""",
    "events_v": """
  SELECT req_id, path_no, event_no, type, file AS fl, ln FROM (
    SELECT l_orderkey AS req_id, l_returnflag || l_linestatus AS path_no, CASE WHEN l_linenumber % 2 = 0 THEN 'call' ELSE 'condition' END AS type, l_partkey * 7919 % (SELECT count(*) FROM documents) AS d, l_linenumber AS ln,
      row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax) AS event_no FROM lineitem)
  JOIN files_v ON doc_id = d""",
    "tools_v": """
  SELECT event_id, ts, user_id::varchar AS batch_id, event_type AS tool, CASE event_id % 9
    WHEN 0 THEN '{"error":"failed ' || event_id || '"}' WHEN 1 THEN '"No such file, please check filename."'
    WHEN 2 THEN '{"error":false,"function_body":" No such file, please check filename. "}' WHEN 3 THEN NULL
    WHEN 4 THEN '{"function_body":"' || repeat('int x; ', 60) || event_id || '"}' WHEN 5 THEN '"ERROR: ' || repeat('long ', 120) || event_id || '"'
    WHEN 6 THEN '[{"error":"in a list"}]' WHEN 7 THEN '{"error":{"code":' || (event_id % 3) || '}}'
    ELSE '{"error":' || (event_id % 2) || ',"function_body":"File not found: a.c"}' END AS response FROM events""",
    "parsed_v": """
  SELECT *, json_type(response::json) AS t, CASE WHEN json_type(response::json) = 'VARCHAR' THEN response::json ->> '$' END AS s, json_type(response::json, '$.error') AS et, response::json ->> '$.error' AS e, response::json ->> '$.function_body' AS b FROM tools_v""",
    "failures_v": """
  SELECT * FROM (
    SELECT event_id, ts, batch_id, tool, CASE
      WHEN response IS NULL THEN 'null_response' WHEN t = 'VARCHAR' THEN CASE WHEN trim(s) = 'No such file, please check filename.' THEN 'no_such_file' WHEN lower(trim(s)) LIKE 'error:%' THEN 'error_string' END
      WHEN t = 'OBJECT' AND et IS NOT NULL AND e NOT IN ('false', '', '0') THEN 'error_dict'
      WHEN t = 'OBJECT' AND trim(b) = 'No such file, please check filename.' THEN 'degraded_no_such_file'
      WHEN t = 'OBJECT' AND trim(b) LIKE 'File not found:%' THEN 'degraded_file_not_found' END AS failure_kind,
      left(CASE WHEN response IS NULL THEN 'tool returned None' WHEN t = 'VARCHAR' THEN s WHEN et IS NOT NULL AND e NOT IN ('false', '', '0') THEN e ELSE b END, 500) AS detail FROM parsed_v)
  WHERE failure_kind IS NOT NULL""",
    "members_v": """
  SELECT 'B' || conv_id AS batch_id, 'B' || conv_id || '-A' || i AS short_id, sha256('B' || conv_id || ':' || i) AS alert_id FROM (SELECT DISTINCT conv_id FROM conversations), range(4) r(i)""",
    "calls_v": """
  SELECT 'B' || conv_id AS batch_id, turn, ['B' || conv_id || '-A' || ((conv_id + turn) % 4), 'B' || conv_id || '-A' || ((conv_id * turn + 1) % 5)] AS ids,
    ['TP', 'FP', 'UNCERTAIN', 'MAYBE'][((conv_id + 2 * turn) % 4 + 1)::int] AS classification, ' because ' || turn AS reason,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations""",
    "candidates_v": """
  SELECT p_partkey, ['initializer', 'memory_transfer', 'allocator', 'deallocator', 'resource_open', 'resource_close', 'ownership_transfer', 'heap_object_summary', 'domain_hint', 'nonsense'][(p_size % 10 + 1)::int] AS kind,
    CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name || ' ' END AS function, CASE p_partkey % 3 WHEN 1 THEN 'substring' ELSE 'exact' END AS match,
    CASE WHEN p_size % 2 = 0 THEN p_type || ' "é"' || chr(10) END AS effect, CASE WHEN p_size % 3 = 0 THEN (p_size % 4)::varchar END AS target_arg,
    CASE WHEN p_size % 5 = 0 THEN 'x' END AS source_arg, '0.' || (p_size % 7) AS confidence FROM part""",
    "rules_v": """
  SELECT p_partkey, 'proposed-' || kind || '-' || left(sha256('{"confidence": ' || confidence || coalesce(', "effect": ' || to_json(effect)::varchar, '') || ', "function": ' || to_json(function)::varchar || ', "kind": "' || kind || '", "match": "' || match || '"' ||
      coalesce(', "source_arg": ' || source_arg, '') || coalesce(', "target_arg": ' || target_arg, '') || '}'), 16) AS id,
    kind, trim(function) AS function, match, effect, try_cast(target_arg AS int) AS target_arg, try_cast(source_arg AS int) AS source_arg, confidence::double AS confidence, 'a' || p_partkey AS source_alert_id
  FROM candidates_v WHERE kind <> 'nonsense' AND trim(function) <> ''""",
    "depth_v": """
  SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY file, ln ORDER BY i) AS depth
  FROM (SELECT file, ln, text, i, substr(text, i::int, 1) AS c FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM code_v WHERE contains(text, '(') OR contains(text, '=')))""",
    "callargs_v": rf"""
  SELECT file, ln, dense_rank() OVER (PARTITION BY file, ln ORDER BY start) - 1 AS call_no, function, row_number() OVER (PARTITION BY file, ln, start ORDER BY i) - 1 AS idx, arg FROM (
    SELECT *, trim(substr(text, i + 1, next - i - 1), {_WS}) AS arg, regexp_extract(left(text, start - 1), {_HEAD}, 1) AS function FROM (
      SELECT *, max(CASE WHEN c = ')' THEN 1 ELSE 0 END) OVER (PARTITION BY file, ln, level, g) AS closed, min(i) FILTER (c = '(') OVER (PARTITION BY file, ln, level, g)::int AS start FROM (
        SELECT *, lead(i) OVER w AS next, lead(c) OVER w AS next_c, sum(CASE WHEN c = '(' THEN 1 ELSE 0 END) OVER w AS g
        FROM (SELECT file, ln, text, i::int AS i, c, depth - CASE c WHEN ')' THEN 0 ELSE 1 END AS level FROM depth_v WHERE c IN ('(', ')', ',')) WINDOW w AS (PARTITION BY file, ln, level ORDER BY i)))
    WHERE closed = 1 AND g > 0 AND c <> ')' AND next_c <> '(')
  WHERE function <> '' AND function NOT IN {listed(KEYWORDS)} AND (arg <> '' OR next_c = ',')""",
    "groups_v": rf"""
  SELECT s.*, trim(substr(text, start + 1, stop - start - 1), {_WS}) AS inner_text FROM (
    SELECT s.*, (SELECT min(i) FROM depth_v d WHERE d.file = s.file AND d.ln = s.ln AND d.c = ')' AND d.i > s.start AND d.depth = s.outside)::int AS stop FROM (
      SELECT file, ln, text, kind, place, min(start)::int AS start, arg_min(depth, start) - 1 AS outside FROM (
        SELECT file, ln, text, 'first' AS kind, -1 AS place, i AS start, depth FROM depth_v WHERE c = '('
        UNION ALL SELECT file, ln, text, 'call', place, i, depth FROM (
          SELECT *, CASE WHEN n IS NULL THEN -1 ELSE n - 1 - length(regexp_extract(left(text, n - 1), '([a-zA-Z_][a-zA-Z0-9_]*\s*)$', 1)) END AS place FROM (
            SELECT d.*, n FROM depth_v d LEFT JOIN (SELECT file, ln, min(i)::int AS n FROM depth_v WHERE c = '(' AND regexp_extract(left(text, i::int - 1), {_HEAD}, 1) NOT IN {listed(("", *NOT_CALLED))} GROUP BY 1, 2) h ON h.file = d.file AND h.ln = d.ln WHERE c = '(' AND (n IS NULL OR i = n))))
      GROUP BY ALL) s) s""",
    "code_v": """
  SELECT 'p' || page_id || '.html' AS file, unnest(string_split(html, '<')) AS text, generate_subscripts(string_split(html, '<'), 1) - 1 AS ln FROM pages WHERE html IS NOT NULL""",
}
#: One step per call: what is claimed so far, and why the call is refused.
WALK = """
walk_v AS (
  SELECT batch_id, 0::bigint AS k, -1::bigint AS turn, []::varchar[] AS ids, ''::varchar AS classification, ''::varchar AS reason, []::varchar[] AS claimed, 'start'::varchar AS error FROM (SELECT DISTINCT batch_id FROM calls_v)
  UNION ALL
  SELECT batch_id, k, turn, ids, classification, reason, CASE WHEN error IS NULL THEN list_concat(claimed, ids) ELSE claimed END, error FROM (
    SELECT c.batch_id, c.k, c.turn, c.ids, c.classification, c.reason, w.claimed, CASE
      WHEN c.classification = 'MAYBE' THEN 'invalid classification or reason'
      WHEN list_contains(w.claimed, c.ids[1]) THEN 'alert id already classified: ' || c.ids[1]
      WHEN c.ids[2] LIKE '%-A4' THEN 'unknown alert id: ' || c.ids[2]
      WHEN list_contains(w.claimed, c.ids[2]) OR c.ids[1] = c.ids[2] THEN 'alert id already classified: ' || c.ids[2] END AS error
    FROM walk_v w JOIN calls_v c ON c.batch_id = w.batch_id AND c.k = w.k + 1))"""


def with_views(sql: str, *names: str) -> str:
    """sql with the views that it names, and those that these name, in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS_SQL.items():
            if name in text and name not in order:
                need(body)
                order.append(name)
        if "walk_v" in text and "walk_v" not in order:
            need("calls_v")
            order.append("walk_v")

    need(sql)
    parts = [WALK.strip() if n == "walk_v" else f"{n} AS ({VIEWS_SQL[n]})" for n in order]
    if not parts:
        return sql
    head = "WITH RECURSIVE " if "walk_v" in order else "WITH "
    own = sql.startswith("WITH ")
    return head + ",\n".join(parts) + (",\n" if own else "\n") + sql.removeprefix("WITH ")
