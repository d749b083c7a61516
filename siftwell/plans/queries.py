"""Registered queries: each operator over the stand-in tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import work
from ..functions import scanners
from ..functions import text as T
from ..operators import alerts as A
from ..operators import batching, failures, ledger, lookups, rules, tools
from ..schemas import CATEGORIES
from ..sources import documents, sinks
from ..streaming import jobs
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = V.with_views(sql)
        return f

    return add


# alerts


@query("SELECT coalesce(category, '*') AS category, count(*) AS n_alerts, count(classification) AS n_classified, count(*) - count(classification) AS n_pending FROM alerts_v GROUP BY GROUPING SETS ((category), ())")
def alert_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.stats(V.alerts(spark, d, with_paths=False))


@query("SELECT alert_id, row_number() OVER (PARTITION BY alert_id ORDER BY pos) - 1 AS pos, role, file, line, col FROM nodes_v")
def alert_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = V.alerts(spark, d).select("alert_id", F.posexplode(A.path_nodes()).alias("pos", "n"))
    return rows.select("alert_id", F.col("pos").cast("long").alias("pos"), "n.role", "n.location.file", F.col("n.location.line").cast("long").alias("line"), F.col("n.location.column").cast("long").alias("col"))


@query("""SELECT alert_id, fl, ln, cl, fl || ':' || ln AS source_location, CASE WHEN ln IS NULL THEN 'no primary location' END AS problem
FROM alerts_v LEFT JOIN primary_v USING (alert_id)""")
def primary_location(spark: SparkSession, d: str) -> DataFrame:
    rows = A.keyed(V.alerts(spark, d))
    problem = F.when(F.col("loc").isNull(), "no primary location")
    return rows.select("alert_id", "loc.fl", F.col("loc.ln").cast("long").alias("ln"), F.col("loc.cl").cast("long").alias("cl"), "source_location", problem.alias("problem"))


@query("SELECT alert_id, category, batch_key FROM keys_v")
def batch_key(spark: SparkSession, d: str) -> DataFrame:
    return A.keyed(V.alerts(spark, d)).select("alert_id", "category", "batch_key")


@query("""SELECT CASE WHEN p.alert_id IS NULL THEN 'no primary location' ELSE 'no batch key' END AS problem, count(*) AS n
FROM keys_v k LEFT JOIN primary_v p USING (alert_id) WHERE p.alert_id IS NULL OR batch_key IS NULL GROUP BY 1""")
def quarantined_alerts(spark: SparkSession, d: str) -> DataFrame:
    return A.quarantine(A.keyed(V.alerts(spark, d)))[1].groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return A.quarantine(A.keyed(A.pending(V.alerts(spark, d))))[0]


@query("SELECT alert_id, batch_no, batch_id, pos FROM batches_v")
def make_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.make_batches(_pending(spark, d)).select("alert_id", "batch_no", "batch_id", "pos")


@query("SELECT alert_id, batch_id || '-A' || lpad(pos::varchar, 2, '0') AS short_id FROM batches_v")
def short_ids(spark: SparkSession, d: str) -> DataFrame:
    return batching.make_batches(_pending(spark, d)).select("alert_id", "short_id")


@query(f"""SELECT batch_no, batch_id, count(*) AS n_alerts, 'Batch ' || batch_id || chr(10) || chr(10) || string_agg('Classify this static-analysis alert. ' || CASE a.category
  WHEN 'MEMORY_LEAK' THEN '{A.LEAK_HINT}' WHEN 'BUFFER_OVERFLOW' THEN '{A.RANGE_HINT}' ELSE '{A.PATH_HINT}' END || chr(10) || chr(10) ||
  {V.raw_sql(V.RAW_SHORT, "o_orderkey % 3", id="alert_id", cat="a.category", n="o_custkey", short="batch_id || '-A' || lpad(pos::varchar, 2, '0')")}, chr(10) || chr(10) || '--- NEXT ALERT ---' || chr(10) || chr(10) ORDER BY pos) AS prompt
FROM batches_v JOIN alerts_v a USING (alert_id) GROUP BY batch_no, batch_id""")
def batch_prompts(spark: SparkSession, d: str) -> DataFrame:
    alerts = work.saved(_pending(spark, d).select("alert_id", "batch_key", "file_path", "hint", "raw"))
    return batching.prompts(batching.make_batches(alerts), alerts)


# tool responses


@query("SELECT event_id, batch_id, tool, failure_kind, detail FROM failures_v")
def tool_failures(spark: SparkSession, d: str) -> DataFrame:
    return failures.failures(V.tool_events(spark, d)).select("event_id", "batch_id", "tool", "failure_kind", "detail")


@query("""SELECT CASE WHEN grouping(tool) = 0 THEN 'tool' WHEN grouping(failure_kind) = 0 THEN 'kind' ELSE 'total' END AS "by", coalesce(tool, failure_kind) AS name, count(*) AS n
FROM failures_v GROUP BY GROUPING SETS ((tool), (failure_kind), ())""")
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    return failures.summary(failures.failures(V.tool_events(spark, d)))


@query("""SELECT event_id, CASE WHEN t = 'VARCHAR' AND length(s) > 500 THEN to_json(left(s, 500) || '...')::varchar
  WHEN t = 'OBJECT' AND length(b) > 300 THEN '{"function_body":' || to_json(left(b, 300) || '...')::varchar || '}' ELSE response END AS response FROM parsed_v""")
def failure_compact(spark: SparkSession, d: str) -> DataFrame:
    return V.tool_events(spark, d).select("event_id", failures.compact(F.col("response")).alias("response"))


# rules

_RULE = "id, kind, function, match, effect, target_arg, source_arg, confidence, source_alert_id"


@query(f"SELECT p_partkey, {_RULE} FROM rules_v")
def rule_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rules.to_rules(V.candidates(spark, d)).select("p_partkey", *_RULE.split(", "))


@query("SELECT id, count(*) AS n FROM rules_v GROUP BY id")
def rule_ids(spark: SparkSession, d: str) -> DataFrame:
    return rules.to_rules(V.candidates(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _repository(spark: SparkSession, d: str) -> DataFrame:
    """Rules of the parts whose key 3 divides, as they were appended first."""
    return rules.first_of_each(rules.to_rules(V.candidates(spark, d).where("p_partkey % 3 = 0")), "p_partkey")


_OLD = "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS r FROM rules_v WHERE p_partkey % 3 = 0)"


@query(f"""SELECT 'old' AS part, {_RULE} FROM {_OLD} WHERE r = 1
UNION ALL SELECT 'new', {_RULE} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS r FROM rules_v WHERE id NOT IN (SELECT id FROM {_OLD})) WHERE r = 1""")
def rule_append(spark: SparkSession, d: str) -> DataFrame:
    old = _repository(spark, d)
    new = rules.new_rules(V.candidates(spark, d), old, "p_partkey")
    columns = _RULE.split(", ")
    return old.select(F.lit("old").alias("part"), *columns).unionByName(new.select(F.lit("new").alias("part"), *columns))


@query("""SELECT idx, 'rules[' || idx || ']: ' || e AS error FROM (SELECT p_partkey AS idx, unnest(list_filter([
  CASE WHEN kind = 'nonsense' THEN 'unsupported kind' END,
  CASE WHEN row_number() OVER (PARTITION BY p_partkey // 2, p_partkey % 50 = 0 ORDER BY p_partkey) > 1 OR p_partkey % 50 = 0 THEN 'missing or duplicate id' END,
  CASE WHEN p_partkey % 13 = 0 THEN 'function is required' END,
  CASE WHEN p_partkey % 3 = 2 THEN 'match must be exact or substring' END,
  CASE WHEN p_partkey % 7 = 3 THEN 'invalid status' END], lambda x: x IS NOT NULL)) AS e FROM candidates_v)""")
def rule_validate(spark: SparkSession, d: str) -> DataFrame:
    c = V.candidates(spark, d)
    key = F.col("p_partkey")
    rows = c.withColumns({
        "idx": key,
        "id": F.when(key % 50 != 0, F.concat(F.lit("r"), F.floor(key / 2))),
        "function": F.when(key % 13 != 0, F.col("function")),
        "match": F.when(key % 3 == 0, "exact").when(key % 3 == 2, "fuzzy"),
        "status": F.when(key % 7 == 3, "open").when(key % 7 == 4, "approved"),
        "proposed_by": F.lit("x"),
    })
    return rules.problems(rows).select("idx", "error")


_ALL = f"(SELECT * FROM {_OLD} WHERE r = 1 UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS r FROM rules_v WHERE id NOT IN (SELECT id FROM {_OLD})) WHERE r = 1)"


@query(f"""SELECT id, CASE WHEN p_partkey % 6 = 0 THEN 'rejected' WHEN p_partkey % 2 = 0 OR p_partkey % 9 = 0 THEN 'approved' ELSE 'proposed' END AS status FROM {_ALL}""")
def rule_review(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d).select("id", "status")


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    old = _repository(spark, d)
    every = work.saved(old.unionByName(rules.new_rules(V.candidates(spark, d), old, "p_partkey")))
    return rules.reviewed(every, every.where("p_partkey % 2 = 0 or p_partkey % 9 = 0"), every.where("p_partkey % 6 = 0"))


@query(f"SELECT id, kind, function, match, effect, confidence FROM {_ALL} WHERE p_partkey % 6 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 9 = 0)")
def rule_export(spark: SparkSession, d: str) -> DataFrame:
    return rules.approved(_reviewed(spark, d)).select("id", "kind", "function", "match", "effect", "confidence")


# lookups


@query("""SELECT 'g' || p_partkey AS callee, caller, fl, s.ln, CASE WHEN l.text IS NULL THEN 'The line number is invalid or out of range for the file.' ELSE trim(l.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS code
FROM part JOIN sites_v s ON callee = 'g' || p_partkey LEFT JOIN lines_v l ON l.file = fl AND l.ln = s.ln""")
def find_callers(spark: SparkSession, d: str) -> DataFrame:
    wanted = V.table(spark, d, "part").select(F.concat(F.lit("g"), "p_partkey").alias("callee"))
    sites = V.with_file(V.call_sites(spark, d), spark, d)
    return lookups.callers(wanted, sites, V.source_lines(spark, d)).select("callee", "caller", "fl", "ln", "code")


@query("SELECT DISTINCT caller, callee FROM sites_v")
def find_callees(spark: SparkSession, d: str) -> DataFrame:
    wanted = V.table(spark, d, "orders").select(F.concat(F.lit("g"), "o_orderkey").alias("caller"))
    return lookups.callees(wanted, V.with_file(V.call_sites(spark, d), spark, d)).select("caller", "callee")


@query("""SELECT w.doc_id AS req_id, name, CASE WHEN f.function_name IS NOT NULL THEN f.function_name END AS resolved_name,
  CASE WHEN f.function_name IS NOT NULL THEN (SELECT string_agg(text, chr(10) ORDER BY ln) FROM lines_v l WHERE l.file = f.filename AND l.ln BETWEEN f.start_line AND f.end_line) END AS body,
  CASE WHEN f.function_name IS NULL THEN 'Function body unavailable for ''' || name || '''. unknown function' END AS error
FROM (SELECT doc_id, 'f' || (doc_id % 3) || '_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN 'C1E' ELSE 'x' END AS name FROM documents) w
LEFT JOIN functions_v f ON f.function_name = name OR f.function_name = replace(name, 'C1E', 'C2E')""")
def function_body(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    wanted = V.table(spark, d, "documents").select(k.alias("req_id"), F.concat(F.lit("f"), k % 3, F.lit("_"), k, F.when(k % 2 == 0, "C1E").otherwise("x")).alias("name"))
    return lookups.function_bodies(wanted, V.functions(spark, d), V.source_lines(spark, d)).select("req_id", "name", "resolved_name", F.col("snippet").alias("body"), "error")


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document, from line 0, to some beyond the end."""
    sizes = V.source_lines(spark, d).groupBy("file").agg(F.max("ln").alias("n"))
    rows = sizes.select("file", F.explode(F.sequence(F.lit(0), F.col("n") + 6)).alias("ln"))
    return rows.select(F.concat("file", F.lit(":"), "ln").alias("req_id"), "file", "ln")


_PLACES = "(SELECT file || ':' || ln AS req_id, file, ln FROM (SELECT file, unnest(range(0, max(ln) + 7)) AS ln FROM lines_v GROUP BY file))"


@query(f"""SELECT p.req_id, p.file, p.ln, arg_min(function_name, (end_line - start_line, function_name)) AS function_name, arg_min(start_line, (end_line - start_line, function_name)) AS start_line, arg_min(end_line, (end_line - start_line, function_name)) AS end_line
FROM {_PLACES} p LEFT JOIN functions_v ON filename = file AND ln BETWEEN start_line AND end_line GROUP BY 1, 2, 3""")
def current_function(spark: SparkSession, d: str) -> DataFrame:
    rows = lookups.current_function(_places(spark, d), V.functions(spark, d))
    return rows.select("req_id", "file", "function_name", *(F.col(c).cast("long").alias(c) for c in ("ln", "start_line", "end_line")))


@query(f"""SELECT p.req_id, arg_min(function_name, (end_line - start_line, function_name)) AS function_name FROM {_PLACES} p JOIN functions_v ON filename = file AND ln BETWEEN start_line AND end_line GROUP BY 1""")
def find_callee(spark: SparkSession, d: str) -> DataFrame:
    texts = _places(spark, d).select("req_id", T.parse_location(F.col("req_id")).alias("l")).select("req_id", F.col("l.fl").alias("file"), "l.ln")
    return lookups.current_function(texts, V.functions(spark, d)).where("function_name is not null").select("req_id", "function_name")


@query(f"""SELECT p.req_id, coalesce((SELECT string_agg(text, chr(10) ORDER BY l.ln) FROM lines_v l WHERE l.file = p.file AND l.ln BETWEEN p.ln AND p.ln + 4), '') AS snippet FROM {_PLACES} p
UNION ALL SELECT 'gone' || p_partkey, 'No such file, please check filename.' FROM part""")
def source_snippet(spark: SparkSession, d: str) -> DataFrame:
    wanted = _places(spark, d).select("req_id", "file", F.col("ln").alias("start_line"), (F.col("ln") + 4).alias("end_line"))
    gone = V.table(spark, d, "part").select(F.concat(F.lit("gone"), "p_partkey").alias("req_id"), F.lit(None).cast("string").alias("file"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    return lookups.snippets(wanted.unionByName(gone), V.source_lines(spark, d)).select("req_id", "snippet")


@query(f"""SELECT req_id, CASE WHEN text IS NULL THEN 'The line number is invalid or out of range for the file.' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS line_text
FROM {_PLACES} p LEFT JOIN lines_v l ON l.file = p.file AND l.ln = p.ln""")
def source_line(spark: SparkSession, d: str) -> DataFrame:
    return lookups.source_lines_of(_places(spark, d).withColumnRenamed("file", "fl"), V.source_lines(spark, d)).select("req_id", "line_text")


_NAMES = """(SELECT doc_id, ['d' || (doc_id % 60) || '.c', './x/../' || file, '/project/' || file, '/other/' || file, 'a/' || doc_id || '/d' || (doc_id % 50) || '.c', 'q/d' || (doc_id % 50) || '.c'][(doc_id % 6 + 1)::int] AS name FROM files_v)"""


@query(f"""WITH p AS (SELECT doc_id, name, regexp_replace(replace(replace(name, 'x/../', ''), '/project/', ''), '^[./]+', '') AS norm FROM {_NAMES}),
c AS (SELECT p.*, f.file, f.file = norm OR norm LIKE '%/' || f.file AS exact, string_split(norm, '/') AS a, string_split(f.file, '/') AS b, count(*) OVER (PARTITION BY p.doc_id) AS n
  FROM p JOIN files_v f ON string_split(norm, '/')[-1] = string_split(f.file, '/')[-1]),
s AS (SELECT *, CASE WHEN a[-1] <> b[-1] THEN 0 WHEN len(a) < 2 OR len(b) < 2 OR a[-2] <> b[-2] THEN 1 ELSE 2 + CASE WHEN len(a) > 2 AND len(b) > 2 AND a[-3] = b[-3] THEN 1 ELSE 0 END END AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN exact THEN 0 ELSE 1 END, CASE WHEN norm LIKE '%/%' THEN -score ELSE 0 END, length(file), file) AS k FROM s)
SELECT p.doc_id, p.name, CASE WHEN exact OR n = 1 OR r.norm NOT LIKE '%/%' OR score > 1 THEN file END AS file FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND k = 1""")
def resolve_path(spark: SparkSession, d: str) -> DataFrame:
    files = V.source_texts(spark, d)
    k = F.col("doc_id")
    base = F.concat(F.lit("/d"), k % 50, F.lit(".c"))
    name = F.get(F.array(F.concat(F.lit("d"), k % 60, F.lit(".c")), F.concat(F.lit("./x/../"), "file"), F.concat(F.lit("/project/"), "file"), F.concat(F.lit("/other/"), "file"), F.concat(F.lit("a/"), k, base), F.concat(F.lit("q"), base)), (k % 6).cast("int"))
    return lookups.resolve_paths(files.select("doc_id", name.alias("name")), files.select(F.col("file").alias("path"))).select("doc_id", "name", "file")


@query("""SELECT o_orderkey AS req_id, l_linenumber AS ln, l_partkey AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def fact_lookup(spark: SparkSession, d: str) -> DataFrame:
    facts = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("value"))
    return lookups.lookup(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("req_id")), facts, "req_id").select("req_id", "ln", "value")


@query("""SELECT l.l_orderkey AS req_id, l.l_linenumber AS idx, f.o_custkey AS value FROM lineitem l LEFT JOIN (SELECT 'a' || (o_orderkey % 50) || ':' || (o_custkey % 40) AS location, o_orderkey % 7 AS arg_index, o_orderstatus AS callee, max(o_custkey) AS o_custkey FROM orders GROUP BY 1, 2, 3) f
ON f.location = 'a' || (l_partkey % 50) || ':' || (l_suppkey % 40) AND f.arg_index = l_linenumber AND f.callee = l_linestatus""")
def fact_lookup_argument(spark: SparkSession, d: str) -> DataFrame:
    """Facts by place, argument and callee."""
    o, n = V.table(spark, d, "orders"), F.col("o_orderkey")
    facts = o.groupBy(F.concat(F.lit("a"), n % 50, F.lit(":"), F.col("o_custkey") % 40).alias("location"), (n % 7).cast("int").alias("arg_index"), F.col("o_orderstatus").alias("callee")).agg(F.max("o_custkey").alias("value"))
    place = F.concat(F.lit("a"), F.col("l_partkey") % 50, F.lit(":"), F.col("l_suppkey") % 40)
    wanted = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("idx"), place.alias("location"), F.col("l_linenumber").cast("int").alias("arg_index"), F.col("l_linestatus").alias("callee"))
    return lookups.lookup(wanted, facts, "location", "arg_index", "callee").select("req_id", "idx", "value")


@query("""SELECT l.l_orderkey AS req_id, l.l_linenumber AS idx, f.value FROM lineitem l LEFT JOIN (SELECT 's' || s_nationkey AS function, s_suppkey % 7 AS arg_index, max(s_suppkey) AS value FROM supplier GROUP BY 1, 2) f
ON f.function = 's' || (l_suppkey % 25) AND f.arg_index = l_linenumber""")
def fact_lookup_function(spark: SparkSession, d: str) -> DataFrame:
    """Facts by function and argument."""
    facts = V.table(spark, d, "supplier").groupBy(F.concat(F.lit("s"), "s_nationkey").alias("function"), (F.col("s_suppkey") % 7).cast("int").alias("arg_index")).agg(F.max("s_suppkey").alias("value"))
    wanted = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("idx"), F.concat(F.lit("s"), F.col("l_suppkey") % 25).alias("function"), F.col("l_linenumber").cast("int").alias("arg_index"))
    return lookups.lookup(wanted, facts, "function", "arg_index").select("req_id", "idx", "value")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'f' || user_id WHEN event_id % 3 = 1 AND event_id % 7 < 5 THEN 'g' || user_id || '.c' END AS fl,
  CASE WHEN event_id % 3 = 0 THEN event_id % 1000 WHEN event_id % 3 = 1 AND event_id % 7 < 5 THEN event_id END AS ln, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 4::bigint END AS cl FROM events""")
def normalize_location(spark: SparkSession, d: str) -> DataFrame:
    """Places given as fields, as text, or not at all."""
    k, null = F.col("event_id"), F.lit(None)
    text = F.when(k % 3 == 1, F.concat(F.lit("g"), "user_id", F.lit(".c"), F.when(k % 7 < 5, ":").otherwise("-"), k)).when(k % 3 == 2, "nowhere")
    rows = V.table(spark, d, "events").select("event_id", F.when(k % 3 == 0, F.concat(F.lit("f"), "user_id")).alias("fl"), F.when(k % 3 == 0, k % 1000).alias("ln"), F.when((k % 3 == 0) & (k % 2 == 0), 4).otherwise(null).alias("cl"), text.alias("text"))
    at = lookups.located(rows).select("event_id", "at")
    return at.select("event_id", "at.fl", *(F.col(f"at.{c}").cast("long").alias(c) for c in ("ln", "cl")))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN props WHEN event_id % 4 = 1 THEN event_type || ':' || user_id WHEN event_id % 4 = 2 THEN 'x.c:' || event_id END AS location,
  CASE event_id % 5 WHEN 2 THEN '"e' || event_id || '"' WHEN 3 THEN 'true' END AS error FROM events""")
def ensure_location(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose place is filled in from its parts, with errors that are none taken out."""
    k = F.col("event_id")
    error = F.get(F.array(F.lit("false"), F.lit('""'), F.concat(F.lit('"e'), k, F.lit('"')), F.lit("true"), F.lit(None)), (k % 5).cast("int"))
    file = F.when(k % 4 == 1, F.col("event_type")).otherwise("")
    rows = V.table(spark, d, "events").select(k, F.when(k % 4 == 0, F.col("props")).otherwise("").alias("location"), file.alias("fl"), F.when(k % 4 == 2, "x.c").alias("filename"), F.when(k % 4 == 1, F.col("user_id")).alias("ln"), F.when(k % 4 != 0, k).alias("line"), error.alias("error"))
    return lookups.without_false_errors(lookups.with_locations(rows)).select("event_id", "location", "error")


@query("""SELECT req_id, location FROM (SELECT l_orderkey AS req_id, l_linenumber AS location, o_custkey % 8 AS wanted, max(l_linenumber = o_custkey % 8) OVER (PARTITION BY l_orderkey) AS found
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE location = wanted OR NOT found""")
def return_locations(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("req_id"), (F.col("o_custkey") % 8).cast("int").alias("wanted"))
    facts = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("location")).join(o, "req_id")
    return lookups.return_locations(facts).select("req_id", "location")


@query("""SELECT req_id, path_no, count(*) AS n_events, string_agg(type || ' ' || fl || ':' || e.ln || ' ' || CASE WHEN text IS NULL THEN 'The line number is invalid or out of range for the file.' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END, chr(10) ORDER BY event_no) AS events
FROM events_v e LEFT JOIN lines_v l ON l.file = fl AND l.ln = e.ln GROUP BY 1, 2""")
def path_events_code(spark: SparkSession, d: str) -> DataFrame:
    paths = lookups.path_code(V.with_file(V.path_events(spark, d), spark, d), V.source_lines(spark, d))
    text = F.array_join(F.transform("events", lambda e: F.concat(e["type"], F.lit(" "), e["location"], F.lit(" "), e["code"])), "\n")
    return paths.select("req_id", "path_no", F.size("events").cast("long").alias("n_events"), text.alias("events"))


@query(f"""SELECT req_id, ln, CASE WHEN min(CASE WHEN ok AND place = ln THEN 1 END) = 1 THEN ln ELSE min(CASE WHEN ok THEN place END) END AS anchor FROM (
  SELECT p.req_id, p.ln, l.ln AS place, contains(l.text, 'th') AS ok FROM {_PLACES} p LEFT JOIN lines_v l ON l.file = p.file AND l.ln BETWEEN greatest(p.ln - 5, 1) AND p.ln + 4) GROUP BY 1, 2""")
def reanchor(spark: SparkSession, d: str) -> DataFrame:
    wanted = _places(spark, d).select("req_id", F.col("file").alias("fl"), "ln", F.lit(" th ").alias("code"))
    return lookups.reanchored(wanted, V.source_lines(spark, d)).select("req_id", F.col("ln").cast("long").alias("ln"), F.col("anchor").cast("long").alias("anchor"))


@query("""SELECT req_id, path_no, event_no, type, ln FROM events_v JOIN (SELECT req_id, arg_min(path_no, (n, path_no)) AS path_no FROM (SELECT req_id, path_no, count(*) AS n FROM events_v GROUP BY 1, 2) GROUP BY 1) USING (req_id, path_no)""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return lookups.shortest_path(V.with_file(V.path_events(spark, d), spark, d)).select("req_id", "path_no", F.col("event_no").cast("long").alias("event_no"), "type", "ln")


@query("""SELECT file, ln, list_filter([5, 20, 60], lambda c: contains(left(text, c), 'var'))[1] AS store_column FROM code_v""")
def store_column(spark: SparkSession, d: str) -> DataFrame:
    columns = F.array(F.lit(5), F.lit(20), F.lit(60))
    return V.code_lines(spark, d).select("file", F.col("ln").cast("long").alias("ln"), lookups.store_column(columns, F.col("text"), F.lit("var")).alias("store_column"))


# conclusions


@query("SELECT batch_id, turn, error FROM walk_v WHERE k > 0")
def conclusion_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.judged(V.calls(spark, d), V.members(spark, d)).select("batch_id", F.col("turn").cast("long").alias("turn"), "error")


def _results(spark: SparkSession, d: str) -> DataFrame:
    return ledger.conclusions(ledger.judged(V.calls(spark, d), V.members(spark, d)))


_DONE = "(SELECT batch_id, unnest(ids) AS short_id, classification, reason FROM walk_v WHERE k > 0 AND error IS NULL)"


@query(f"SELECT batch_id, short_id, alert_id FROM members_v WHERE short_id NOT IN (SELECT short_id FROM {_DONE})")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return ledger.missing(V.members(spark, d), _results(spark, d)).select("batch_id", "short_id", "alert_id")


@query(f"SELECT m.batch_id, count(*) AS n_alerts, count(r.short_id) AS n_concluded, count(*) = count(r.short_id) AS complete FROM members_v m LEFT JOIN {_DONE} r USING (short_id) GROUP BY 1")
def batch_complete(spark: SparkSession, d: str) -> DataFrame:
    return ledger.coverage(V.members(spark, d), _results(spark, d))


def _written(spark: SparkSession, d: str) -> DataFrame:
    m = V.members(spark, d)
    results = _results(spark, d)
    complete = ledger.of_complete_batches(results, ledger.coverage(m, results))
    raw = V.raw_document(F.right("short_id", F.lit(1)).cast("int") % 3, id=F.col("alert_id"), cat=F.lit("none"), n=F.lit(7))
    return ledger.write_back(m.select("alert_id", raw.alias("raw")), ledger.canonical(complete, m))


@query(f"""SELECT m.alert_id, c.short_id IS NOT NULL AS written, CASE WHEN c.short_id IS NULL THEN {V.raw_sql(V.RAW, "right(m.short_id, 1)::int % 3", id="m.alert_id", cat="'none'", n="7")}
  ELSE {V.raw_sql(V.RAW_WRITTEN, "right(m.short_id, 1)::int % 3", id="m.alert_id", cat="'none'", n="7", **{"class": "classification"}, why="trim(reason)")} END AS raw
FROM members_v m LEFT JOIN (SELECT * FROM {_DONE} WHERE batch_id IN (SELECT batch_id FROM {_DONE} GROUP BY 1 HAVING count(*) = 4)) c USING (short_id)""")
def write_back(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, d).select("alert_id", "written", "raw")


@query(f"""SELECT n AS n_pending, c AS n_concluded, n - c AS n_unfinished, r AS n_rules, CASE WHEN n = c THEN 0 ELSE 1 END AS status FROM (SELECT
  (SELECT count(*) FROM members_v) AS n, (SELECT coalesce(sum(k), 0)::bigint FROM (SELECT count(*) AS k FROM {_DONE} GROUP BY batch_id HAVING count(*) = 4)) AS c,
  (SELECT count(DISTINCT id) FROM rules_v WHERE id NOT IN (SELECT id FROM {_OLD})) AS r)""")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """Write-back and rules of a run, each written once; the totals are counted on the way."""
    root = work.folder(spark)
    written, totals = ledger.observed_totals(_written(spark, d))
    sinks.write_version(written, f"{root}/alerts")
    return ledger.run_totals(spark, totals, sinks.append_rules(_repository(spark, d), V.candidates(spark, d), f"{root}/rules", "p_partkey"))


@query("""SELECT batch_id, turn, conclusion AS concluding, conclusion OR coalesce(before, false) AS forced FROM (
  SELECT 'B' || conv_id AS batch_id, turn, turn > 16 - least(16, greatest(10, conv_id % 5 + 3)) AS conclusion, lag(turn % 3 = 0) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""")
def turn_phase(spark: SparkSession, d: str) -> DataFrame:
    return ledger.turn_phase(V.turns(spark, d), max_turns=16).select("batch_id", F.col("turn").cast("long").alias("turn"), "concluding", "forced")


# texts


@query("""SELECT page_id, regexp_extract(url, '^(.+):([0-9]+)$', 1) AS fl0, t, CASE WHEN regexp_matches(t, '^.+:[0-9]+$') THEN regexp_extract(t, '^(.+):([0-9]+)$', 1) END AS fl, CASE WHEN regexp_matches(t, '^.+:[0-9]+$') THEN regexp_extract(t, '^(.+):([0-9]+)$', 2)::int END AS ln,
  regexp_matches(t, '^[^:]+\\.(c|h|cpp|inl):[0-9]+$') AS source FROM (SELECT page_id, url, ['a/b.c:' || page_id, url || ':' || page_id, 'x.c:', ':7', 'x.h:1:' || page_id][(page_id % 5 + 1)::int] AS t FROM pages)""")
def parse_location(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    t = F.get(F.array(F.concat(F.lit("a/b.c:"), k), F.concat("url", F.lit(":"), k), F.lit("x.c:"), F.lit(":7"), F.concat(F.lit("x.h:1:"), k)), (k % 5).cast("int"))
    rows = V.table(spark, d, "pages").select("page_id", "url", t.alias("t"))
    at = T.parse_location(F.col("t"))
    return rows.select("page_id", F.regexp_extract("url", "^(.+):([0-9]+)$", 1).alias("fl0"), "t", at["fl"].alias("fl"), at["ln"].alias("ln"), F.col("t").rlike(T.SOURCE_LOCATION).alias("source"))


@query("""SELECT event_id, 'f' || (event_id % 9) || '.c:' || event_id AS location, CASE WHEN event_id % 3 < 2 THEN 'LoadVFGNode' ELSE 'Addr' END AS kind FROM events WHERE event_id % 3 < 2
UNION ALL SELECT event_id, NULL, 'Addr' FROM events WHERE event_id % 3 = 2""")
def describe_location(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    file = F.concat(F.lit(', "fl": "f'), k % 9, F.lit('.c" } end'))
    text = F.when(k % 3 == 0, F.concat(F.lit('LoadVFGNode ID: { "ln": '), k, F.lit(', "cl": 7'), file)).when(k % 3 == 1, F.concat(F.lit('LoadVFGNode { "ln": '), k, file)).otherwise(F.lit("Addr none"))
    group = F.get(T.described_group(F.array(text)), F.lit(0))
    return V.table(spark, d, "events").select("event_id", group["location"].alias("location"), group["vfg_node_kind"].alias("kind"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN '{}' ELSE '{"k":' || event_id || '}' END AS json FROM events""")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    shapes = [F.concat(F.lit('{"k": '), k, F.lit("}")), F.concat(F.lit("`{'k': "), k, F.lit("}`")), F.concat(F.lit('{"k": '), k, F.lit(',}"')), F.concat(F.lit('text {"k": '), k, F.lit("} more")), F.lit(""), F.lit("{broken")]
    return V.table(spark, d, "events").select("event_id", F.to_json(T.tolerant_json(F.get(F.array(*shapes), (k % 6).cast("int")))).alias("json"))


@query("""SELECT c_name AS name, 'f' || c_nationkey || '.c:' || CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_nationkey END AS location FROM customer WHERE c_custkey % 5 > 0""")
def tags_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ext = F.when(k % 2 == 0, F.concat(F.lit("\tf\tline:"), k)).otherwise("\tf")
    row = F.concat(F.when(k % 5 == 0, "!_").otherwise(""), "c_name", F.lit("\tf"), "c_nationkey", F.lit(".c\t"), "c_nationkey", F.lit(';"'), ext)
    c = V.table(spark, d, "customer")
    tags = documents.tags_of(c.select(row.alias("value")))
    return c.select(F.col("c_name").alias("name")).join(tags, "name").select("name", "location")


@query("""SELECT file, ln, text FROM lines_v LEFT JOIN (SELECT file, max(ln) AS last FROM lines_v WHERE text LIKE 'The%' GROUP BY 1) USING (file) WHERE ln > coalesce(last, 0)""")
def tail_after_marker(spark: SparkSession, d: str) -> DataFrame:
    return documents.after_marker(V.source_lines(spark, d), "The").select("file", F.col("ln").cast("long").alias("ln"), "text")


# extraction


@query(rf"""SELECT file, ln, array_to_string(list_filter(list_transform(r, lambda x, i: CASE WHEN list_position(r, x) = i THEN x END), lambda x: x IS NOT NULL), ',') AS names FROM (
  SELECT file, ln, list_filter(regexp_extract_all(text, '([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1), lambda x: x NOT IN {V.listed(T.KEYWORDS)}) AS r FROM code_v) WHERE len(r) > 0""")
def call_names(spark: SparkSession, d: str) -> DataFrame:
    rows = V.code_lines(spark, d).select("file", "ln", T.call_names(F.col("text")).alias("names")).where("size(names) > 0")
    return rows.select("file", F.col("ln").cast("long").alias("ln"), F.array_join("names", ",").alias("names"))


_LEFT = rf"regexp_replace(trim(left(text, place::int - 1), {V._WS}), '^(\s|({'|'.join(V.LEADING)})[ (]|\()*', '')"


@query(rf"""SELECT file, ln, place - 1 AS eq_position, CASE WHEN regexp_full_match(name, '[a-zA-Z_][a-zA-Z0-9_]*') THEN name END AS name FROM (
  SELECT *, string_split(string_split(string_split(ltrim(regexp_split_to_array(trim({_LEFT}, {V._WS}), '\s+')[-1], '*'), '[')[1], '->')[-1], '.')[-1] AS name FROM (
    SELECT file, ln, any_value(text) AS text, arg_min(i, (CASE WHEN depth = 0 THEN 0 ELSE 1 END, -depth, i)) AS place FROM depth_v
    WHERE c = '=' AND substr(text, i::int + 1, 1) <> '=' AND (i = 1 OR NOT contains('{V.NOT_ASSIGNED}', substr(text, i::int - 1, 1))) AND NOT starts_with(ltrim(text, {V._WS}), 'return ') GROUP BY 1, 2))""")
def assignments(spark: SparkSession, d: str) -> DataFrame:
    return _longs(scanners.assignments(V.code_lines(spark, d)), "ln", "eq_position")


def _longs(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("long") for c in columns})


@query("SELECT file, ln, call_no, function, idx, arg FROM callargs_v")
def call_args(spark: SparkSession, d: str) -> DataFrame:
    return _longs(scanners.call_args(V.code_lines(spark, d)), "ln", "call_no", "idx")


@query(rf"""WITH t_v AS (SELECT file, ln, place, k, t, sum(CASE WHEN t IN ('(', '[', '{{') THEN 1 WHEN t IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY file, ln ORDER BY k) AS depth FROM (
  SELECT file, ln, place, unnest(p) AS t, generate_subscripts(p, 1) AS k FROM (SELECT file, ln, place, regexp_extract_all(inner_text, '(?s)\\.|\\$|"(?:[^"\\]|\\.)*"?|''(?:[^''\\]|\\.)*''?|[()\[\]{{}},]|[^()\[\]{{}},\\"'']+') AS p FROM groups_v WHERE kind = 'call')))
SELECT file, ln, place AS "at", row_number() OVER (PARTITION BY file, ln ORDER BY part) - 1 AS idx, arg FROM (
  SELECT file, ln, place, part, trim(coalesce(string_agg(t, '' ORDER BY k) FILTER (NOT cut), ''), {V._WS}) AS arg FROM (
    SELECT *, t = ',' AND depth = 0 AS cut, sum(CASE WHEN t = ',' AND depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file, ln ORDER BY k) AS part FROM t_v) GROUP BY 1, 2, 3, 4) WHERE arg <> ''""")
def actual_args(spark: SparkSession, d: str) -> DataFrame:
    return _longs(scanners.actual_arguments(V.code_lines(spark, d)), "ln", "at", "idx")


@query("""WITH w_v AS (SELECT file, ln, unnest(['0', '1', '&2']) AS variable FROM code_v)
SELECT w.file, w.ln, w.variable, arg_min(function, (call_no, idx)) AS function, arg_min(idx, (call_no, idx)) AS arg_index
FROM w_v w LEFT JOIN callargs_v a ON a.file = w.file AND a.ln = w.ln AND regexp_matches(arg, '(^|[^A-Za-z0-9_])' || ltrim(variable, '&*') || '($|[^A-Za-z0-9_])') GROUP BY 1, 2, 3""")
def arg_index(spark: SparkSession, d: str) -> DataFrame:
    code = V.code_lines(spark, d)
    wanted = code.select("file", "ln", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("&2"))).alias("variable"))
    return _longs(scanners.arg_index(wanted, scanners.call_args(code)), "ln", "arg_index")


@query(rf"""WITH c_v AS (SELECT file, ln, i, c, sum(CASE WHEN c IN ('(', '[') THEN 1 WHEN c IN (')', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY file, ln ORDER BY i) AS depth FROM (
  SELECT file, ln, i, substr(inner_text, i::int, 1) AS c FROM (SELECT *, unnest(range(1, length(inner_text) + 1)) AS i FROM groups_v WHERE kind = 'first' AND inner_text <> 'void'))),
p_v AS (SELECT file, ln, part, trim(coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT cut), ''), {V._WS}) AS p FROM (SELECT *, c = ',' AND depth = 0 AS cut, sum(CASE WHEN c = ',' AND depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file, ln ORDER BY i) AS part FROM c_v) GROUP BY 1, 2, 3),
n_v AS (SELECT file, ln, part, coalesce(nullif(regexp_extract(string_split(p, '=')[1], '\(\s*\*\s*([\p{{L}}\p{{N}}_]+)\s*\)', 1), ''), regexp_extract_all(rtrim(trim(regexp_replace(string_split(p, '=')[1], '\[[^\]\n]*\]', '', 'g'), {V._WS}), '*& '), '[\p{{L}}\p{{N}}_]+')[-1]) AS name FROM p_v WHERE p <> '...'),
k_v AS (SELECT file, ln, name, row_number() OVER (PARTITION BY file, ln ORDER BY part) - 1 AS idx FROM n_v WHERE name IS NOT NULL)
SELECT g.file, g.ln, idx, name, EXISTS (SELECT 1 FROM p_v p WHERE p.file = g.file AND p.ln = g.ln AND p = '...') AS has_varargs FROM (SELECT file, ln FROM groups_v WHERE kind = 'first') g LEFT JOIN k_v k ON k.file = g.file AND k.ln = g.ln""")
def params(spark: SparkSession, d: str) -> DataFrame:
    return _longs(scanners.params(V.code_lines(spark, d)), "ln", "idx")


@query("""WITH r_v AS (SELECT event_id AS req_id, event_type AS tool, 'g' || user_id AS name, file, event_id % 9 AS ln FROM events LEFT JOIN files_v ON doc_id = event_id * 7919 % (SELECT count(*) FROM documents)),
a_v AS (SELECT r_v.req_id, string_agg(DISTINCT callee, ',' ORDER BY callee) AS result FROM r_v JOIN sites_v ON caller = name WHERE tool = 'click' GROUP BY 1),
b_v AS (SELECT r_v.req_id, arg_min(function_name, (end_line - start_line, function_name)) AS result FROM r_v JOIN functions_v f ON f.filename = r_v.file AND r_v.ln BETWEEN start_line AND end_line WHERE tool = 'view' GROUP BY 1),
c_v AS (SELECT r_v.req_id, string_agg(text, chr(10) ORDER BY l.ln) AS result FROM r_v JOIN lines_v l ON l.file = r_v.file AND l.ln BETWEEN r_v.ln AND r_v.ln + 2 WHERE tool = 'purchase' GROUP BY 1)
SELECT req_id, tool, CASE tool WHEN 'click' THEN a_v.result WHEN 'view' THEN b_v.result WHEN 'purchase' THEN coalesce(c_v.result, '') END AS result,
  CASE WHEN tool NOT IN ('click', 'view', 'purchase') THEN 'unknown tool: ' || tool END AS error FROM r_v LEFT JOIN a_v USING (req_id) LEFT JOIN b_v USING (req_id) LEFT JOIN c_v USING (req_id)""")
def dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls of three lookup tools; others are unknown."""
    n = V.table(spark, d, "documents").count()
    events = V.table(spark, d, "events").select(F.col("event_id").alias("req_id"), F.col("event_type").alias("tool"), F.concat(F.lit("g"), "user_id").alias("caller"), V.documents_of(F.col("event_id"), n), (F.col("event_id") % 9).cast("int").alias("ln"))
    requests = events.join(V.source_texts(spark, d).select("doc_id", "file"), "doc_id", "left").drop("doc_id")

    def callees(c: DataFrame) -> DataFrame:
        found = lookups.callees(c.select("req_id", "caller"), V.with_file(V.call_sites(spark, d), spark, d))
        return c.join(found.groupBy("req_id").agg(F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("result")), "req_id", "left").select("req_id", "result")

    tools = {
        "click": callees,
        "view": lambda c: lookups.current_function(c.select("req_id", "file", "ln"), V.functions(spark, d)).withColumnRenamed("function_name", "result"),
        "purchase": lambda c: lookups.snippets(c.select("req_id", "file", F.col("ln").alias("start_line"), (F.col("ln") + 2).alias("end_line")), V.source_lines(spark, d)).withColumnRenamed("snippet", "result"),
    }
    return lookups.dispatched(requests, tools)


# streams


_TOOLS = "['set_conclusion', 'dump_source_snippet', 'dump_source_line', 'find_callee', 'find_current_function', 'find_callers', 'find_function_body', 'get_path_cond_func_', 'dump_source_line', 'nope', 'find_callers']"


def _tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls of all eight tools, some with text that is nearly JSON, some that can't run."""
    n, k, ln = V.table(spark, d, "documents").count(), F.col("event_id"), F.col("event_id") % 9
    events = V.table(spark, d, "events").select("event_id", "user_id", V.documents_of(k, n)).join(V.source_texts(spark, d).select("doc_id", "file"), "doc_id")
    text = [
        F.format_string('{"alert_ids":["A%s",],"classification":"%s","reason":"r"}', k, F.when(k % 2 == 1, "MAYBE").otherwise("TP")),
        F.format_string('`{"file_name":"%s","start_line":%s,"end_line":%s}`', "file", ln, ln + 2),
        F.format_string('{"file_name":"%s","line_number":%s}', "file", ln),
        F.format_string('{"source_location":"%s:%s"}', "file", ln),
        F.format_string('{"source_location":"/elsewhere/%s:%s"}', "file", ln),
        F.format_string("{'function_name':'g%s'}", "user_id"),
        F.format_string('{"function_name":"f0_%sC1E"}', "doc_id"),
        F.format_string('{"start":"%s:1","start_code":"","target":"%s:2","target_code":""}', "file", "file"),
        F.format_string('{"file_name":"%s","line_number":"x"}', "file"),
        F.lit("{}"),
        F.lit("{nope"),
    ]
    names = F.array(*map(F.lit, (*tools.TOOLS, "dump_source_line", "nope", "find_callers")))
    return events.select(k.alias("req_id"), F.get(names, (k % 11).cast("int")).alias("tool"), F.get(F.array(*text), (k % 11).cast("int")).alias("arguments"))


@query(rf"""WITH r_v AS (SELECT event_id AS req_id, event_id % 11 AS m, user_id, file, doc_id, event_id % 9 AS ln FROM events JOIN files_v ON doc_id = event_id * 7919 % (SELECT count(*) FROM documents)),
text_v AS (SELECT file, ln, text, trim(text, {V._WS}) AS code FROM lines_v),
body_v AS (SELECT *, (SELECT string_agg(text, chr(10) ORDER BY l.ln) FROM lines_v l WHERE l.file = f.filename AND l.ln BETWEEN f.start_line AND f.end_line) AS body FROM functions_v f),
shown_v AS (SELECT function_name, filename, start_line, end_line, '{{"function_name":' || to_json(function_name)::varchar || ',"filename":' || to_json(filename)::varchar || ',"start_line":' || start_line || ',"end_line":' || end_line || ',"function_body":' || to_json(body)::varchar || '}}' AS shown FROM body_v),
path_v AS (SELECT file, count(*) AS n, '[' || string_agg('{{"event_no":' || ln || ',"type":"' || CASE WHEN ln % 2 = 1 THEN 'call' ELSE 'condition' END || '","location":' || to_json(file || ':' || ln)::varchar || ',"code":' || to_json(code)::varchar || '}}', ',' ORDER BY ln) || ']' AS events FROM text_v GROUP BY 1),
a_v AS (
  SELECT req_id, m, CASE WHEN req_id % 2 = 1 THEN '{{"error":"invalid classification or reason"}}' ELSE '{{"received":["A' || req_id || '"]}}' END AS result FROM r_v WHERE m = 0
  UNION ALL SELECT req_id, m, to_json(coalesce((SELECT string_agg(text, chr(10) ORDER BY l.ln) FROM lines_v l WHERE l.file = r.file AND l.ln BETWEEN r.ln AND r.ln + 2), ''))::varchar FROM r_v r WHERE m = 1
  UNION ALL SELECT req_id, m, to_json(coalesce(code, 'The line number is invalid or out of range for the file.'))::varchar FROM r_v r LEFT JOIN text_v t ON t.file = r.file AND t.ln = r.ln WHERE m = 2
  UNION ALL SELECT req_id, m, coalesce(arg_min(shown, (end_line - start_line, function_name)), '{{"error":"no function at this location"}}') FROM r_v r LEFT JOIN shown_v f ON f.filename = r.file AND r.ln BETWEEN start_line AND end_line WHERE m IN (3, 4) GROUP BY 1, 2
  UNION ALL SELECT req_id, m, CASE WHEN s.fl IS NULL THEN '[]' ELSE '{{"location":' || to_json(s.fl || ':' || s.ln)::varchar || ',"code":' || to_json(coalesce(code, 'The line number is invalid or out of range for the file.'))::varchar || '}}' END
    FROM r_v r LEFT JOIN sites_v s ON callee = 'g' || user_id LEFT JOIN text_v t ON t.file = s.fl AND t.ln = s.ln WHERE m = 5
  UNION ALL SELECT req_id, m, coalesce(shown, '{{"error":"Function body unavailable for ''f0_' || doc_id || 'C1E''. unknown function"}}') FROM r_v r LEFT JOIN shown_v f ON f.function_name = 'f0_' || doc_id || 'C2E' WHERE m = 6
  UNION ALL SELECT req_id, m, CASE WHEN n IS NULL THEN '{{"error":"start code was not found near its line"}}' WHEN n = 1 THEN '[]' ELSE events END FROM r_v r LEFT JOIN path_v p ON p.file = r.file WHERE m = 7
  UNION ALL SELECT req_id, m, CASE m WHEN 8 THEN '{{"error":"invalid tool arguments: line_number is not of type int"}}' WHEN 9 THEN '{{"error":"unknown tool: nope"}}' ELSE '{{"error":"invalid tool arguments: not a JSON object"}}' END FROM r_v WHERE m > 7)
SELECT req_id, {_TOOLS}[(m + 1)::int] AS tool, CASE WHEN m IN (8, 10) THEN 'parse_arguments' WHEN m = 9 THEN 'unknown_tool' ELSE 'batch' END AS context, sha256(result) AS result_sha256,
  CASE WHEN result LIKE '{{"error":%' THEN 'error_dict' WHEN result = '"The line number is invalid or out of range for the file."' THEN 'invalid_line' END AS failure_kind FROM a_v""")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """A call's way from its text to its answer and its record in the failure log."""
    lines = V.source_lines(spark, d)
    place = lambda n: F.concat("file", F.lit(":"), F.lit(n))
    paths = lines.select(place(1).alias("start"), place(2).alias("target"), F.lit(1).alias("path_no"), F.col("ln").alias("event_no"), F.when(F.col("ln") % 2 == 1, "call").otherwise("condition").alias("type"), F.col("file").alias("fl"), "ln")
    facts = tools.Facts(V.source_texts(spark, d).select(F.col("file").alias("path")), lines, V.functions(spark, d), V.with_file(V.call_sites(spark, d), spark, d), paths)
    answered = tools.results(_tool_calls(spark, d), facts)
    return answered.select("req_id", "tool", "context", F.sha2("result", 256).alias("result_sha256"), failures.classify(F.col("result"))["kind"].alias("failure_kind"))


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's folder or file as a stream of all it holds; a pattern, since a stream's plain path must be a folder."""
    return spark.readStream.schema(V.table(spark, d, name).schema).parquet(f"{d}/{name}[.]parquet")


def _finished(stream: DataFrame) -> DataFrame:
    """What the stream puts out when it has read all there is."""
    root = work.folder(stream.sparkSession)
    jobs.run_once(stream, f"{root}/out", f"{root}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT alert_id, category FROM alerts_v WHERE classification IS NULL AND o_orderkey % 3 <> 0")
def stream_intake(spark: SparkSession, d: str) -> DataFrame:
    """Orders as alert documents; conclusions of a third of them were committed before."""
    root = work.folder(spark)
    alert_id = F.sha2(F.col("o_orderkey").cast("string"), 256)
    category = F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("o_orderkey") % 5).cast("int"))
    raw = F.to_json(F.struct(alert_id.alias("alert_id"), category.alias("category"), F.when(F.col("o_orderstatus") != "O", "TP").alias("classification")))
    files = _streamed(spark, d, "orders").select(F.concat(F.lower(category), F.lit("/"), alert_id, F.lit(".json")).alias("file_path"), raw.alias("raw"))
    sinks.write_version(V.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(alert_id.alias("alert_id")), f"{root}/done")
    jobs.start_intake(files, f"{root}/done", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out/alerts").select("alert_id", "category")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, tool, failure_kind, count(*) AS n FROM failures_v GROUP BY 1, 2, 3")
def stream_failures(spark: SparkSession, d: str) -> DataFrame:
    failed = failures.failures(V.tool_responses(_streamed(spark, d, "events"))).withColumn("ts", F.col("ts").cast("timestamp"))
    root, counts = work.folder(spark), jobs.failure_counts(failed)
    jobs.run_updates(counts, f"{root}/out", f"{root}/checkpoint")
    rows = spark.read.schema("start timestamp, tool string, failure_kind string, n long, epoch int").option("basePath", f"{root}/out").parquet(f"{root}/out")
    return jobs.newest(rows, "start", "tool", "failure_kind").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT batch_id, turn, error FROM walk_v WHERE k > 0")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    known = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat("batch_id", F.lit("-A"), i))
    calls = V.conclusion_calls(_streamed(spark, d, "conversations")).withColumn("known", known)
    name, value = jobs.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        return _finished(jobs.ledger(calls)).select("batch_id", F.col("turn").cast("long").alias("turn"), "error")
    finally:
        spark.conf.set(name, before)
