"""Sources: alert documents, rule repositories, source files, tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_edit import is_object
from ..schemas import ALERT, CATEGORIES, RULE
from . import tree

RULE_SCHEMA = "semantic-rules/v1"


def read_alerts(spark: SparkSession, root: str, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """(file_path, raw) of the JSON files below root/<category>; categories without a folder are skipped."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [f"{root}/{c.lower()}" for c in categories if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{c.lower()}"))]
    if not there:
        return spark.createDataFrame([], "file_path string, raw string")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(there, wholetext=True)
    return rows.select(decoded_path(F.col("_metadata.file_path")).alias("file_path"), F.col("value").alias("raw"))


def decoded_path(uri: Column) -> Column:
    """The path of a file URI."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:(//)?", "")


def parsed_alerts(files: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(alerts with typed columns, file_path and raw; files that aren't one JSON object). If strict, reading the alerts raises where a file isn't."""
    ok = is_object(F.col("raw"))
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), "file_path")).cast("boolean"))
    rows = files.withColumn("_ok", ok)
    good = rows.where("_ok").select("file_path", "raw", F.from_json("raw", ALERT).alias("a")).select("file_path", "raw", "a.*")
    return good, rows.where("not _ok").select("file_path", "raw")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules with idx from a repository file; none if there is no file. A wrong envelope raises when rows are read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fields = "idx long, " + RULE.removeprefix("STRUCT<").removesuffix(">")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], fields)
    return rules_of(spark.read.text(path, wholetext=True).select("value"))


def rules_of(texts: DataFrame) -> DataFrame:
    """Rules with idx from repository texts (value)."""
    data = texts.select(F.from_json("value", f"schema STRING, rules ARRAY<{RULE}>").alias("d"))
    right = (F.col("d.schema") == RULE_SCHEMA) & F.col("d.rules").isNotNull()
    checked = F.when(F.coalesce(right, F.lit(False)), F.col("d.rules")).otherwise(F.raise_error(F.lit(f"expected {RULE_SCHEMA} with rules[]")))
    return data.select(F.posexplode(checked).alias("idx", "r")).select(F.col("idx").cast("long").alias("idx"), "r.*")


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file below root, relative to it, empty ones too; tasks list the folders (`tree.py`), and contents aren't read.

    In a store that only Spark's readers can open, Spark's file index lists them.
    """
    found = tree.listed(spark, root)
    if found is not None:
        return found
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(decoded_path(F.col("path")).alias("path"))
    return rows.select(F.substring_index("path", f"{root.rstrip('/')}/", -1).alias("path"))


def lines_of(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, ln, text): lines from 1; what follows a final newline is no line."""
    parts = F.split(F.col(text), "\n", -1)
    rows = texts.where(F.col(text).isNotNull()).select(F.col(file).alias("file"), F.size(parts).alias("_n"), F.posexplode(parts).alias("_pos", "text"))
    return rows.where("text <> '' or _pos < _n - 1").select("file", (F.col("_pos") + 1).alias("ln"), "text")


def source_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file, ln, text) of all files below root, which tasks list and read."""
    found = tree.listed(spark, root, contents=True)
    if found is not None:
        return lines_of(found.select(F.col("path").alias("file"), "text"))
    rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    return lines_of(rows.select(F.substring_index(decoded_path(F.col("_metadata.file_path")), f"{root.rstrip('/')}/", -1).alias("file"), F.col("value").alias("text")))


def tags_of(lines: DataFrame) -> DataFrame:
    """(name, location) of tag lines (value): the first `line:N` of the extension fields, else the number before `;"` in the address."""
    f = F.split("value", "\t", -1)
    rows = lines.where(~F.col("value").startswith("!_")).select(f.alias("f")).where("size(f) >= 3")
    named = F.try_element_at(F.filter(F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))), lambda x: x.rlike("^line:[0-9]+$")), F.lit(1))
    line = F.coalesce(F.substring(named, 6, 1 << 30), F.nullif(F.regexp_extract(F.col("f")[2], r'^([0-9]+);"', 1), F.lit("")))
    return rows.select(F.col("f")[0].alias("name"), F.concat(F.col("f")[1], F.lit(":"), line).alias("location")).where("location is not null")


def after_marker(lines: DataFrame, marker: str = "#####") -> DataFrame:
    """lines (file, ln, text) below the last one that starts with the marker; all of a file without one."""
    last = lines.groupBy("file").agg(F.coalesce(F.max(F.when(F.col("text").startswith(marker), F.col("ln"))), F.lit(0)).alias("_last"))
    return lines.join(last, "file").where("ln > _last").drop("_last")
