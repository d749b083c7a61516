"""Semantic rules: from candidates to a reviewed repository, as set-based jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..schemas import MATCHES, RULE_KINDS, RULE_STATES

#: Who proposes rules unless the caller says otherwise.
PROPOSER = "triage"
#: The optional fields of a rule by how they are written.
TEXT_FIELDS = ("effect", "field_path", "pair", "reason")
NUMBER_FIELDS = ("confidence", "length_arg", "source_arg", "target_arg")
ARGUMENT_FIELDS = ("target_arg", "source_arg", "length_arg")
RULE_COLUMNS = ("id", "status", "kind", "function", "match", "source_alert_id", "proposed_by", "effect", "target_arg", "source_arg", "length_arg", "field_path", "pair", "confidence", "reason")


def _quoted(text: Column) -> Column:
    """Text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with sorted keys, ", " and ": " between its parts; null fields are left out. Values are JSON already."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}": '), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def rule_id(kind: Column, function: Column, match: Column) -> Column:
    """The id that depends on all fields as they were proposed. Numbers are kept as raw text."""
    fields = {"kind": _quoted(kind), "function": _quoted(function), "match": _quoted(match)}
    fields |= {f: F.when(F.col(f) != "", _quoted(F.col(f))) for f in TEXT_FIELDS}
    fields |= {f: F.nullif(F.col(f), F.lit("")) for f in NUMBER_FIELDS}
    return F.concat(F.lit("proposed-"), kind, F.lit("-"), F.substring(F.sha2(canonical_json(fields), 256), 1, 16))


def to_rules(candidates: DataFrame, proposer: str = PROPOSER) -> DataFrame:
    """Candidates (flat fields, source_alert_id, and columns that order them) as proposed rules; unusable ones are left out, numbers that aren't whole-number arguments become null."""
    usable = F.col("kind").isin(list(RULE_KINDS)) & (stripped(F.col("function")) != "")
    match = F.when(F.col("match").isin(list(MATCHES)), F.col("match")).otherwise("exact")
    rows = candidates.where(usable).withColumns({"match": match}).withColumn("id", rule_id(F.col("kind"), F.col("function"), F.col("match")))
    whole = {f: F.col(f).try_cast("double").try_cast("int") for f in ARGUMENT_FIELDS}
    text = {f: F.nullif(F.col(f), F.lit("")) for f in TEXT_FIELDS}
    return rows.withColumns(whole | text | {"function": stripped(F.col("function")), "confidence": F.col("confidence").try_cast("double"), "status": F.lit("proposed"), "proposed_by": F.lit(proposer)})


def first_of_each(rules: DataFrame, *order: str) -> DataFrame:
    """The first rule of each id, by partial aggregation."""
    columns = [c for c in RULE_COLUMNS if c != "id"]
    best = rules.groupBy("id").agg(F.min(F.struct(*order, *columns)).alias("r"))
    return best.select("id", *(F.col(f"r.{c}").alias(c) for c in (*columns, *order)))


def new_rules(candidates: DataFrame, repository: DataFrame, *order: str) -> DataFrame:
    """Rules from candidates that the repository doesn't have yet."""
    return first_of_each(to_rules(candidates), *order).join(repository.select("id").where("id is not null").distinct(), "id", "left_anti")


def appended(repository: DataFrame, candidates: DataFrame, *order: str) -> DataFrame:
    """The old rules followed by the new ones."""
    new = new_rules(candidates, repository, *order)
    return repository.select(*RULE_COLUMNS).unionByName(new.select(*RULE_COLUMNS))


def problems(rules: DataFrame) -> DataFrame:
    """(idx, error) of rules with idx, in the order in which they are checked. A null rule is `not an object`."""
    first = rules.where("id is not null").groupBy("id").agg(F.min("idx").alias("_first"))
    rows = rules.join(first, "id", "left")
    bad_id = F.col("id").isNull() | (F.col("id") == "") | (F.col("idx") > F.col("_first"))
    prefix = F.concat(F.lit("rules["), "idx", F.lit("]: "))
    checks = [  # fixed values: the texts of the errors
        (~F.coalesce(F.col("kind").isin(list(RULE_KINDS)), F.lit(False)), "unsupported kind"),
        (bad_id, "missing or duplicate id"),
        (F.coalesce(F.col("function"), F.lit("")) == "", "function is required"),
        (~F.coalesce("match", F.lit("exact")).isin(list(MATCHES)), "match must be exact or substring"),
        (~F.coalesce("status", F.lit("proposed")).isin(list(RULE_STATES)), "invalid status"),
    ]
    empty = F.coalesce(*(F.col(c).cast("string") for c in RULE_COLUMNS)).isNull()
    errors = F.when(empty, F.array(F.lit("not an object"))).otherwise(F.array_compact(F.array(*(F.when(c, text) for c, text in checks))))
    return rows.select("idx", F.posexplode(errors).alias("n", "error")).select("idx", "n", F.concat(prefix, "error").alias("error"))


def reviewed(rules: DataFrame, approve: DataFrame, reject: DataFrame) -> DataFrame:
    """rules with the status that the lists of ids give; rejection wins, unknown ids are ignored."""
    yes = approve.select(F.col("id")).distinct().withColumn("_yes", F.lit(True))
    no = reject.select(F.col("id")).distinct().withColumn("_no", F.lit(True))
    rows = rules.join(yes, "id", "left").join(no, "id", "left")
    return rows.withColumn("status", F.when(F.col("_no"), "rejected").when(F.col("_yes"), "approved").otherwise(F.col("status"))).drop("_yes", "_no").select(*rules.columns)


def approved(rules: DataFrame) -> DataFrame:
    return rules.where("status = 'approved'")
