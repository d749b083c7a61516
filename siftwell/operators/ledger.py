"""Conclusions of a batch: calls judged in order, coverage, write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.json_edit import edited, json_string
from ..functions.text import stripped
from ..schemas import CLASSIFICATIONS


def conclusion_error(ids: Column, classification: Column, reason: Column) -> Column:
    """Why a call can't be a conclusion by itself, or null."""
    empty = ids.isNull() | (F.size(ids) == 0) | F.exists(ids, lambda x: x.isNull() | (x == ""))
    return F.when(empty, "alert_ids must be a non-empty string array").when(~F.coalesce(classification.isin(list(CLASSIFICATIONS)), F.lit(False)) | reason.isNull(), "invalid classification or reason")


def is_for(ids: Column, alert_id: Column) -> Column:
    """Whether the call is for exactly the one alert."""
    return F.coalesce(ids == F.array(alert_id), F.lit(False))


def judged(calls: DataFrame, members: DataFrame) -> DataFrame:
    """calls (batch_id, turn, call_idx, alert_ids, classification, reason) with `error`, null where accepted.

    A call is taken or refused as a whole, and one that is refused claims nothing, so calls are
    folded in order. A batch holds at most a few dozen calls by construction.
    """
    known = members.groupBy("batch_id").agg(F.collect_set("short_id").alias("_known"))
    call = F.struct("turn", "call_idx", "alert_ids", conclusion_error(F.col("alert_ids"), F.col("classification"), F.col("reason")).alias("shape"))
    rows = calls.groupBy("batch_id").agg(F.array_sort(F.collect_list(call)).alias("_calls")).join(known, "batch_id", "left")
    start = F.struct(F.array().cast("array<string>").alias("claimed"), F.array().cast("array<struct<turn: int, call_idx: int, error: string>>").alias("out"))

    def step(state: Column, c: Column) -> Column:
        ids = F.when(c["shape"].isNull(), c["alert_ids"]).otherwise(F.array().cast("array<string>"))
        unknown = lambda x: ~F.array_contains(F.coalesce("_known", F.array().cast("array<string>")), x)
        bad = F.get(F.filter(ids, lambda x, i: unknown(x) | F.array_contains(state["claimed"], x) | (F.array_position(ids, x) <= i)), F.lit(0))
        why = F.when(unknown(bad), F.concat(F.lit("unknown alert id: "), bad)).when(bad.isNotNull(), F.concat(F.lit("alert id already classified: "), bad))
        error = F.coalesce(c["shape"], why)
        claimed = F.when(error.isNull(), F.concat(state["claimed"], ids)).otherwise(state["claimed"])
        return F.struct(claimed.alias("claimed"), F.array_append(state["out"], F.struct(c["turn"].cast("int").alias("turn"), c["call_idx"].cast("int").alias("call_idx"), error.alias("error"))).alias("out"))

    folded = rows.select("batch_id", F.explode(F.aggregate("_calls", start, step)["out"]).alias("o")).select("batch_id", "o.*")
    return calls.join(folded, ["batch_id", "turn", "call_idx"])


def conclusions(judged_calls: DataFrame) -> DataFrame:
    """(batch_id, short_id, classification, reason, semantic_candidates) of accepted calls."""
    more = [c for c in ("semantic_candidates",) if c in judged_calls.columns]
    return judged_calls.where("error is null").select("batch_id", F.explode("alert_ids").alias("short_id"), "classification", "reason", *more)


def canonical(results: DataFrame, members: DataFrame) -> DataFrame:
    """Results by alert_id."""
    return results.join(members.select("batch_id", "short_id", "alert_id"), ["batch_id", "short_id"])


def missing(members: DataFrame, results: DataFrame) -> DataFrame:
    """Members without a result."""
    return members.join(results.select("batch_id", "short_id"), ["batch_id", "short_id"], "left_anti")


def coverage(members: DataFrame, results: DataFrame) -> DataFrame:
    """(batch_id, n_alerts, n_concluded, complete)."""
    done = results.select("batch_id", "short_id", F.lit(1).alias("_done")).distinct()
    rows = members.select("batch_id", "short_id").join(done, ["batch_id", "short_id"], "left")
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_alerts"), F.count("_done").alias("n_concluded")).withColumn("complete", F.col("n_alerts") == F.col("n_concluded"))


def of_complete_batches(results: DataFrame, covered: DataFrame) -> DataFrame:
    """Results of batches that are complete; those of others are dropped."""
    return results.join(covered.where("complete").select("batch_id"), "batch_id", "left_semi")


def write_back(alerts: DataFrame, results: DataFrame) -> DataFrame:
    """alerts (alert_id, raw: JSON text) with classification and reason set in raw where there is a result; every other byte stays."""
    valid = results.where(F.col("classification").isin(list(CLASSIFICATIONS))).select("alert_id", F.col("classification").alias("_class"), stripped(F.col("reason")).alias("_reason"))
    rows = alerts.join(valid, "alert_id", "left")
    raw = edited(F.col("raw"), {"classification": json_string(F.col("_class")), "reason": json_string(F.col("_reason"))})
    return rows.select("alert_id", raw.alias("raw"), F.col("_class").isNotNull().alias("written"))


def observed_totals(written: DataFrame) -> tuple[DataFrame, Observation]:
    """written (see write_back) and an observation that has n_pending and n_concluded once its rows were written anywhere, without another scan."""
    totals = Observation()
    return written.observe(totals, F.count(F.lit(1)).alias("n_pending"), F.count(F.when(F.col("written"), 1)).alias("n_concluded")), totals


def run_totals(spark: SparkSession, totals: Observation, n_rules: int) -> DataFrame:
    """One row of a finished run: pending, concluded, unfinished, rules appended, exit status."""
    pending, concluded = totals.get["n_pending"], totals.get["n_concluded"]
    row = (pending, concluded, pending - concluded, n_rules, int(pending != concluded))
    return spark.createDataFrame([row], "n_pending long, n_concluded long, n_unfinished long, n_rules long, status int")


def turn_phase(turns: DataFrame, max_turns: int = 32, reserve: int | None = None) -> DataFrame:
    """turns (batch_id, turn, n_calls, n_alerts) with concluding and forced.

    The last turns of a batch are reserved for concluding; a turn without calls forces the next one.
    A batch's turns are bounded by max_turns.
    """
    least = F.greatest(F.lit(reserve or 0), F.col("n_alerts") + 2, F.lit(10 if reserve is None else 0))
    kept = F.least(F.lit(max_turns), least)
    phase = F.col("turn") > F.lit(max_turns) - kept
    before = F.lag(F.col("n_calls") == 0).over(W.partitionBy("batch_id").orderBy("turn"))
    return turns.withColumn("concluding", phase).withColumn("forced", phase | F.coalesce(before, F.lit(False)))
