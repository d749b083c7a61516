"""Bounded batches of pending alerts that share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.json_edit import edited, json_string
from ..work import saved

SEPARATOR = "\n\n--- NEXT ALERT ---\n\n"


def numbered(rows: DataFrame, key: str, name: str, before: str) -> DataFrame:
    """rows (one per key) with a 1-based number `name` and the sum `before` of `n` over smaller keys.

    Rows are range-partitioned by key; sums inside a partition need no other one, and each
    partition's start comes from one small row per partition. No window spans all rows. The
    partitioned rows are written once, since range bounds come from a sample and may differ if
    they are drawn again.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    within = W.partitionBy("_part").orderBy(key)
    placed = saved(placed.select("*", F.row_number().over(within).alias("_rank"), (F.sum("n").over(within) - F.col("n")).alias("_before")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_n"), F.min(key).alias("_least"))
    order = W.orderBy("_least")  # one row per partition
    starts = sizes.select("_part", (F.sum("_rows").over(order) - F.col("_rows")).alias("_r0"), (F.sum("_n").over(order) - F.col("_n")).alias("_n0"))
    return placed.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_rank") + F.col("_r0")).alias(name), (F.col("_before") + F.col("_n0")).alias(before))


def make_batches(alerts: DataFrame, size: int = 8, order: str = "file_path") -> DataFrame:
    """(alert_id, batch_no, batch_id, pos, short_id): alerts by batch_key, in `order`, in chunks of `size`; batches numbered by key order.

    Alerts are range-partitioned by key and order, so that one key for all rows spreads over all
    partitions; a key's places go on from partition to partition by one small row for each.
    """
    size = max(size, 1)
    rows = alerts.select("alert_id", "batch_key", F.col(order).alias("_order"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = saved(rows.repartitionByRange(parts, "batch_key", "_order", "alert_id").withColumn("_part", F.spark_partition_id()))
    within = W.partitionBy("_part", "batch_key").orderBy("_order", "alert_id")
    ranked = placed.select("alert_id", "batch_key", "_part", (F.row_number().over(within) - 1).alias("_rn"))
    runs = placed.groupBy("batch_key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_order", "alert_id")).alias("_least"))
    before = F.sum("_n").over(W.partitionBy("batch_key").orderBy("_least")) - F.col("_n")  # a row per partition
    keys = numbered(runs.groupBy("batch_key").agg(F.ceil(F.sum("_n") / size).alias("n")), "batch_key", "_key_no", "_before").select("batch_key", "_before")
    starts = runs.select("batch_key", "_part", before.alias("_start")).join(keys, "batch_key")
    rows = ranked.join(starts, ["batch_key", "_part"]).withColumn("_rn", F.col("_rn") + F.col("_start"))
    rows = rows.select("alert_id", (F.col("_before") + F.floor(F.col("_rn") / size) + 1).alias("batch_no"), (F.col("_rn") % size + 1).cast("int").alias("pos"))
    batch_id = F.concat(F.lit("B"), F.when(F.col("batch_no") < 10000, F.lpad(F.col("batch_no").cast("string"), 4, "0")).otherwise(F.col("batch_no").cast("string")))
    rows = rows.withColumn("batch_id", batch_id)
    return rows.withColumn("short_id", F.concat("batch_id", F.lit("-A"), F.when(F.col("pos") < 100, F.lpad(F.col("pos").cast("string"), 2, "0")).otherwise(F.col("pos").cast("string"))))


def prompts(members: DataFrame, alerts: DataFrame) -> DataFrame:
    """(batch_no, batch_id, n_alerts, prompt): a batch's alerts in order. `alerts` has alert_id, hint and raw, its JSON, of which only the id is replaced by the short one."""
    rows = members.join(alerts.select("alert_id", "hint", "raw"), "alert_id")
    body = edited(F.col("raw"), {"alert_id": json_string(F.col("short_id"))})
    rows = rows.withColumn("prompt", F.concat(F.lit("Classify this static-analysis alert. "), "hint", F.lit("\n\n"), body))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "prompt"))), lambda x: x["prompt"])
    head = F.concat(F.lit("Batch "), "batch_id", F.lit("\n\n"))
    return rows.groupBy("batch_no", "batch_id").agg(F.count(F.lit(1)).alias("n_alerts"), F.array_join(parts, SEPARATOR).alias("prompt")).withColumn("prompt", F.concat(head, "prompt"))
