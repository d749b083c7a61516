"""Structured Streaming jobs: alert intake, failure roll-up, conclusion ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import alerts as A
from ..schemas import CLASSIFICATIONS
from ..sources import documents, versions

CALLS = "batch_id string, turn int, call_idx int, alert_ids array<string>, classification string, reason string, known array<string>"


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; output as Parquet."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; each micro-batch's changed rows go to a folder of its own, written anew if the batch is repeated."""

    def put(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows that run_updates wrote, the latest of each key."""
    rest = [c for c in rows.columns if c not in keys and c != "epoch"]
    return rows.groupBy(*keys).agg(F.max(F.struct("epoch", *rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def alert_files(spark: SparkSession, root: str, per_trigger: int | None = None) -> DataFrame:
    """(file_path, raw): a stream of the JSON files that appear below root, each as a whole."""
    reader = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.text(root, wholetext=True).select(documents.decoded_path(F.col("_metadata.file_path")).alias("file_path"), F.col("value").alias("raw"))


def intake(alerts: DataFrame, concluded: DataFrame | None) -> DataFrame:
    """Alerts that are neither classified nor concluded."""
    rows = A.pending(alerts)
    return rows if concluded is None else rows.join(concluded.select("alert_id").distinct(), "alert_id", "left_anti")


def start_intake(files: DataFrame, conclusions: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Take in streamed alert documents (file_path, raw): those still to do go to out/alerts, those that aren't JSON objects to out/broken.

    Each micro-batch reads the conclusions' latest version below their root as it is then. A batch's
    rows go to a folder of its own, which a repeated batch writes anew; the checkpoint says which
    files were read, so a restart repeats nothing.
    """

    def put(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        done = versions.read(spark, conclusions) if versions.head(spark, conclusions) else None
        good, broken = documents.parsed_alerts(rows)
        intake(good, done).write.mode("overwrite").parquet(f"{out}/alerts/epoch={epoch}")
        broken.write.mode("overwrite").parquet(f"{out}/broken/epoch={epoch}")
        rows.unpersist()

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: A record of the failure log, one JSON object a line.
FAILURE = "timestamp timestamp, batch_id string, turn int, tool string, context string, failure_kind string, detail string, arguments string, response string"


def failure_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the records of a failure log, with `ts`; lines that aren't records have nulls."""
    return spark.readStream.schema(FAILURE).option("recursiveFileLookup", True).json(path).withColumnRenamed("timestamp", "ts")


def failure_counts(failures: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts by window, tool and kind, each record once: one that is alike in all columns, as in a file that is written again, is dropped for as long as it may come late.

    In append mode a window is put out once the watermark has passed it, in update mode whenever it changes.
    """
    record = F.sha2(F.to_json(F.struct(*failures.columns), {"ignoreNullFields": "false"}), 256)
    once = failures.withColumn("_record", record).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["_record"])
    return once.groupBy(F.window("ts", window), "tool", "failure_kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "tool", "failure_kind", "n")


def judge(calls: pd.DataFrame, claimed: set[str], done: bool) -> list[tuple]:
    """(turn, call_idx, error) of a batch's calls in order; what they claim is added to `claimed`."""
    out = []
    for c in calls.sort_values(["turn", "call_idx"]).itertuples():
        ids = [] if c.alert_ids is None else list(c.alert_ids)
        if not ids or any(not i for i in ids):
            error = "alert_ids must be a non-empty string array"
        elif c.classification not in CLASSIFICATIONS or c.reason is None:
            error = "invalid classification or reason"
        else:
            error, new = None, set()
            for i in ids:
                if i not in c.known:
                    error = f"unknown alert id: {i}"
                elif done or i in claimed or i in new:
                    error = f"alert id already classified: {i}"
                if error:
                    break
                new.add(i)
            if not error:
                claimed |= new
        out.append((c.turn, c.call_idx, error))
    return out


class Ledger(StatefulProcessor):
    """Per batch what was claimed; a batch that had no call for `patience` seconds is forgotten, with a row of its own if it was incomplete."""

    def __init__(self, patience: float, running: bool) -> None:
        self.patience, self.running = int(patience * 1000), running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claims", "claimed array<string>, known array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows))
        claimed, known = map(set, self.state.get()) if self.state.exists() else (set(), set())
        known |= {i for ids in calls["known"] if ids is not None for i in ids}
        out = judge(calls, claimed, False)
        self.state.update((sorted(claimed), sorted(known)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs() if self.running else int(calls["seen"].max().timestamp() * 1000)
        self.handle.registerTimer(now + self.patience)
        yield pd.DataFrame([(key[0], *row) for row in out], columns=JUDGED)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        claimed, known = map(set, self.state.get()) if self.state.exists() else (set(), set())
        self.state.clear()
        open_ids = sorted(known - claimed)
        rows = [(key[0], None, None, f"incomplete: {', '.join(open_ids)}")] if open_ids else []
        yield pd.DataFrame(rows, columns=JUDGED).astype({"turn": "Int32", "call_idx": "Int32"})

    def close(self) -> None:
        pass


JUDGED = ["batch_id", "turn", "call_idx", "error"]
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ledger(calls: DataFrame, patience: float = 3600, running: bool = False) -> DataFrame:
    """Streamed calls (see CALLS; `known` are the batch's short ids) with their error, null where accepted.

    Calls that arrive late across micro-batches are judged in the order of arrival. The state of a
    batch ends `patience` seconds after its last call; if ids were left open then, a row without turn
    names them. Calls that come later still begin the batch anew. In a query that is always running
    time is the clock's; otherwise it is the arrival of calls, so that a run over what is there ends.
    Needs the state store that STATE_STORE names, set before the stream starts.
    """
    mode = "processingTime" if running else "eventTime"
    if not running:
        calls = calls.withColumn("seen", F.current_timestamp()).withWatermark("seen", "0 seconds")
    return calls.groupBy("batch_id").transformWithStateInPandas(Ledger(patience, running), "batch_id string, turn int, call_idx int, error string", "Append", mode)
