from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from siftwell.sources import versions
from siftwell.streaming import jobs


def write(spark, path, rows, schema, name):
    """One file, so that each micro-batch of the stream reads one."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/{name}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(path)


@pytest.fixture
def rocks(spark):
    name, value = jobs.STATE_STORE
    spark.conf.set(name, value)
    yield
    spark.conf.unset(name)


def call(turn, ids, kind="TP", batch="B"):
    return (batch, turn, 0, ids, kind, "r", ["a", "b", "c"])


def test_ledger_keeps_claims_across_batches(spark, tmp_path, rocks):
    root = str(tmp_path)
    seen = {}
    for k, rows in enumerate([[call(1, ["a", "x"]), call(2, ["a"])], [call(3, ["b", "a"]), call(4, ["b"], "NO"), call(5, ["b", "c"])]]):
        write(spark, f"{root}/in", rows, jobs.CALLS, str(k))
        jobs.run_once(jobs.ledger(stream(spark, f"{root}/in", jobs.CALLS)), f"{root}/out", f"{root}/check")
        seen = {r.turn: r.error for r in spark.read.parquet(f"{root}/out").collect()}
    assert seen == {1: "unknown alert id: x", 2: None, 3: "alert id already classified: a", 4: "invalid classification or reason", 5: None}


def until(seconds, true):
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if true():
            return True
        time.sleep(0.3)
    return False


def test_ledger_forgets_batches_and_tells_of_open_ones(spark, tmp_path, rocks):
    root = str(tmp_path)
    write(spark, f"{root}/in", [call(1, ["a"]), call(1, ["a", "b", "c"], batch="C")], jobs.CALLS, "0")
    rows = jobs.ledger(stream(spark, f"{root}/in", jobs.CALLS), patience=2, running=True)
    query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").start()
    try:
        read = lambda: {(r.batch_id, r.turn): r.error for r in spark.read.schema(rows.schema).parquet(f"{root}/out").collect()}
        assert until(60, lambda: query.lastProgress and os.path.isdir(f"{root}/out") and ("B", None) in read())
        assert read() == {("B", 1): None, ("C", 1): None, ("B", None): "incomplete: b, c"}
        assert until(30, lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
    finally:
        query.stop()


def test_state_ends_with_later_arrivals(spark, tmp_path, rocks):
    """In runs over what is there, the next arrivals tell the time."""
    root = str(tmp_path)
    for k, batch in enumerate("BDE"):
        write(spark, f"{root}/in", [call(1, ["a"], batch=batch)], jobs.CALLS, str(k))
        last = jobs.run_once(jobs.ledger(stream(spark, f"{root}/in", jobs.CALLS), patience=1), f"{root}/out", f"{root}/check")
        time.sleep(1.5)
    rows = {(r.batch_id, r.turn): r.error for r in spark.read.parquet(f"{root}/out").collect()}
    assert rows == {("B", 1): None, ("D", 1): None, ("E", 1): None, ("B", None): "incomplete: b, c", ("D", None): "incomplete: b, c"}
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # of E: its claims and its timer


def test_intake_reads_each_file_once(spark, tmp_path):
    """Whole files; conclusions that come between micro-batches are seen, and a restart repeats nothing."""
    root = str(tmp_path)
    os.makedirs(f"{root}/in/memory_leak")

    def put(name, text):
        with open(f"{root}/{name}", "w") as out:
            out.write(text)
        os.rename(f"{root}/{name}", f"{root}/in/memory_leak/{name}")

    def document(i, classification=None):
        return json.dumps({"alert_id": i, "category": "MEMORY_LEAK", "classification": classification}, indent=2)

    def found(kind="alerts"):
        return sorted((r.file_path.rpartition("/")[2], r.epoch) for r in spark.read.parquet(f"{root}/out/{kind}").collect())

    put("a.json", document("a"))
    put("b.json", document("b", "TP"))
    put("c.json", "{nope")
    query = jobs.start_intake(jobs.alert_files(spark, f"{root}/in"), f"{root}/done", f"{root}/out", f"{root}/check", processingTime="1 second")
    try:
        query.processAllAvailable()
        assert found() == [("a.json", 0)] and found("broken") == [("c.json", 0)]
        versions.update(spark, f"{root}/done", lambda _: spark.createDataFrame([("d",)], "alert_id string"))
        put("d.json", document("d"))
        put("e.json", document("e"))
        query.processAllAvailable()
        assert [n for n, _ in found()] == ["a.json", "e.json"]
    finally:
        query.stop()
    before = found()
    put("f.json", document("f"))
    jobs.start_intake(jobs.alert_files(spark, f"{root}/in", 1), f"{root}/done", f"{root}/out", f"{root}/check").awaitTermination()
    assert set(found()) - set(before) == {("f.json", max(e for _, e in found()))} and set(before) <= set(found())


def test_a_file_written_again_changes_no_count(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"2024-01-01 00:0{i}:00", "B1", i, "t", "", "k", "d", "{}", None) for i in range(5)]
    for k, part in enumerate([rows, rows, [*rows[:2], ("2024-01-01 00:09:00", "B1", 9, "t", "", "k", "d", "{}", None)]]):
        frame = spark.createDataFrame(part, jobs.FAILURE.replace("timestamp timestamp", "timestamp string"))
        frame.coalesce(1).write.json(f"{root}/in/{k}")
        jobs.run_updates(jobs.failure_counts(jobs.failure_log(spark, f"{root}/in")), f"{root}/out", f"{root}/check")
    newest = jobs.newest(spark.read.parquet(f"{root}/out"), "start", "tool", "failure_kind")
    assert [(r.tool, r.n) for r in newest.collect()] == [("t", 6)]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    root, schema = str(tmp_path), "ts timestamp, tool string, failure_kind string"
    rows = [(f"2024-01-01 0{h}:00:0{i}", "t", "k") for i, h in enumerate((0, 0, 1, 3))]
    frame = spark.createDataFrame(rows, "ts string, tool string, failure_kind string").select(F.col("ts").cast("timestamp"), "tool", "failure_kind")
    frame.coalesce(1).write.json(f"{root}/in")
    jobs.run_updates(jobs.failure_counts(stream(spark, f"{root}/in", schema)), f"{root}/new", f"{root}/check2")
    late = [("2024-01-01 03:30:00", "t", "k")]
    spark.createDataFrame(late, "ts string, tool string, failure_kind string").select(F.col("ts").cast("timestamp"), "tool", "failure_kind").coalesce(1).write.mode("append").json(f"{root}/in2")
    jobs.run_updates(jobs.failure_counts(stream(spark, f"{root}/in*", schema)), f"{root}/new", f"{root}/check2")
    newest = jobs.newest(spark.read.parquet(f"{root}/new"), "start", "tool", "failure_kind")
    assert sorted((str(r.start)[11:13], r.n) for r in newest.collect()) == [("00", 2), ("01", 1), ("03", 2)]
    jobs.run_once(jobs.failure_counts(stream(spark, f"{root}/in", schema)), f"{root}/out", f"{root}/check")
    assert sorted((str(r.start), r.n) for r in spark.read.parquet(f"{root}/out").collect()) == [("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1)]
