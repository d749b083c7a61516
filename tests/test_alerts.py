"""Hand-made alerts: locations, keys, batches, write-back."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftwell.operators import alerts as A
from siftwell.operators import batching, ledger
from siftwell.sources import documents, sinks


def node(role, file="a.c", line=1, column=None):
    return {"role": role, "location": {"file": file, "line": line, "column": column} if file else None}


def alert(n, category, **more):
    base = {"alert_id": f"id{n}", "category": category, "access": {"kind": "read", "location": {"file": "b.c", "line": 7}}, "evidence": {"memory_object": {"type": "", "descriptor": "d"}}}
    return base | more


def load(spark, tmp_path, alerts):
    for a in alerts:
        folder = tmp_path / a["category"].lower()
        folder.mkdir(exist_ok=True)
        (folder / f"{a['alert_id']} x.json").write_text(json.dumps(a, indent=1))
    return documents.read_alerts(spark, str(tmp_path))


def test_source_reads_and_quarantines(spark, tmp_path):
    files = load(spark, tmp_path, [alert(1, "MEMORY_LEAK", path=[node("use")]), alert(2, "BUFFER_OVERFLOW")])
    (tmp_path / "memory_leak" / "broken.json").write_text("{nope")
    files = documents.read_alerts(spark, str(tmp_path))
    good, bad = documents.parsed_alerts(files)
    assert sorted(r.alert_id for r in good.collect()) == ["id1", "id2"]
    assert [r.file_path.rsplit("/", 1)[1] for r in bad.collect()] == ["broken.json"]
    assert any(r.file_path.endswith("id1 x.json") for r in good.collect())
    assert documents.read_alerts(spark, str(tmp_path), ["DOUBLE_FREE"]).count() == 0


def test_primary_location_prefers_role_then_last(spark, tmp_path):
    alerts = [
        alert(1, "MEMORY_LEAK", path=[node("free", line=3), node("use", line=1), node("use", line=2), node("use", file=None)]),
        alert(2, "DOUBLE_FREE", path=None, allocation=node("allocation", line=9, column=4), paths=[{"path": None}, {"path": [node("object_origin", line=5)]}]),
        alert(3, "USE_AFTER_FREE", path=[node("other")]),
        alert(4, "BUFFER_OVERFLOW"),
        alert(5, "UNKNOWN", path=[node("use")]),
    ]
    load(spark, tmp_path, alerts)
    files = documents.read_alerts(spark, str(tmp_path), [*(a["category"] for a in alerts)])
    rows = {r.alert_id: r for r in A.keyed(documents.parsed_alerts(files)[0]).collect()}
    assert rows["id1"].source_location == "a.c:2" and rows["id1"].loc.cl == 0
    assert rows["id2"].source_location == "a.c:9" and rows["id2"].loc.cl == 4
    assert rows["id3"].loc is None and rows["id5"].hint is None
    assert rows["id4"].source_location == "b.c:7"
    good, bad = A.quarantine(A.keyed(documents.parsed_alerts(files)[0]))
    assert {r.alert_id: r.problem for r in bad.collect()} == {"id3": "no primary location", "id5": "unknown category"}
    assert good.count() == 3


def test_batch_keys(spark, tmp_path):
    alerts = [
        alert(1, "USE_AFTER_FREE", path=[node("use", line=1), node("free", line=10), node("free", line=2)]),
        alert(2, "UNINIT_USE", path=[node("use")]),
        alert(3, "UNINIT_USE", path=[node("use")], evidence={"memory_object": {"type": "heap", "descriptor": "d"}}),
        alert(4, "USE_AFTER_FREE", path=[node("use")]),
    ]
    rows = {r.alert_id: r.batch_key for r in A.keyed(documents.parsed_alerts(load(spark, tmp_path, alerts))[0]).collect()}
    assert rows == {"id1": "('USE_AFTER_FREE', 'a.c', 10)", "id2": "('UNINIT_USE', 'd')", "id3": "('UNINIT_USE', 'heap')", "id4": None}


def test_batches_are_chunked_and_ordered_by_key_text(spark):
    rows = [(f"a{i:02d}", "('U', 'f', 9)" if i < 3 else "('U', 'f', 10)", f"p{i:02d}") for i in range(20)]
    got = batching.make_batches(spark.createDataFrame(rows, "alert_id string, batch_key string, file_path string")).collect()
    by = {r.alert_id: (r.batch_no, r.pos, r.short_id) for r in got}
    assert by["a03"] == (1, 1, "B0001-A01") and by["a10"] == (1, 8, "B0001-A08") and by["a11"] == (2, 1, "B0002-A01") and by["a00"] == (4, 1, "B0004-A01")
    assert len(by) == 20 and max(p for _, p, _ in by.values()) <= 8


def test_batch_size_has_a_floor(spark):
    frame = spark.createDataFrame([("a", "k", "1"), ("b", "k", "2")], "alert_id string, batch_key string, file_path string")
    assert [r.batch_no for r in batching.make_batches(frame, 0).orderBy("alert_id").collect()] == [1, 2]
    assert batching.make_batches(frame.limit(0)).count() == 0


def calls(spark, *rows):
    return spark.createDataFrame([("B", t, 0, ids, c, "r") for t, ids, c in rows], "batch_id string, turn int, call_idx int, alert_ids array<string>, classification string, reason string")


def test_refused_calls_claim_nothing(spark):
    members = spark.createDataFrame([("B", x, x.upper()) for x in "abc"], "batch_id string, short_id string, alert_id string")
    rows = calls(spark, (1, ["a", "x"], "TP"), (2, ["a"], "TP"), (3, ["b", "b"], "FP"), (4, ["b", "a"], "FP"), (5, [], "FP"), (6, ["b"], "NO"), (7, ["b"], "FP"))
    judged = ledger.judged(rows, members)
    errors = {r.turn: r.error for r in judged.collect()}
    assert errors == {1: "unknown alert id: x", 2: None, 3: "alert id already classified: b", 4: "alert id already classified: a", 5: "alert_ids must be a non-empty string array", 6: "invalid classification or reason", 7: None}
    results = ledger.conclusions(judged)
    assert [r.short_id for r in ledger.missing(members, results).collect()] == ["c"]
    assert ledger.of_complete_batches(results, ledger.coverage(members, results)).count() == 0


def test_write_back_keeps_other_fields(spark, tmp_path):
    alerts = spark.createDataFrame([("a", '{"z":1,"classification":null,"deep":{"k":[1,{"q":"ü"}]}}'), ("b", '{"z":2}')], "alert_id string, raw string")
    results = spark.createDataFrame([("a", "FP", "\n why \t"), ("b", "WRONG", "x")], "alert_id string, classification string, reason string")
    rows = {r.alert_id: r for r in ledger.write_back(alerts, results).collect()}
    assert json.loads(rows["a"].raw) == {"z": 1, "deep": {"k": [1, {"q": "ü"}]}, "classification": "FP", "reason": "why"}
    assert rows["b"].raw == '{"z":2}' and not rows["b"].written
    root = str(tmp_path / "out")
    sinks.write_version(alerts, root)
    sinks.write_version(ledger.write_back(alerts, results), root)
    assert "written" in sinks.read_version(spark, root).columns


def test_documents_can_be_read_again(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([("memory_leak/a/é 1.json", '{"alert_id":"1","category":"MEMORY_LEAK"}'), ("double_free/2.json", '{"alert_id":"2","category":"DOUBLE_FREE"}'), (None, "{}")], "file_path string, raw string")
    for _ in range(2):
        version = sinks.write_documents(rows.repartition(3), root)
        assert sinks.latest(spark, root) == version
    back = documents.parsed_alerts(documents.read_alerts(spark, version), strict=True)[0].collect()
    assert {(r.file_path.removeprefix(f"{version}/"), r.alert_id) for r in back} == {("memory_leak/a/é 1.json", "1"), ("double_free/2.json", "2")}


def test_strict_loading_raises(spark):
    files = spark.createDataFrame([("a.json", "{}"), ("b.json", "{nope")], "file_path string, raw string")
    assert documents.parsed_alerts(files)[0].count() == 1
    with pytest.raises(Exception, match="not JSON: b.json"):
        documents.parsed_alerts(files, strict=True)[0].collect()


def test_one_key_for_all_alerts(spark):
    rows = spark.range(1000).select(F.concat(F.lit("a"), F.lpad("id", 4, "0")).alias("alert_id"), F.lit("k").alias("batch_key"), F.concat(F.lit("p"), F.lpad((F.col("id") * 7 % 1000).cast("string"), 4, "0")).alias("file_path"))
    got = {r.alert_id: (r.batch_no, r.pos) for r in batching.make_batches(rows.repartition(5)).collect()}
    assert got == {f"a{i:04d}": (i * 7 % 1000 // 8 + 1, i * 7 % 1000 % 8 + 1) for i in range(1000)}


def test_numbers_too_large_for_a_line(spark, tmp_path):
    load(spark, tmp_path, [alert(1, "MEMORY_LEAK", path=[node("use", line=1 << 40, column=1 << 41)])])
    (row,) = A.keyed(documents.parsed_alerts(documents.read_alerts(spark, str(tmp_path)))[0]).collect()
    assert row["loc"].fl == "a.c" and row["loc"].ln is None and row["loc"].cl is None and row.source_location is None


def test_lines_convert_like_integers(spark, tmp_path):
    values = [("12", 12), (" 7\n", 7), ("1_000", 1000), (12.9, 12), (True, 1), ("x", None), ("1__0", None), (None, None), (99999999999, None), ("", None), ([3], None)]
    load(spark, tmp_path, [alert(i, "MEMORY_LEAK", path=[node("use", line=v)]) for i, (v, _) in enumerate(values)])
    rows = A.keyed(documents.parsed_alerts(documents.read_alerts(spark, str(tmp_path)))[0])
    good, bad = A.quarantine(rows)
    assert {r.alert_id: r["loc"].ln for r in good.collect()} == {alert(i, "MEMORY_LEAK")["alert_id"]: v for i, (_, v) in enumerate(values) if v is not None}
    assert {r.problem for r in bad.collect()} == {"unusable location"} and good.count() + bad.count() == len(values)


def test_turn_phase(spark):
    rows = spark.createDataFrame([("B", t, 0 if t == 2 else 1, 1) for t in range(1, 21)], "batch_id string, turn int, n_calls int, n_alerts int")
    got = {r.turn: (r.concluding, r.forced) for r in ledger.turn_phase(rows, max_turns=20).collect()}
    assert got[3] == (False, True) and got[4] == (False, False) and got[10] == (False, False) and got[11] == (True, True)


def test_one_alert_check(spark):
    frame = spark.createDataFrame([(["a"], "a"), (["a", "b"], "a"), (None, "a")], "ids array<string>, alert_id string")
    assert [r[0] for r in frame.select(ledger.is_for(F.col("ids"), F.col("alert_id"))).collect()] == [True, False, False]
