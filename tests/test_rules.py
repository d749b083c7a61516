from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siftwell.operators import rules
from siftwell.sources import documents, sinks, versions

FIELDS = "n int, kind string, function string, match string, effect string, target_arg string, source_arg string, length_arg string, field_path string, pair string, confidence string, reason string, source_alert_id string"


def candidates(spark, *rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(({"n": i, "kind": "allocator", "function": "f", "match": "exact", "source_alert_id": "a"} | r).get(n) for n in names) for i, r in enumerate(rows)], FIELDS)


def test_ids_are_hashes_of_the_raw_fields(spark):
    row = {"function": ' mal"loc\n é ', "effect": "x", "confidence": "1e-05", "target_arg": "1", "reason": "世"}
    got = rules.to_rules(candidates(spark, row)).first()
    text = '{"confidence": 1e-05, "effect": "x", "function": ' + json.dumps(row["function"], ensure_ascii=False) + ', "kind": "allocator", "match": "exact", "reason": "世", "target_arg": 1}'
    assert got.id == "proposed-allocator-" + hashlib.sha256(text.encode()).hexdigest()[:16]
    assert got.function == 'mal"loc\n é' and got.confidence == 1e-05 and got.target_arg == 1 and got.status == "proposed"


def test_unusable_candidates_and_values(spark):
    got = rules.to_rules(candidates(spark, {"kind": "nope"}, {"function": " \t"}, {"function": None}, {"match": "fuzzy", "target_arg": "2.7", "source_arg": "x", "confidence": "high"})).collect()
    odd = rules.to_rules(candidates(spark, *({"target_arg": x, "confidence": x} for x in ("1e300", "NaN", "-Infinity", "99999999999")))).collect()
    assert len(odd) == 4 and all(r.target_arg is None for r in odd) and odd[0].confidence == 1e300
    assert len(got) == 1 and got[0].match == "exact" and got[0].target_arg == 2 and got[0].source_arg is None and got[0].confidence is None


def test_first_wins_and_old_ids_stay(spark):
    c = candidates(spark, {"source_alert_id": "one"}, {"source_alert_id": "two"}, {"function": "g"})
    old = rules.first_of_each(rules.to_rules(c.where("n = 2")), "n")
    new = rules.new_rules(c, old, "n")
    assert [r.source_alert_id for r in new.collect()] == ["one"]
    assert rules.appended(old, c, "n").count() == 2


def test_problems(spark):
    rows = [(0, "a", "proposed", "allocator", "f", None), (1, "a", "open", "what", "", "fuzzy"), (2, None, None, "allocator", "f", "exact"), (3, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "idx long, id string, status string, kind string, function string, match string")
    frame = frame.withColumns({c: F.lit(None).cast("string") for c in rules.RULE_COLUMNS if c not in frame.columns})
    got = [r.error for r in rules.problems(frame).orderBy("idx", "n").collect()]
    assert got == ["rules[1]: unsupported kind", "rules[1]: missing or duplicate id", "rules[1]: function is required", "rules[1]: match must be exact or substring", "rules[1]: invalid status", "rules[2]: missing or duplicate id", "rules[3]: not an object"]


def test_review_and_round_trip(spark, tmp_path):
    text = json.dumps({"schema": "semantic-rules/v1", "rules": [{"id": "a", "kind": "allocator", "function": "f", "confidence": 0.5}, {"id": "b", "status": "proposed"}, {"id": "c", "status": "approved"}]}, indent=2)
    (tmp_path / "rules.json").write_text(text)
    read = documents.read_rules(spark, str(tmp_path / "rules.json"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    done = rules.reviewed(read, ids("a", "b", "zzz"), ids("b"))
    assert {r.id: r.status for r in done.collect()} == {"a": "approved", "b": "rejected", "c": "approved"}
    out = json.loads(sinks.repository_text(rules.approved(done)).first().value)
    assert out["schema"] == "semantic-rules/v1" and [r["id"] for r in out["rules"]] == ["a", "c"]
    assert rules.approved(read).count() == 1  # a missing status is not approved
    assert documents.read_rules(spark, str(tmp_path / "gone.json")).count() == 0


def test_versions_of_the_repository(spark, tmp_path):
    root = str(tmp_path / "rules")
    c = candidates(spark, {}, {"function": "g"}, {"function": "g"})
    empty = rules.first_of_each(rules.to_rules(c.limit(0)), "n")
    assert sinks.append_rules(empty, c.where("n = 0"), root, "n") == 1
    first = sinks.read_version(spark, root)
    assert sinks.append_rules(first, c, root, "n") == 1 and sinks.append_rules(sinks.read_version(spark, root), c, root, "n") == 0
    assert sinks.read_version(spark, root).count() == 2 and first.count() == 1
    assert sinks.write_rules(sinks.read_version(spark, root).limit(1), root) == 1


def test_writers_notice_each_other(spark, tmp_path, monkeypatch):
    """Two appends and a review at once: each starts again from what the others committed, and nothing is lost."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "rules")
    sinks.append_rules(rules.first_of_each(rules.to_rules(candidates(spark, {}).limit(0)), "n"), candidates(spark, {"function": "old"}), root, "n")
    old = sinks.read_version(spark, root).first().id
    names = ["a", "b", "c", "d"]
    with ThreadPoolExecutor(5) as pool:
        counts = [pool.submit(sinks.append_rules, sinks.read_version(spark, root), candidates(spark, {"function": f}, {"function": "shared"}), root, "n") for f in names]
        review = pool.submit(sinks.review_rules, spark, root, spark.createDataFrame([(old,)], "id string"), spark.createDataFrame([], "id string"))
        counts, _ = [c.result() for c in counts], review.result()
    rows = sinks.read_version(spark, root).collect()
    assert sorted(r.function for r in rows) == sorted([*names, "shared", "old"]) and sum(counts) == 5
    assert [r.function for r in rows if r.status == "approved"] == ["old"]
    assert versions.head(spark, root) == 6


def test_a_number_is_given_once(spark, tmp_path):
    root = str(tmp_path / "v ü")
    assert versions.head(spark, root) == 0 and versions.commit(spark, root, "x", 1)
    assert not versions.commit(spark, root, "y", 1) and versions.at(spark, root, 1)["path"] == "x" and versions.publish(spark, root, "z", 3) == 2
    assert versions.latest(spark, root) == "z" and versions.at(spark, root, 2)["n"] == 3
    with pytest.raises(ValueError, match="no version"):
        versions.latest(spark, str(tmp_path / "none"))


def test_paths_are_those_of_spark(spark, tmp_path):
    assert versions.qualified(spark, str(tmp_path)) == f"file://{tmp_path}" and versions.qualified(spark, f"file:{tmp_path}/a b") == f"file://{tmp_path}/a%20b"


def test_wrong_envelope(spark):
    with pytest.raises(Exception, match="expected semantic-rules/v1"):
        documents.rules_of(spark.createDataFrame([('{"schema":"x","rules":[]}',)], "value string")).collect()
