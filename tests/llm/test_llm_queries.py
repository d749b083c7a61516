from __future__ import annotations

import hashlib
import struct
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from siftwell.llm import oracles, registry

from ..conftest import SMALL
from .test_bpe import EXACT
from .test_lines import brute as lines_left
from .test_minhash import brute as groups
from .test_quality import base as base_counts


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(name, spark, duck, same):
    same(registry.queries()[name](spark, SMALL), duck.execute(registry.oracle_sql()[name]).df())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        table = docs.toPandas()
        docs = corpus_pipeline.saved(stage(spark, docs, SMALL))
        rows = docs.collect()
        assert rows and {r.doc_id for r in rows} <= set(before), name
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality_rules":
            assert len(rows) == len({r.doc_id for r in rows}) < len(before) and all(r.text == before[r.doc_id] for r in rows)
            assert not {r.doc_id for r in rows} & {i for i, t in before.items() if base_counts(t)[-1]}  # whatever fails the base rules is gone
            bad = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.quality == 0}
            good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.quality == 1}
            assert {i for i in good if not base_counts(before[i])[-1]} <= {r.doc_id for r in rows} and len(bad & {r.doc_id for r in rows}) <= len(bad) // 4
        if name == "line_dedup":
            want = lines_left(list(before.items()))
            assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {i: (want[i, t][2], len(want[i, t][2])) for i, t in before.items()} and len(rows) == len(before)
        if name == "near_dedup":
            assert sorted((r.doc_id, r.text) for r in rows) == sorted((i, before[i]) for i, _, _, kept in groups(list(before.items()), 5, 80) if kept)
        if name == "mix_sources":
            con = duckdb.connect()
            con.register("documents", table)
            want = {i: int(taken) // size if size else 0 for i, size, _, _, taken in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({oracles.OP9})").fetchall()}
            assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in want.items() if n}) and all(r.text == before[r.doc_id] for r in rows)
        if name == "bpe":
            for r in rows:
                ids = EXACT.encode_ordinary(before[r.doc_id])
                assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
                assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


def test_pipeline_on_odd_rows_and_clashing_columns(spark):
    clash = ["size", "kept", "taken", "key", "label", "d", "h", "n", "lines", "drops", "target", "span", "rep", "_row", "_copy"]
    text = "every word of this text is its own and stays where it was put by hand"
    rows = [(i, t, lang, source, None) for i, (t, lang, source) in enumerate([(text, "en", "a"), (text, None, None), (None, "en", "a"), ("", None, "a"), (text.upper(), "en", None), ("x " * 50_000, "en", "a")])]
    rows += [rows[0], (None, text + " twice", "en", "a", 3)]
    docs = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in clash))
    for part in (docs, docs.limit(0)):
        current, n = part, None
        for _, stage in corpus_pipeline.STAGES:
            current = corpus_pipeline.saved(stage(spark, current, SMALL))
            n = current.count()
        assert current.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and (n > 0) == (part is docs)
