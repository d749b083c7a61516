from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from siftwell.llm import warc
from siftwell.llm.common import shared_dir


def run(spark, rows, min_bytes=0):
    root = shared_dir(spark)
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write(pages, root, min_bytes)
    return index, root, warc.resolved(warc.read(index, root)).collect()


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(1, "u1", "<p>é</p>"), (2, "u\r\n2", "<p>é</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "a\r\n\r\nb" * 5000), (9, "x", "<p>é</p>"), (9, "x", "<p>é</p>"), (None, "n", "<p>é</p>")]
    index, root, out = run(spark, rows)
    assert len(out) == len(rows)
    got = sorted((r.record_id or "", r.payload_bytes, r.digest, r.record_type, r.refers_to or "") for r in out)
    want = sorted(("" if i is None else str(i), len((h or "").encode()), sha(h), "response" if i in (4, 5, 9) else "revisit", "" if i in (4, 5, 9) else "9" if h else "4") for i, _, h in rows)
    assert got == want
    # a few records only
    some = warc.read(index.where("page_id in (2, 5)"), root).collect()
    assert sorted(r.record_id for r in some) == ["2", "5"] and {r.url for r in some} == {"u  2", "u5"}


def test_small_payloads_stay(spark):
    _, _, out = run(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], min_bytes=4)
    assert {r.record_id: r.record_type for r in out} == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_damage_is_noticed(spark):
    index, root, _ = run(spark, [(1, "u", "abc"), (2, "u", "def")])
    with pytest.raises(Exception, match="digests differ"):
        warc.read(index.withColumn("digest", F.lit("X")), root).collect()


def test_base32_and_empty(spark):
    texts = ["", "a", "é" * 99]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.base32_sha1(F.col("t").cast("binary"))).collect()]
    assert got == [sha(t) for t in texts]
    assert run(spark, [(1, "u", "x")])[0].limit(0).count() == 0
