from __future__ import annotations

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from siftwell.llm import media

from .conftest import ODD


@pytest.mark.parametrize("n", [64, 128, 64 * 63, 64 * 64, 64 * 65, 64 * 1000])
def test_container_round_trip(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    data = memoryview(media.container(payload))
    (track,) = media.tables(data)
    assert media.read_samples(data, track) == payload
    assert track["codec"] == "raw " and track["duration"] == n and track["timescale"] == media.RATE
    assert [bytes(data[o : o + 64]) for o in track["offsets"][track["keys"]]] == [payload[i : i + 64] for i in range(0, n, 64 * media.KEY_EVERY)]
    paths = [p for p, _, _ in media.boxes(data)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths and paths[0] == (b"ftyp",)


def test_query_columns(make):
    rows = [*ODD, (1, "é" * 500), (2, "a" * 64)]
    stored = media.wrap(make(rows).withColumns({c: F.lit(1) for c in ("media", "n_bytes", "error")}))
    out = media.probe(stored, "doc_id", "n_bytes").collect()
    kept = {hashlib.sha256(bytes(r.media)).hexdigest(): len(r.media) for r in stored.collect()}
    assert {r.media_sha256: r.media_bytes for r in out} == kept
    for r in out:
        assert [(k.offset - r.keyframes[0].offset, k.length) for k in r.keyframes] == [(a, 64) for a in range(0, r.payload_bytes, 64 * media.KEY_EVERY)]
    got = sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) for r in out)
    want = []
    for _, t in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), None))
    assert got == sorted(want)


def test_broken_containers(spark):
    good = media.container(bytes(64))
    deep = b""
    for _ in range(3000):
        deep = media._box(b"moov", deep)
    at = good.index(b"stsz") + 8
    many = good[:at] + b"\xff" * 8 + good[at + 8 :]
    own = good[:at] + bytes(4) + b"\xff" * 4 + good[at + 8 :]
    at = good.index(b"stco") + 12
    far = good[:at] + b"\x7f" * 4 + good[at + 4 :]
    at = good.index(b"stsc") + 8
    runs = good[:at] + b"\xff" * 4 + good[at + 4 :]
    odd = [(10 + i, bytearray(x)) for i, x in enumerate((deep, many, own, far, runs))]
    frame = spark.createDataFrame([*odd, (1, bytearray(good[:-9])), (2, bytearray(b"nonsense")), (3, bytearray()), (4, None), (5, bytearray(good))], "id int, media binary")
    out = {r.id: r for r in media.probe(frame, "id").collect()}
    assert all(out[i].error and out[i].payload_bytes is None for i in (1, 2, 3, 4, 10, 11, 12, 13, 14)) and out[5].error is None
    assert media.probe(frame.limit(0), "id").count() == 0


def test_samples_that_overlap_are_refused():
    """Many samples at one place would read far more than the file holds."""

    def file(sizes, offsets):
        n = len(sizes)
        table = (
            media._full(b"stsd", struct.pack(">I", 1), media._box(b"raw ", bytes(28))), media._full(b"stsz", struct.pack(">II", 0, n), struct.pack(f">{n}I", *sizes)),
            media._full(b"stco", struct.pack(f">{n + 1}I", n, *offsets)), media._full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)),
        )
        inner = media._box(b"minf", media._box(b"stbl", *table))
        return media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._full(b"mdhd", struct.pack(">IIIII", 0, 0, 8000, n, 0)), inner)))

    assert len(media.tables(memoryview(file([8] * 9, range(9))))[0]["sizes"]) == 9
    with pytest.raises(ValueError, match="overlap"):
        media.tables(memoryview(file([200] * 9, [0] * 9)))
