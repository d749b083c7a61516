"""Media columns: payloads in ISO media containers, probed without decoding them.

`wrap` puts bytes into a container column; `probe` walks the nested boxes of such a column,
decodes the sample tables and reports codec, duration and the byte ranges of key frames.

Null texts count as empty; the payload is padded with zeros to a positive multiple of 64, so an
empty text has one sample. Equal texts give equal containers; very long ones get 64-bit sizes and
are handled by themselves. A container that can't be read (boxes that leave their parent or nest
too deep, tables that claim more than the file holds) gives nulls and the reason in `error`, never a
failed task. Rows are independent: repeated rows give equal results, an empty table an empty one;
columns other than those kept are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, saved, small_batches

#: Bytes of a sample, of padding, and of what tail_crc32 covers.
FRAME = 64
#: Every so many samples is a key frame, and so many samples make a chunk.
KEY_EVERY, PER_CHUNK = 16, 64
#: Unsigned 8-bit samples a second.
RATE = 8000
#: Boxes nest this deep at most.
DEPTH = 32
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def _full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *body)


def container(payload: bytes) -> bytes:
    """A file with one sound track of 8-bit samples; the media data comes before the tables."""
    n = len(payload) // FRAME
    n_chunks = -(-n // PER_CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    large = len(payload) + 8 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(ftyp) + len(head)
    offsets = range(first, first + len(payload), FRAME * PER_CHUNK)
    rest = n - (n_chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK)] * (n_chunks > 1) + [(n_chunks, rest)]
    keys = range(1, n + 1, KEY_EVERY)
    length = n * FRAME
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, FRAME)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, k, 1) for a, k in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        _full(b"co64", struct.pack(f">I{n_chunks}Q", n_chunks, *offsets)) if large else _full(b"stco", struct.pack(f">I{n_chunks}I", n_chunks, *offsets)),
    )
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, length, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, head, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def boxes(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start and end of the body) of each box, depth first."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while open_:
        path, start, end = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        if len(path) >= DEPTH:
            raise ValueError(f"boxes nest deeper than {DEPTH}")
        yield (*path, kind), body, stop
        open_.append((path, stop, end))
        if kind in NESTED:
            open_.append(((*path, kind), body, stop))


def _entries(data: memoryview, a: int, b: int, width: int, at: int = 4):
    """The rows of a table that counts them in front, as unsigned numbers of `width` bytes."""
    import numpy as np

    (n,) = struct.unpack_from(">I", data, a + at)
    if a + at + 4 + n * width > b:
        raise ValueError(f"a table claims {n} rows that its box doesn't hold")
    return np.frombuffer(data[a + at + 4 : a + at + 4 + n * width], ">u8" if width == 8 else ">u4").astype(np.int64)


def tables(data: memoryview) -> list[dict]:
    """For each track: codec, timescale, duration, and offset, size and key frames of its samples."""
    import numpy as np

    tracks: list[dict] = []
    for path, a, b in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        if len(path) < 3 or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
        elif kind == b"stsd":
            t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, a + 4)
            if size * n > len(data):
                raise ValueError(f"{n} samples of {size} bytes don't fit the file")
            t["sizes"] = np.full(n, size, np.int64) if size else _entries(data, a, b, 4, 8)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _entries(data, a, b, 8 if kind == b"co64" else 4)
        elif kind == b"stsc":
            t["runs"] = _entries(data, a, b, 12).reshape(-1, 3)
        elif kind == b"stss":
            t["keys"] = _entries(data, a, b, 4) - 1
    for t in tracks:
        n, n_chunks = len(t["sizes"]), len(t["chunks"])
        of_run = np.diff(np.append(t["runs"][:, 0] - 1, n_chunks))
        if (of_run < 0).any() or sum(int(k) * int(c) for k, c in zip(t["runs"][:, 1], of_run)) != n:
            raise ValueError("chunks and samples don't agree")
        each = np.repeat(t["runs"][:, 1], of_run)
        chunk = np.repeat(np.arange(n_chunks), each)
        before = np.cumsum(t["sizes"]) - t["sizes"]
        start_of_chunk = np.append(before, 0)[np.cumsum(each) - each]
        t["offsets"] = t["chunks"][chunk] + before - start_of_chunk[chunk]
        if n and (int(t["offsets"].min()) < 0 or int((t["offsets"] + t["sizes"]).max()) > len(data)):
            raise ValueError("samples lie outside the file")
        if int(t["sizes"].sum()) > len(data):
            raise ValueError("samples overlap: together they are longer than the file")
        t.setdefault("keys", np.arange(n))
        if len(t["keys"]) and not 0 <= int(t["keys"].min()) <= int(t["keys"].max()) < n:
            raise ValueError("key frames that aren't samples")
    return tracks


def read_samples(data: memoryview, track: dict) -> bytes:
    """The track's samples, in order; runs that touch are read at once."""
    import numpy as np

    start, end = track["offsets"], track["offsets"] + track["sizes"]
    cut = np.flatnonzero(start[1:] != end[:-1]) + 1
    firsts, lasts = np.append(0, cut), np.append(cut, len(start)) - 1
    return b"".join(data[start[i] : end[j]] for i, j in zip(firsts, lasts)) if len(start) else b""


def wrap(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's UTF-8, padded, in a container."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data = [x or b"" for x in batch.column("text").to_pylist()]
            media = [container(x + bytes(-len(x) % FRAME if x else FRAME)) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_bytes long, media binary")


PROBE = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, timescale long, "
    "duration long, n_samples long, n_keyframes long, keyframes array<struct<offset: long, length: long>>, error string"
)


def probe(media: DataFrame, *keep: str, column: str = "media") -> DataFrame:
    """The kept columns, and what the first track's tables say; a key frame's range is that of its sample."""
    small_batches(media.sparkSession)

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 11 + ("null",)
        view = memoryview(data)
        head = (len(data), hashlib.sha256(data).hexdigest())
        try:
            track = tables(view)[0]
            payload = read_samples(view, track)
            keys = track["keys"]
            ranges = [{"offset": o, "length": n} for o, n in zip(track["offsets"][keys].tolist(), track["sizes"][keys].tolist())]
            return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), *head, track["codec"], track["timescale"], track["duration"], len(track["sizes"]), len(ranges), ranges, None)
        except (ValueError, LookupError, ArithmeticError, struct.error) as e:
            return (None, None, None, *head, *(None,) * 6, f"{type(e).__name__}: {e}")

    kept = media.select(*keep, F.col(column).alias("media"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", " + PROBE
    names = [x.split()[0] for x in PROBE.replace("array<struct<offset: long, length: long>>", "ranges").split(", ")]
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    kinds = [ranges if n == "keyframes" else pa.string() if n in ("payload_sha256", "media_sha256", "codec", "error") else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            columns = zip(*map(one, batch.column("media").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds))], [*keep, *names])

    return kept.mapInArrow(run, schema)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = saved(wrap(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    last = F.element_at("keyframes", -1)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.trim("codec")),
        F.concat(F.lit("duration="), F.col("duration"), F.lit("/"), F.col("timescale")),
        F.concat(F.lit("samples="), F.col("n_samples")),
        F.concat(F.lit("keyframes="), F.col("n_keyframes")),
        F.concat(F.lit("last="), last["offset"], F.lit("+"), last["length"]),
    )
    return probe(stored, "doc_id", "n_bytes").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "keyframes")
