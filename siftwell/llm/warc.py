"""WARC archives with an index written first and coalesced range reads.

`write` puts a record per page into archives in the shared folder (each record a gzip member of
its own) and writes the index: file, offset, length, URL and digest per record. Payloads that
occur more than once are stored once: the record with the largest page id is the response, the
others revisit it. `read` takes index rows, sorts them by file and offset, joins ranges that lie
close together into one read, and parses the records.

Null html is an empty payload; a null URL is written as an empty one. A null id counts as
smaller than any other; rows that tie for the largest id of a payload are all responses, so
repeated rows stay apart. Payloads are kept whole, a very long one is read by itself. Payloads below `min_bytes` are never revisits. An empty table makes an
empty index. Other columns are dropped. A failed task leaves only a file that no index row names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, saved, shared_dir, small_batches

#: Digits of base32, in order of value.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Ranges at most GAP apart are read at once, up to SPAN bytes; READ_BLOCK bytes of a file go to one task.
GAP, SPAN, READ_BLOCK = 64 << 10, 8 << 20, 16 << 20
END = b"\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary or string column in base32: four groups of 40 bits, eight digits each."""
    digits = F.array(*(F.lit(c) for c in BASE32))
    code = F.sha1(data)
    groups = [F.conv(F.substring(code, 1 + 10 * k, 10), 16, 10).cast("long") for k in range(4)]
    return F.concat(*(digits[F.shiftright(g, 35 - 5 * d).bitwiseAND(F.lit(31)).cast("int")] for g in groups for d in range(8)))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _urn(page_id: object) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: object, url: str | None, payload: bytes | None, digest: str, keeper: object) -> bytes:
    """The bytes of a record; without a payload, a revisit of the keeper's response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
    block = http if payload is None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {url or ''}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(keeper)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).replace("\n\n", "\n").encode() + END + block + END


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(END)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(END)[2]


def write(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives below root; returns the index, already written too."""
    small_batches(pages.sparkSession)
    id_type = dict(pages.dtypes)["page_id"]
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), body.alias("payload"), base32_sha1(body).alias("digest"))
    # only payloads that occur more than once meet their keeper; where they are few, no payload is shuffled
    often = saved(rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("often")).where("often > 1"))
    rows = rows.join(often, "digest", "left")
    revisit = F.col("often").isNotNull() & (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in pieces(batches, "payload"):
                index = []
                for page_id, url, payload, digest, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(record(page_id, url, payload, digest, keeper), 5, mtime=0)
                    out.write(member)
                    index.append((name, at, len(member), page_id, url, digest, "response" if payload is not None else "revisit"))
                    at += len(member)
                kinds = [pa.string(), pa.int64(), pa.int64(), batch.schema.field(0).type, pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], ["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return saved(rows.mapInArrow(run, f"file string, offset long, length long, page_id {id_type}, url string, digest string, record_type string"))


def read(index: DataFrame, root: str) -> DataFrame:
    """Records of the index rows: headers, and size and digest of the payload that was read."""
    small_batches(index.sparkSession)
    block = F.floor(F.col("offset") / READ_BLOCK)
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = index.select("file", "offset", "length", "digest").repartition(n, "file", block).sortWithinPartitions("file", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int, str]]]:
        """Neighbours that are read together."""
        group: list[tuple[str, int, int, str]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and (row[0] != group[0][0] or row[1] > sum(group[-1][1:3]) + GAP or row[1] + row[2] > group[0][1] + SPAN):
                    yield group
                    group = []
                group.append(row)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        for name, groups in itertools.groupby(ranges(batches), key=lambda g: g[0][0]):
            with fs.open_input_file(f"{base}/{name}") as file:
                yield from map(lambda g: records(name, file, g), groups)

    def records(name: str, file, group: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
        """What one read of neighbouring records holds."""
        start = group[0][1]
        data, out = memoryview(file.read_at(sum(group[-1][1:3]) - start, start)), []
        for _, offset, length, digest in group:
            fields, payload = parse(gzip.decompress(data[offset - start : offset - start + length]))
            kind = fields["WARC-Type"]
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or kind == "response" and own != digest:
                raise ValueError(f"{name} at {offset}: digests differ")
            ids = [None if x in (None, "null") else x for x in (fields[k][10:-1] if k in fields else None for k in ("WARC-Record-ID", "WARC-Refers-To"))]
            out.append((ids[0], fields["WARC-Target-URI"], kind, digest, ids[1], len(payload) if kind == "response" else None))
        kinds = [pa.string()] * 5 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["record_id", "url", "record_type", "digest", "refers_to", "payload_bytes"])

    return rows.mapInArrow(run, "record_id string, url string, record_type string, digest string, refers_to string, payload_bytes long")


def resolved(records: DataFrame) -> DataFrame:
    """Give each revisit the payload size of the response that it refers to."""
    full = records.where("record_type = 'response'").groupBy("digest").agg(F.max("payload_bytes").alias("full_bytes"))
    return records.join(full, "digest", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).drop("full_bytes")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = shared_dir(spark)
    return resolved(saved(read(write(pages, root), root))).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )
