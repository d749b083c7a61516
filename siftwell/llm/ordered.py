"""Places in groups and digests of ordered groups, where one group may hold any share of the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Bytes of an open group that are put into one row.
CHUNK = 1 << 20


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def by_range(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """rows in partitions of consecutive keys, sorted; a key's rows may go on in the next partition."""
    return rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def places(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """rows with `place`, their 0-based number in the group by `order`.

    Rows are sorted by range and counted within their partition; where a group goes on from another
    partition comes from one small row per group and partition, so no group is in one task.
    """
    ranged = by_range(rows, group, *order)
    low = (1 << 33) - 1  # the part of the id that counts rows of a partition
    placed = saved(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("_row")))
    runs = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n")
    starts = runs.select(group, "_part", (before - F.col("_first")).alias("_start"))
    return placed.join(starts, [group, "_part"]).select(*rows.columns, (F.col("_row") + F.col("_start")).alias("place"))


def hash_chunks(chunks: DataFrame, key: str, separator: bytes) -> DataFrame:
    """(key, sha256): of each key's chunks (key, at, chunk) in order of `at`, with the separator between; chunks pass one at a time.

    The digest is sequential by nature: one task reads a key's chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, current, state = None, None, None
        for batch in batches:
            out = []
            key_type = batch.schema.field(0).type
            for k, chunk in zip(batch.column(0).to_pylist(), batch.column("chunk")):
                if state is None or k != current:
                    if state is not None:
                        out.append((current, state.hexdigest()))
                    current, state = k, hashlib.sha256()
                else:
                    state.update(separator)
                state.update(chunk.as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], key_type), pa.array([d for _, d in out], pa.string())], [key, "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], key_type), pa.array([state.hexdigest()], pa.string())], [key, "sha256"])

    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, "at", "chunk").repartition(key).sortWithinPartitions(key, "at").mapInArrow(run, f"`{key}` {kind}, sha256 string")


def digests(rows: DataFrame, key: str, order: str, separator: str = ",") -> DataFrame:
    """(key, sha256): SHA-256 of the decimal `order` values of each key, ascending, with the separator between.

    Rows are sorted by range; a group that lies inside a partition is hashed there, others are put
    into chunks, and only these meet by key.
    """
    sep = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first, current, held, size = TaskContext.get().partitionId(), 0, True, None, [], 0
        out: list[tuple] = []
        opened = False

        def chunk() -> None:
            nonlocal held, size, seq, opened
            out.append((current, None, {"part": part, "seq": seq}, sep.join(held)))
            held, size, seq, opened = [], 0, seq + 1, True

        def batch_of() -> pa.RecordBatch:
            at = pa.struct([("part", pa.int32()), ("seq", pa.int32())])
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), at, pa.binary()))], [key, "sha256", "at", "chunk"])

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and k != current:
                    if first or opened:
                        chunk()
                    else:
                        out.append((current, hashlib.sha256(sep.join(held)).hexdigest(), None, None))
                    held, size, first, opened = [], 0, False, False
                elif k != current:
                    first, opened = first and current is None, False
                current = k
                held.append(str(v).encode())
                size += len(held[-1]) + 1
                if size >= CHUNK:
                    chunk()
            if out:
                yield batch_of()
        if held:
            chunk()
        if out:
            yield batch_of()

    ranged = by_range(rows.select(F.col(key), F.col(order)), key, order)
    parts = saved(ranged.mapInArrow(run, f"`{key}` string, sha256 string, at struct<part: int, seq: int>, chunk binary"))
    whole = parts.where("sha256 is not null").select(key, "sha256")
    return whole.unionByName(hash_chunks(parts.where("sha256 is null"), key, sep))
