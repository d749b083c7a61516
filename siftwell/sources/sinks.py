"""Sinks: versioned tables, rule repositories, failure logs.

Whole outputs are numbered versions (`versions.py`), so readers see the old or the new one, never a
half one, and writers notice each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..work import saved
from . import versions
from .documents import RULE_SCHEMA


def write_version(df: DataFrame, root: str) -> str:
    """Write df as a new version below root; returns the version's path."""
    path = versions.new_folder(root)
    df.write.parquet(path)
    versions.publish(df.sparkSession, root, path)
    return path


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The latest version."""
    return versions.read(spark, root)


def latest(spark: SparkSession, root: str) -> str:
    """Where the latest version is."""
    return versions.latest(spark, root)


def write_documents(written: DataFrame, root: str) -> str:
    """Alert documents (file_path below the root, raw) as one file each in a new version below root; returns its path, from which they can be read as alerts again.

    Tasks write their own files, a repeated task the same ones again; the version counts once all are
    there. The path is resolved once, on the driver, as Spark resolves it for its own readers.
    """
    path = versions.new_folder(root)
    target = versions.qualified(written.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(target)
        n = 0
        for batch in batches:
            for name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                system.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(raw.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    n = written.where("file_path is not null and raw is not null").select("file_path", "raw").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    versions.publish(written.sparkSession, root, path, n or 0)
    return path


def write_rules(rules: DataFrame, root: str) -> int:
    """Rules as a new version below root; returns how many there are, counted as they are written."""
    counted = Observation()
    write_version(rules.observe(counted, F.count(F.lit(1)).alias("n")), root)
    return counted.get["n"]


def append_rules(repository: DataFrame, candidates: DataFrame, root: str, *order: str) -> int:
    """Add the candidates' new rules to the latest version below root, or to the repository where there is none; returns how many are new.

    Where another writer commits first, its rules are read and what is still new is added to them.
    """
    n = 0

    def change(current: DataFrame | None) -> DataFrame | None:
        nonlocal n
        base = repository if current is None else current
        new = saved(R.new_rules(candidates, base, *order))
        n = new.count()
        return base.select(*R.RULE_COLUMNS).unionByName(new.select(*R.RULE_COLUMNS)) if n else None

    versions.update(repository.sparkSession, root, change)
    return n


def review_rules(spark: SparkSession, root: str, approve: DataFrame, reject: DataFrame) -> int:
    """Set the status of listed rules in the latest version below root; returns its number. Rules that others add meanwhile stay."""
    return versions.update(spark, root, lambda current: None if current is None else R.reviewed(current, approve, reject))


def repository_text(rules: DataFrame) -> DataFrame:
    """One row with the repository as JSON; for reviewed sets, which people keep small."""
    columns = [c for c in rules.columns if c != "idx"]
    ordered = F.array_sort(F.collect_list(F.struct("idx", *columns)))
    bare = F.transform(ordered, lambda r: F.struct(*(r[c].alias(c) for c in columns)))
    return rules.agg(F.to_json(F.struct(F.lit(RULE_SCHEMA).alias("schema"), bare.alias("rules"))).alias("value"))


def append_failures(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_summary(summary: DataFrame, root: str) -> str:
    """The roll-up as a new version below root."""
    return write_version(summary.coalesce(1), root)
