"""Numbered versions below a root: readers see the latest one committed, and of writers of one number one gets it.

A version's rows go to a folder of their own first. It counts once a file with its number is there,
and that file is only created if it is absent: on the driver's own disks by a hard link, elsewhere
by a rename that doesn't overwrite, which are atomic. A writer that comes second sees the conflict,
starts again from the version that won, and so loses nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Conflicts in a row after which a writer gives up.
ATTEMPTS = 50


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def qualified(spark: SparkSession, path: str) -> str:
    """The URI of a path as Spark resolves it, so that driver and executors mean the same file."""
    uri = _path(spark, path)[1].toUri().toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its text at once, or return False where there is one."""
    uri, mark = qualified(spark, path), uuid.uuid4().hex
    if uri.startswith("file://"):
        target = unquote(uri.removeprefix("file://"))
        os.makedirs(os.path.dirname(target), exist_ok=True)
        written = f"{os.path.dirname(target)}/.{mark}"
        with open(written, "x", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(written, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(written)
        return True
    jvm = spark.sparkContext._jvm
    fs, at = _path(spark, path)
    written = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{mark}")
    out = fs.create(written)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(written, at, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(written, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
            return False
        raise
    return True


def head(spark: SparkSession, root: str) -> int:
    """The number of the latest version; 0 if there is none."""
    fs, at = _path(spark, f"{root}/_versions")
    if not fs.exists(at):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)


def at(spark: SparkSession, root: str, number: int) -> dict:
    """{path, n}: where a version is, and its rows where they were counted."""
    return json.loads(spark.read.text(f"{root}/_versions/{number:012d}.json", wholetext=True).first()[0])


def latest(spark: SparkSession, root: str) -> str:
    """Where the latest version is."""
    number = head(spark, root)
    if not number:
        raise ValueError(f"no version below {root}")
    return at(spark, root, number)["path"]


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A version, the latest unless another is asked for."""
    return spark.read.parquet(latest(spark, root) if number is None else at(spark, root, number)["path"])


def new_folder(root: str) -> str:
    return f"{root}/v{uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, path: str, number: int, n: int | None = None) -> bool:
    """Make the folder at path the version of that number, unless there is one."""
    return create_new(spark, f"{root}/_versions/{number:012d}.json", json.dumps({"path": path, "n": n}))


def publish(spark: SparkSession, root: str, path: str, n: int | None = None) -> int:
    """Make the folder at path the next version, whatever others wrote meanwhile; returns its number."""
    for _ in range(ATTEMPTS):
        number = head(spark, root) + 1
        if commit(spark, root, path, number, n):
            return number
    raise RuntimeError(f"{root}: other writers were faster {ATTEMPTS} times")


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame | None]) -> int:
    """Commit change(latest version, None if there is none) as the next one, anew where another writer was faster; a result of None changes nothing. Returns the latest number."""
    for _ in range(ATTEMPTS):
        number = head(spark, root)
        rows = change(read(spark, root, number) if number else None)
        if rows is None:
            return number
        path = new_folder(root)
        rows.write.parquet(path)
        if commit(spark, root, path, number + 1):
            return number + 1
        delete(spark, path)  # this writer's own, never committed
    raise RuntimeError(f"{root}: other writers were faster {ATTEMPTS} times")
