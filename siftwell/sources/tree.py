"""A data source for project trees: executors list folders, the driver never holds the files.

`spark.read.format("project_tree").option("root", ...)` gives `path`, relative to the root, of every
file below it, empty ones too; with `option("contents", "true")` also `text`. The driver opens
folders until there are enough of them for the tasks; each task walks the folders below its own, one
folder at a time. Filters on `path` (a prefix, a suffix, equality) are pushed: what can't match
isn't walked. Symbolic links to folders are left out. Spark pushes filters to such sources only
where the setting PUSHDOWN is true, and the option `pushdown` must say the same; else Spark filters
what is listed.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringEndsWith, StringStartsWith

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Folders that the driver makes into tasks, unless there are fewer; rows handed over at once.
FOLDERS, ROWS = 256, 10_000


class Folder(InputPartition):
    """A folder below the root, with all below it or its own files only."""

    def __init__(self, path: str, deep: bool) -> None:
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class Tree:
    """Entries of folders, on local disks or in a store that Arrow can open."""

    def __init__(self, root: str) -> None:
        self.local = "://" not in root or root.startswith("file://")
        if self.local:
            self.system, self.base = None, root.removeprefix("file://").rstrip("/") or "/"
        else:
            from pyarrow import fs

            self.system, self.base = fs.FileSystem.from_uri(root)

    def entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        """(path below the root, is a folder) of what a folder holds."""
        prefix = f"{folder}/" if folder else ""
        if self.local:
            with os.scandir(f"{self.base}/{folder}") as found:
                for e in found:
                    if not (e.is_symlink() and e.is_dir()):
                        yield prefix + e.name, e.is_dir(follow_symlinks=False)
        else:
            from pyarrow import fs

            for e in self.system.get_file_info(fs.FileSelector(f"{self.base}/{folder}".rstrip("/"))):
                yield prefix + e.base_name, e.type == fs.FileType.Directory

    def text(self, path: str) -> str:
        if self.local:
            with open(f"{self.base}/{path}", "rb") as data:
                return data.read().decode("utf-8", "replace")
        with self.system.open_input_stream(f"{self.base}/{path}") as data:
            return data.readall().decode("utf-8", "replace")


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.folders = options["root"], int(options.get("folders", FOLDERS))
        self.contents = str(options.get("contents", "false")).lower() == "true"
        self.prefix, self.suffix = "", ""

    def may_hold(self, folder: str) -> bool:
        """Whether a path below the folder may have the prefix."""
        below = f"{folder}/"
        return below.startswith(self.prefix) or self.prefix.startswith(below)

    def partitions(self) -> Sequence[InputPartition]:
        tree, flat, open_folders = Tree(self.root), [], deque([""])
        while open_folders and len(open_folders) + len(flat) < self.folders:
            folder = open_folders.popleft()
            flat.append(Folder(folder, False))
            open_folders += (path for path, is_folder in tree.entries(folder) if is_folder and self.may_hold(path))
        return flat + [Folder(f, True) for f in open_folders]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        tree, todo, out, size = Tree(self.root), [partition.path], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(out, pa.string())]
            if self.contents:
                columns.append(pa.array([tree.text(p) for p in out], pa.string()))
            return pa.RecordBatch.from_arrays(columns, ["path", "text"][: len(columns)])

        most = 16 if self.contents else ROWS
        while todo:
            for path, is_folder in tree.entries(todo.pop()):
                if is_folder:
                    if partition.deep and self.may_hold(path):
                        todo.append(path)
                elif path.startswith(self.prefix) and path.endswith(self.suffix):
                    out.append(path)
                    if len(out) >= most:
                        yield batch()
                        out = []
        if out:
            yield batch()


class FilteredTreeReader(TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take prefixes and suffixes of the path; of several prefixes the longest that goes with the others."""
        for f in filters:
            on_path = getattr(f, "attribute", None) == ("path",)
            if on_path and isinstance(f, (StringStartsWith, EqualTo)) and f.value.startswith(self.prefix):
                self.prefix = f.value
            elif on_path and isinstance(f, StringEndsWith) and f.value.endswith(self.suffix):
                self.suffix = f.value
                continue
            if not (on_path and isinstance(f, StringStartsWith) and self.prefix.startswith(f.value)):
                yield f  # Spark applies it again


class ProjectTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return "path string, text string" if str(self.options.get("contents", "false")).lower() == "true" else "path string"

    def reader(self, schema: object) -> TreeReader:
        pushed = str(self.options.get("pushdown", "false")).lower() == "true"
        return (FilteredTreeReader if pushed else TreeReader)(dict(self.options))


#: Schemes that the tasks can list; other stores are left to Spark's own reader.
LISTED = ("file", "s3", "gs", "gcs", "abfs", "abfss")


def listed(spark: SparkSession, root: str, **options: object) -> DataFrame | None:
    """The tree below root through the data source, or None if its store isn't one that tasks can list."""
    from .versions import qualified

    uri = qualified(spark, root)
    if uri.partition(":")[0] not in LISTED:
        return None
    if uri.startswith("file://"):
        from urllib.parse import unquote

        uri = unquote(uri)
    spark.dataSource.register(ProjectTree)
    return spark.read.format("project_tree").options(root=uri, pushdown=spark.conf.get(PUSHDOWN), **options).load()
