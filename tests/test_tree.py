"""The project tree against os.walk."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from siftwell.sources import documents, tree


def walked(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files)


def make(root, names, text=""):
    for name in names:
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as out:
            out.write(text)


def test_all_files_of_odd_names(spark, tmp_path):
    root = str(tmp_path / "a b%20ü")
    make(root, ["x.c", "d/e/f/g.c", "d/é 1.h", "d/.hidden", "d/_under/x", "empty%41.c", "deep/" * 20 + "z.c"], "one\ntwo")
    os.makedirs(f"{root}/none")
    os.symlink(root, f"{root}/d/loop")
    got = sorted(r.path for r in documents.project_files(spark, root).collect())
    assert got == walked(root)
    lines = documents.source_lines(spark, root).where("file = 'd/é 1.h'").collect()
    assert sorted((r.ln, r.text) for r in lines) == [(1, "one"), (2, "two")]


def test_a_hundred_thousand_empty_files(spark, tmp_path):
    root = str(tmp_path)
    for d in range(50):
        os.makedirs(f"{root}/d{d % 7}/e{d}")
        for i in range(2000):
            os.close(os.open(f"{root}/d{d % 7}/e{d}/f{i}.c", os.O_CREAT | os.O_WRONLY))
    files = documents.project_files(spark, root)
    assert files.rdd.getNumPartitions() == 58  # the root and its folders, and one for each below them
    assert files.count() == files.distinct().count() == 100_000


@pytest.mark.parametrize("folders", [1, 3, 1000])
def test_filters_are_pushed(spark, tmp_path, folders):
    root = str(tmp_path)
    make(root, [f"{a}/{b}/{c}.{x}" for a in ("src", "srcs", "lib") for b in "pq" for c in "mn" for x in "ch"])
    spark.conf.set(tree.PUSHDOWN, "true")
    try:
        files = tree.listed(spark, root, folders=folders)
        for rule, want in [
            (F.col("path").startswith("src/"), lambda p: p.startswith("src/")), (F.col("path").startswith("src"), lambda p: p.startswith("src")), (F.col("path") == "lib/p/m.c", lambda p: p == "lib/p/m.c"),
            (F.col("path").endswith(".c") & F.col("path").startswith("lib/q/n"), lambda p: p.endswith(".c") and p.startswith("lib/q/n")), (F.col("path").startswith("src/") & F.col("path").startswith("lib"), lambda p: False),
            (F.col("path").contains("/p/"), lambda p: "/p/" in p), (F.col("path").endswith("c") & F.col("path").endswith("m.c"), lambda p: p.endswith("m.c")),
        ]:
            assert sorted(r.path for r in files.where(rule).collect()) == [p for p in walked(root) if want(p)]
    finally:
        spark.conf.unset(tree.PUSHDOWN)
    reader = tree.FilteredTreeReader({"root": root})
    list(reader.pushFilters([tree.StringStartsWith(("path",), "src/p")]))
    assert [p.path for p in reader.partitions()] == ["", "src", "src/p"]  # other folders aren't opened
