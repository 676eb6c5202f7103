import random

import pytest
from helpers import entry, inventory, random_tree
from pyspark.sql import functions as F

import atticsweep as att
from atticsweep.operators import rollup
from atticsweep.operators.lookup import settled

OPTS = att.ScanOptions()


def totals(rows):
    """Every file added to its folders one by one, up to the first link."""
    folders = {r[0].upper(): r for r in rows if r[1]}
    size = {r[0]: 0 for r in rows if r[1]}
    for r in rows:
        at = None if r[1] else r[0].rsplit("\\", 1)[0]
        while at:
            there = folders.get(at.upper())
            if there:
                size[there[0]] += r[5]
                if there[4]:
                    break
            at = at.rsplit("\\", 1)[0] if "\\" in at else None
    return size


@pytest.mark.parametrize("tasks", [1, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_as_adding_up_file_by_file(spark, seed, tasks):
    """With as many ranges as a tree's folders, nearly all folders begin and end in different ones."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        rows = random_tree(seed, 200)
        # Folders that are only known from their files' paths, and one whose name sorts before a separator.
        rows += [entry("C:\\data\\ghost\\deep\\f", 7), entry("C:\\data\\a b"), entry("C:\\data\\a b\\f", 5), entry("C:\\data\\empty")]
        got = {r["folder"]: r["size_bytes"] for r in att.folder_rollup(inventory(spark, rows), OPTS).collect()}
        assert got == totals(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_deep_folder_over_all_ranges(spark, monkeypatch):
    monkeypatch.setattr(rollup, "ROWS_A_TASK", 20)
    path, rows = "C:\\data", [entry("C:\\data")]
    for i in range(60):
        path += f"\\d{i}"
        rows += [entry(path, link=i == 30), entry(path + "\\f", 1), entry(path + "\\z", 1)]
    got = {r["folder"]: r["size_bytes"] for r in att.folder_rollup(inventory(spark, rows), OPTS).collect()}
    assert got == totals(rows) and got["C:\\data"] == 60


def test_some_folders_roots_apart_and_no_rows(spark):
    rows = [entry("C:\\data"), entry("C:\\data\\x"), entry("C:\\data\\x\\f", 3), entry("C:\\data\\y")]
    inv = inventory(spark, rows)
    both = inv.unionByName(inv.withColumns({"root_id": F.lit("r"), "size_bytes": F.col("size_bytes") * 2}))
    got = {(r["root_id"], r["folder"]): r["size_bytes"] for r in att.folder_rollup(both, OPTS).collect()}
    assert got[("", "C:\\data")] == 3 and got[("r", "C:\\data\\x")] == 6 and got[("r", "C:\\data\\y")] == 0
    only = settled(spark.createDataFrame([("r", "C:\\DATA\\X")], "key_root string, key_path string"), 1 << 20)
    assert [tuple(r) for r in att.folder_rollup(both, OPTS, only).collect()] == [("r", "C:\\data\\x", 6)]
    assert att.folder_rollup(inv.limit(0), OPTS).count() == 0
