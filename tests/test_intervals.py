import random
import re

import pytest
from helpers import inventory, paths, random_tree
import atticsweep as att
from atticsweep.operators import intervals

ODD_NAMES = ["a", "A", "a b", "a!b", "a-b", "a.b", "aé", "a\x01b", "b", "ß", "ab"]


def odd_paths(seed, n=300):
    """Folders whose names sort before or behind a separator."""
    rng, found = random.Random(seed), ["C:\\data"]
    for _ in range(n):
        path = f"{rng.choice(found[-40:] + found[:5])}\\{rng.choice(ODD_NAMES)}"
        if path.upper() not in {p.upper() for p in found}:
            found.append(path)
    return found


def below(path, roots):
    return any(path.upper() == r.upper() or path.upper().startswith(r.upper() + "\\") for r in roots)


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_subtrees_of_folders_are_marked(spark, seed, limit):
    rng, all_paths = random.Random(seed), odd_paths(seed)
    chosen = rng.sample(all_paths[1:], 25)
    chosen += chosen[:5] + [c.lower() for c in chosen[5:8]]  # repeated, and in another case
    rows = spark.createDataFrame([(r, p, i) for i, p in enumerate(all_paths) for r in ("", "x")], "root_id string, full_path string, n int")
    roots = spark.createDataFrame([("x", p) for p in chosen], "root_id string, full_path string")
    got = {(r.root_id, r.full_path): r.marked for r in intervals.mark_subtrees(rows, roots, att.ScanOptions(broadcast_bytes=limit)).collect()}
    assert got == {(r, p): r == "x" and below(p, chosen) for p in all_paths for r in ("", "x")}


def test_a_subtree_reaches_over_many_ranges(spark, monkeypatch):
    """One folder holds nearly all rows: its range is dealt to all tasks, and deeper roots in it change nothing."""
    monkeypatch.setattr(intervals, "ROWS_A_TASK", 100)
    files = [f"C:\\data\\big\\{i:05d}" for i in range(3000)] + ["C:\\data\\bigger", "C:\\data\\a"]
    roots = ["C:\\data\\big", *files[10:3000:97], "C:\\data\\big\\00010\\x"]
    rows = spark.createDataFrame([("", f) for f in files], "root_id string, full_path string")
    marked = intervals.mark_subtrees(rows, spark.createDataFrame([("", r) for r in roots], rows.schema), att.ScanOptions(broadcast_bytes=0))
    assert marked.filter("marked").count() == 3000


def test_no_roots_or_no_rows(spark):
    rows = spark.createDataFrame([("", "C:\\data\\a")], "root_id string, full_path string")
    for limit in (64 << 20, 0):
        assert [r.marked for r in intervals.mark_subtrees(rows, rows.limit(0), att.ScanOptions(broadcast_bytes=limit)).collect()] == [False]
        assert intervals.mark_subtrees(rows.limit(0), rows, att.ScanOptions(broadcast_bytes=limit)).count() == 0


def test_the_inventory_is_read_once_and_never_joined_on_paths(spark, tmp_path):
    inventory(spark, random_tree(4)).write.parquet(str(tmp_path / "inv"))
    inv = spark.read.parquet(str(tmp_path / "inv"))
    plan = spark.createDataFrame([("", paths(inv)[5])], "root_id string, full_path string")
    small = att.apply_plan(inv, plan, att.ScanOptions())._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", small)) == 1 + len(re.findall("BroadcastHashJoin", small)) == 2
    assert not re.search("SortMergeJoin|Generate|hashpartitioning", small)
    large = att.apply_plan(inv, plan, att.ScanOptions(broadcast_bytes=0))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", large)) == 1 and "SortMergeJoin" not in large
