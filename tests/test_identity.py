"""How paths compare, and one row of each key."""

from datetime import datetime

import pytest
from helpers import entry, inventory, paths
from pyspark.sql import functions as F

import atticsweep as att
from atticsweep.operators.firsts import one_of_each
from atticsweep.operators.lookup import join_hot
from atticsweep.session import written

BOTH = [entry("C:\\data"), entry("C:\\data\\Logs"), entry("C:\\data\\logs"), entry("C:\\data\\Logs\\a.tmp", 5), entry("C:\\data\\logs\\A.TMP", 5),
        entry("C:\\data\\logs\\keep", 3)]


def by_root(spark):
    """The same tree in a root that tells case apart, and in one that does not."""
    inv = inventory(spark, BOTH)
    return inv.withColumn("root_id", F.lit("posix")).unionByName(inv.withColumn("root_id", F.lit("ntfs")))


OPTS = att.ScanOptions(case_sensitive_roots=("posix",))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_plans_by_root(spark, limit):
    opts = att.ScanOptions(case_sensitive_roots=("posix",), broadcast_bytes=limit)
    inv = by_root(spark)
    found = att.temp_files(inv, opts)
    plan = att.deletion_plan(found, opts=opts)
    assert sorted((r.root_id, r.full_path.upper()) for r in plan.collect()) == [
        ("ntfs", "C:\\DATA\\LOGS\\A.TMP"), ("posix", "C:\\DATA\\LOGS\\A.TMP"), ("posix", "C:\\DATA\\LOGS\\A.TMP"),
    ]
    one = spark.createDataFrame([("posix", "C:\\data\\Logs"), ("ntfs", "c:\\DATA\\logs\\a.tmp")], "root_id string, full_path string")
    left = {(r.root_id, r.full_path) for r in att.apply_plan(inv, one, opts).collect()}
    assert left == {("posix", p) for p in ("C:\\data", "C:\\data\\logs", "C:\\data\\logs\\A.TMP", "C:\\data\\logs\\keep")} | {
        ("ntfs", p) for p in ("C:\\data", "C:\\data\\Logs", "C:\\data\\logs", "C:\\data\\logs\\keep")
    }
    every = att.ScanOptions(case_sensitive_roots=("*",))
    assert att.deletion_plan(found, opts=every).count() == 4 and att.deletion_plan(found).count() == 2


def test_scans_by_root(spark):
    rows = [entry("C:\\data"), entry("C:\\data\\Sub"), entry("C:\\data\\Sub\\x", 3), entry("C:\\data\\sub"), entry("C:\\data\\l", 0, link=True, target="c:\\DATA\\Sub\\X")]
    inv = inventory(spark, rows)
    assert paths(att.empty_folders(inv, att.ScanOptions())) == []
    assert paths(att.empty_folders(inv, att.ScanOptions(case_sensitive_roots=("",)))) == ["C:\\data\\sub"]
    assert att.broken_links(inv, att.ScanOptions()).count() == 0
    assert att.broken_links(inv, att.ScanOptions(case_sensitive_roots=("",))).count() == 1
    sizes = {r.folder: r.size_bytes for r in att.folder_rollup(inv, att.ScanOptions(case_sensitive_roots=("",))).collect()}
    assert sizes == {"C:\\data": 3, "C:\\data\\Sub": 3, "C:\\data\\sub": 0}


def test_largest_entries_collapse(spark):
    rows = [entry(f"C:\\data\\f{i:03d}", i // 3) for i in range(300)]
    rows += [entry(r[0].upper(), r[5]) for r in rows] + rows  # in another case, and once more
    rows += [entry("C:\\data\\f299", 1)]  # another size is another entry
    inv = inventory(spark, rows).repartition(5)
    want = sorted({(size, path.upper()) for path, _, _, _, _, size, *_ in rows}, reverse=True)
    for n in (1, 50, 280, 1000):
        got = [(r.size_bytes, r.full_path.upper()) for r in att.run_scan("big_files", att.Inputs(inv), att.ScanOptions()).collect()] if n == 100 else [
            (r.size_bytes, r.full_path.upper()) for r in att.big_files(inv, att.ScanOptions(), n=n).collect()
        ]
        assert sorted(got, reverse=True) == want[:n]
        each = [(r.size_bytes, r.full_path.upper()) for r in att.big_files(inv, att.ScanOptions(), n=n, per_root=True).collect()]
        assert sorted(each, reverse=True) == want[:n]
    exact = att.big_files(inv, att.ScanOptions(case_sensitive_roots=("*",)), n=1000)
    assert exact.count() == 601 and {r.full_path for r in att.big_files(inv, att.ScanOptions(), n=1).collect()} == {"C:\\data\\f299"}
    assert att.big_files(inv.limit(0), att.ScanOptions()).count() == 0


def test_the_last_probe_counts(spark):
    inv = inventory(spark, [entry(f"C:\\data\\{c}", 1) for c in "abcde"])
    log = [
        ("C:\\data\\a", "unauthorized", None, None, datetime(2024, 1, 1)), ("c:\\DATA\\A", "opened", None, None, datetime(2024, 1, 2)),
        ("C:\\data\\b", "opened", None, None, datetime(2024, 1, 1)), ("C:\\data\\b", "other", None, "Zed", datetime(2024, 1, 3)),
        ("C:\\data\\b", "other", None, "Abc", datetime(2024, 1, 3)), ("C:\\data\\b", "opened", None, None, datetime(2024, 1, 3)),
        ("C:\\data\\c", "unauthorized", None, None, None), ("C:\\data\\c", "io", 5, None, datetime(1950, 1, 1)),
        ("C:\\data\\d", "opened", None, None, None), ("C:\\data\\gone", "unauthorized", None, None, None),
    ]
    probes = spark.createDataFrame(log * 2, "full_path string, outcome string, hresult int, exception_name string, probed_at timestamp")
    got = sorted((r.name, r.detail) for r in att.unreadable_files(inv, probes, att.ScanOptions()).collect())
    assert got == [("b", "Abc"), ("c", "I/O error (0x00000005)")]
    untimed = sorted((r.name, r.detail) for r in att.unreadable_files(inv, probes.drop("probed_at"), att.ScanOptions()).collect())
    assert untimed == [("a", "Access denied"), ("b", "Abc"), ("c", "Access denied")]
    assert att.unreadable_files(inv, probes.limit(0), att.ScanOptions()).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_one_row_of_each_key(spark, limit):
    rows = written(spark.createDataFrame([("a", 1, "x"), ("a", 2, "z"), ("a", 2, "y"), ("b", 5, "q")] * 3, "k string, n bigint, t string"))
    first = sorted(map(tuple, one_of_each(rows, ["k"], "n", [F.col("t")], limit).collect()))
    last = sorted(map(tuple, one_of_each(rows, ["k"], "n", [F.col("t")], limit, last=True).collect()))
    assert first == [("a", 1, "x"), ("b", 5, "q")] and last == [("a", 2, "y"), ("b", 5, "q")]
    plan = one_of_each(rows, ["k"], "n", [F.col("t")], limit)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_join_as_others(spark, how, limit):
    left = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(200)] + [(7, 1)], "a bigint, i bigint")
    right = spark.createDataFrame([(0, "zero"), (1, "one"), (9, "nine")], "key_a bigint, w string")
    plain = left.join(right, F.col("a") == F.col("key_a"), how).drop("key_a")
    for hot in (10, 10_000):
        got = join_hot(left, [F.col("a")], right, how, limit, hot)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
