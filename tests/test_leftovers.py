import random

import pytest
from helpers import entry, inventory

from pyspark.sql import functions as F

import atticsweep as att
from atticsweep.operators import leftovers
from atticsweep.operators.leftovers import without_related_name

PROGRAMS = (
    "hive string, key_name string, display_name string, install_location string, publisher string"
)


def tokens(spark, rows, processes=None):
    programs = spark.createDataFrame(rows, PROGRAMS)
    procs = spark.createDataFrame([(p,) for p in processes], "process_name string") if processes else None
    return {r["token"] for r in att.installed_names(programs, procs).collect()}


def test_installed_names(spark):
    machine = ("HKLM", "{1}", "Foo Bar-2 x", "C:\\Apps\\FooDir\\\\", "Acme Inc")
    assert tokens(spark, [machine]) == {"{1}", "FOO BAR-2 X", "FOOBAR-2X", "FOODIR", "ACME INC", "ACMEINC"}
    assert "LONG" in tokens(spark, [("HKLM", "k", "Long.Name", None, " ")])
    user = ("HKCU", "key", "Foo Bar", "C:\\x\\y", "Pub")
    assert tokens(spark, [user]) == {"KEY", "FOO BAR", "FOOBAR"}
    assert tokens(spark, [("HKLM", "k", "  ", "", None)], ["abc", "abcd"]) == {"K", "ABCD"}


def related(folder, names):
    up = folder.upper()
    return any(
        n == up or (len(n) >= 4 and len(up) >= 4 and (n in up or up in n)) for n in (x.upper() for x in names)
    )


def test_related_names_against_comparing_all(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAB c") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 40])))
    folders = [(r, word()) for r in "xy" for _ in range(150)]
    names = [(r, word()) for r in "xy" for _ in range(12)]
    got = without_related_name(
        spark.createDataFrame(folders, "root_id string, name string"),
        spark.createDataFrame(names, "root_id string, token string"),
    ).collect()
    expected = [(r, f) for r, f in folders if not related(f, [n for root, n in names if root == r])]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert 0 < len(expected) < len(folders)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_orphaned_folders(spark, limit):
    base = "C:\\data\\ProgramData"
    rows = [
        entry("C:\\data"),
        entry(base),
        entry(base + "\\Gone"),
        entry(base + "\\Gone\\sub"),
        entry(base + "\\Gone\\sub\\f", 1000),
        entry(base + "\\Gone\\g", 24),
        entry(base + "\\Gone\\jump", link=True),
        entry(base + "\\Gone\\jump\\h", 5000),
        entry(base + "\\Small"),
        entry(base + "\\Small\\f", 1023),
        entry(base + "\\NUGET"),
        entry(base + "\\NUGET\\f", 9999),
        entry(base + "\\AcmeTool"),
        entry(base + "\\AcmeTool\\f", 9999),
        entry(base + "\\Hid", hidden=True),
        entry(base + "\\Hid\\f", 9999),
        entry("C:\\data\\elsewhere"),
        entry("C:\\data\\elsewhere\\f", 9999),
    ]
    locations = spark.createDataFrame([("", base.upper(), "ProgramData")], "root_id string, path string, label string")
    names = spark.createDataFrame([("", "ACME")], "root_id string, token string")
    opts = att.ScanOptions(broadcast_bytes=limit)
    got = att.orphaned_app_data(inventory(spark, rows), locations, names, opts).collect()
    assert [(r["name"], r["size_bytes"], r["group"], r["is_selected"]) for r in got] == [("Gone", 1024, "ProgramData", False)]


def test_names_that_all_begin_alike(spark):
    """Hundreds of names and folders share a long beginning; they meet on what tells them apart, not on it."""
    folders = [("", f"Common Software Files {i:03d}x") for i in range(300)]
    names = [("", f"COMMON SOFTWARE FILES {i:03d}X TOOLS") for i in range(0, 300, 7)] + [("", f"FILES {i:03d}") for i in range(0, 300, 11)]
    spark_folders = spark.createDataFrame(folders, "root_id string, name string")
    spark_names = spark.createDataFrame(names, "root_id string, token string")
    expected = [(r, f) for r, f in folders if not related(f, [n for _, n in names])]
    for limit in (64 << 20, 0):
        got = without_related_name(spark_folders, spark_names, limit).collect()
        assert sorted(map(tuple, got)) == sorted(expected) and 0 < len(expected) < 300
    inner = spark_folders.select("root_id", F.upper("name").alias("inner"))
    outer = spark_names.select("root_id", F.col("token").alias("outer"))
    asked, met = leftovers.meeting(inner, outer, 64 << 20)
    # A folder may meet a few names that hold its rarest piece, never all that begin like it.
    assert met.count() <= 3 * len(folders) and asked.count() <= len(folders)


def test_names_of_many_lengths_against_comparing_all(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcd") for _ in range(600))
    cut = lambda: text[(at := rng.randrange(550)) : at + rng.choice([3, 4, 5, 8, 9, 31, 32, 33, 300])]
    folders = sorted({("", cut()) for _ in range(120)})
    names = sorted({("", cut()) for _ in range(15)})
    got = without_related_name(spark.createDataFrame(folders, "root_id string, name string"), spark.createDataFrame(names, "root_id string, token string"))
    expected = [(r, f) for r, f in folders if not related(f, [n for _, n in names])]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    none = spark.createDataFrame(names, "root_id string, token string").limit(0)
    assert without_related_name(spark.createDataFrame(folders, "root_id string, name string"), none).count() == len(folders)
