from datetime import datetime

import pytest
from helpers import entry, inventory, paths, random_tree
from pyspark.sql import functions as F

import atticsweep as att
from atticsweep.operators import prune

OPTS = att.ScanOptions()


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("temp_files", "", "C:\\d\\a.tmp", "a.tmp", 5, datetime(2020, 1, 2), "", "Temp extension (.tmp)", False, True),
        ("temp_files", "", "C:\\d\\B.bak", "B.bak", 30, datetime(2020, 1, 1), "", "Temp extension (.bak)", False, False),
        ("old_files", "", "C:\\e\\a.tmp", "a.tmp", 7, None, "", "2.0 years", False, True),
        ("duplicate_files", "", "C:\\e\\x", "x", 4, None, "Group 1", "ab...", False, False),
        ("duplicate_files", "", "C:\\e\\y", "y", 4, None, "Group 1", "ab...", False, True),
        ("duplicate_files", "r", "C:\\e\\y", "y", 6, None, "Group 1", "cd...", False, True),
    ]
    return spark.createDataFrame(rows, att.RESULT_SCHEMA).cache()


def test_text_filter(found):
    assert att.filter_text(found, "  ").count() == 6
    assert paths(att.filter_text(found, "BAK")) == ["C:\\d\\B.bak"]
    assert paths(att.filter_text(found, "years")) == ["C:\\e\\a.tmp"]
    assert att.filter_text(found, "c:\\E").count() == 4
    assert att.filter_text(found, "%").count() == 0


def test_summaries(found):
    selected = {r["scanner"]: tuple(r)[1:] for r in att.selection_summary(found).collect()}
    assert selected == {"temp_files": (1, 5), "old_files": (1, 7), "duplicate_files": (2, 10)}
    scans = {r["scanner"]: tuple(r)[1:] for r in att.scan_summary(found).collect()}
    assert scans == {"temp_files": (2, 35, 0, 0, 0), "old_files": (1, 7, 0, 0, 0), "duplicate_files": (3, 14, 2, 10, 2)}
    folders = {tuple(r)[:3]: tuple(r)[3:] for r in att.by_parent_folder(found).collect()}
    assert folders[("temp_files", "", "C:\\d")] == (2, 35) and folders[("duplicate_files", "r", "C:\\e")] == (1, 6)


def test_sorting(found):
    temp = found.filter("scanner = 'temp_files'")
    names = lambda column, up: [r["name"] for r in att.sort_results(temp, column, up).collect()]
    assert names("Size", True) == ["a.tmp", "B.bak"] and names("Size", False) == ["B.bak", "a.tmp"]
    assert names("Modified", True) == ["B.bak", "a.tmp"]
    assert names("Name", True) == ["a.tmp", "B.bak"] and names("Type", True) == ["B.bak", "a.tmp"]


def test_display(found):
    shown = att.display(found, "temp_files").orderBy("Name").collect()
    assert shown[1].asDict() == {
        "Name": "a.tmp", "Path": "C:\\d\\a.tmp", "Size": "5 B", "Type": "Temp extension (.tmp)", "Modified": "2020-01-02 00:00",
    }


def test_selection_and_removal(found):
    flags = lambda df: [r["is_selected"] for r in df.orderBy("scanner", "root_id", "full_path").collect()]
    assert flags(att.select_all(found)) == [True] * 6 and flags(att.select_none(found)) == [False] * 6
    assert flags(att.invert(found)) == [not f for f in flags(found)]
    left = att.remove_results(found, found.filter("scanner = 'duplicate_files' AND root_id = 'r'"))
    assert left.count() == 5 and left.columns == found.columns


def test_deletion_plan(found):
    with pytest.raises(ValueError):
        att.deletion_plan(found, "Shred")
    twice = found.unionByName(found.filter("scanner = 'old_files'").withColumn("scanner", F.lit("temp_files")))
    plan = att.deletion_plan(twice, "Permanent").collect()
    assert [(r["root_id"], r["full_path"], r["scanners"]) for r in plan] == [
        ("", "C:\\d\\a.tmp", "temp_files"),
        ("", "C:\\e\\a.tmp", "old_files,temp_files"),
        ("", "C:\\e\\y", "duplicate_files"),
        ("r", "C:\\e\\y", "duplicate_files"),
    ]
    assert {r["mode"] for r in plan} == {"Permanent"}


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("seed", [6, 7])
def test_simulated_deletion(spark, seed, limit):
    opts = att.ScanOptions(broadcast_bytes=limit)
    rows = random_tree(seed)
    inv = inventory(spark, rows)
    picked = [r[0] for i, r in enumerate(rows) if i and i % 9 == 0]
    plan = spark.createDataFrame([("", p.lower()) for p in picked], "root_id string, full_path string")
    gone = {r[0] for r in rows if any(r[0] == p or r[0].startswith(p + "\\") for p in picked)}
    assert paths(att.apply_plan(inv, plan, opts)) == sorted(r[0] for r in rows if r[0] not in gone)
    freed = att.freed_bytes(inv, plan, opts).collect()[0]
    assert freed["freed_bytes"] == sum(r[5] for r in rows if r[0] in gone)
    assert freed["files"] + freed["folders"] == len(gone)


@pytest.mark.parametrize("scan", ["temp_files", "zero_length_files", "old_files", "long_paths"])
def test_stream_equals_batch(spark, tmp_path, scan):
    as_of = datetime(2021, 6, 1)
    rows = random_tree(8)
    rows.append(entry("C:\\data\\" + "l" * 300, 4, modified=datetime(2001, 1, 1)))
    inv = inventory(spark, rows)
    blocked = prune.blocked_subtrees(inv, OPTS)
    inv.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(att.INVENTORY_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        att.stream_scan(stream, scan, OPTS, as_of, blocked).writeStream.outputMode("append").format("memory").queryName(f"out_{scan}")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = att.run_scan(scan, att.Inputs(inv, as_of=as_of), OPTS)
    assert sorted(map(str, spark.table(f"out_{scan}").collect())) == sorted(map(str, batch.collect()))
    assert batch.count() > 0


def test_other_scans_refuse_streams(spark, tmp_path):
    inventory(spark, [entry("C:\\data\\a", 1)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(att.INVENTORY_SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        att.stream_scan(stream, "duplicate_files", OPTS)
    with pytest.raises(ValueError):
        att.stream_scan(stream, "old_files", OPTS)
