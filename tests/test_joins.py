"""No join of the library is left to the planner's estimate of compressed files: each has a hint, set by a measure."""

import re
from datetime import datetime

import pytest
from helpers import entry, inventory, random_tree
from pyspark.sql import DataFrameWriter

import atticsweep as att
from atticsweep.sources import idtree


def unhinted(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bJoin \w+", line) and "strategy=" not in line]


@pytest.fixture
def plans(monkeypatch):
    """Unhinted joins of every table that is written on the way."""
    found, real = [], DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        found.extend(unhinted(self._df))
        return real(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    return found


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_every_join_is_measured(spark, tmp_path, plans, limit):
    opts = att.ScanOptions(broadcast_bytes=limit)
    rows = random_tree(5, 60) + [
        entry("C:\\data\\ProgramData"), entry("C:\\data\\ProgramData\\Gone"), entry("C:\\data\\ProgramData\\Gone\\f", 5000),
        entry("C:\\data\\x.lnk", 1, target="%HOME%\\gone"), entry("C:\\data\\y", 0, link=True, target="C:\\no"),
        entry("C:\\data\\p.zip", 5), entry("C:\\data\\p"), entry("C:\\data\\p\\m", 5), entry("C:\\data\\c1", 3), entry("C:\\data\\c2", 3),
    ]
    inventory(spark, rows).write.parquet(str(tmp_path / "inv"))
    plans.clear()
    inv = spark.read.parquet(str(tmp_path / "inv"))
    paths = "root_id string, full_path string, "
    inputs = att.Inputs(
        inv,
        as_of=datetime(2024, 1, 1),
        contents=spark.createDataFrame([("", f"C:\\data\\c{i}", b"abc") for i in (1, 2)], paths + "content binary"),
        probes=spark.createDataFrame([("", "C:\\data\\c1", "io", 5, None)] * 2, paths + "outcome string, hresult int, exception_name string"),
        members=spark.createDataFrame([("", "C:\\data\\p.zip", "m")], "root_id string, archive_path string, entry_name string"),
        env=spark.createDataFrame([("", "home", "C:\\data")], "root_id string, name string, value string"),
        locations=spark.createDataFrame([("", "C:\\data\\ProgramData", "ProgramData")], "root_id string, path string, label string"),
        names=spark.createDataFrame([("", "SOMETHING")], "root_id string, token string"),
    )
    found = att.scan_all(inputs, opts)
    assert {r.scanner for r in found.select("scanner").distinct().collect()} >= {"duplicate_files", "orphaned_app_data", "unpacked_archives"}
    results = [found, att.folder_stats(inv, opts), att.folder_rollup(inv, opts), att.visible(inv, opts), att.remove_results(found, found.limit(2), limit)]
    results += [att.run_scan(s, inputs, opts, ordered=False) for s in ("broken_links", "broken_shortcuts", "unpacked_archives", "temp_files")]
    plan = att.deletion_plan(att.temp_files(inv, opts), opts=opts)
    results += [att.apply_plan(inv, plan, opts), att.freed_bytes(inv, plan, opts)]
    nodes = spark.createDataFrame([(9, 5, "t"), (10, 9, "d"), (11, 10, "f"), (11, 10, "g")], "frn bigint, parent_frn bigint, name string")
    results.append(idtree.resolve_paths(nodes, "C:", hot=2, limit_bytes=limit))
    for df in results:
        plans.extend(unhinted(df))
    assert plans == []
