"""What the queries over large inventories read, keep and compute."""

import __spark_entry__ as queries
import fixtures
from helpers import entry, inventory
from pyspark.sql import functions as F

import atticsweep as att
from atticsweep.operators import rowlocal


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_listings_are_taken_in_from_a_table(spark, monkeypatch):
    """Taken in from the recipe itself, the tests of each row are part of the recipe's joins."""
    plans = {}
    stored = fixtures.stored

    def watched(spark, sf_dir, name, build, **settings):
        plans[name] = plan_of(build())
        return stored(spark, sf_dir, name, build, **settings)

    monkeypatch.setattr(fixtures, "stored", watched)
    queries.file_inventory(spark, queries.SMOKE_DIR)
    assert "Join" not in plans["files"] and "Union" not in plans["files"]


def test_names_are_temporary_when_there_is_a_reason(spark):
    parts = [*rowlocal.TEMP_EXTENSIONS, *[n for n, _ in rowlocal.TEMP_NAMES], *[b for b, _ in rowlocal.TEMP_BEGINNINGS]]
    names = [f(p) for p in parts for f in (str, str.upper, lambda p: f"a{p}", lambda p: f"{p}a", lambda p: f"a{p}\n", lambda p: f"{p}.x", lambda p: f"x.{p}")]
    rows = spark.createDataFrame([(n,) for n in [*names, "", ".", "ß.tmp", "a.~", "atmp", None]], "name string")
    differ = rows.filter(F.coalesce(rowlocal.is_temp_name(F.col("name")), F.lit(False)) != rowlocal.temp_reason(F.col("name")).isNotNull())
    assert differ.count() == 0


def test_a_summary_does_not_work_out_details(spark):
    rows = [entry("C:\\data"), entry("C:\\data\\a.tmp", 0), entry("C:\\data\\b.txt", 5)]
    opts = att.ScanOptions()
    found = att.scan_all(att.Inputs(inventory(spark, rows)), opts, ["temp_files", "zero_length_files"])
    assert sorted((r["scanner"], r["detail"]) for r in found.collect()) == [("temp_files", "Temp extension (.tmp)"), ("zero_length_files", ".tmp")]
    files = found.inputFiles()
    assert dict(spark.read.parquet(*files).dtypes)["hits"] == "array<int>"


def test_a_large_plan_moves_the_columns_asked_for(spark):
    after = queries.inventory_after_plan(spark, queries.SMOKE_DIR, queries.LARGE)
    kept = spark.read.parquet(*after.inputFiles()).columns
    assert {"full_path", "is_directory", "size_bytes"} <= set(kept) and not {"modified", "link_target", "name"} & set(kept)
