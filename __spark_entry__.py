"""Entry points: a flagship query, all queries, and their SQL counterparts.

Queries derive their inputs from the given tables (``fixtures.py``) and call the
library; ``oracle.py`` says the same in plain SQL.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import datetime, timezone

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import atticsweep as att
import fixtures
import oracle
from atticsweep import registry
from atticsweep.functions import attributes, match
from atticsweep.operators import prune
from atticsweep.session import scratch_path
from atticsweep.sources import export

try:
    import corpus_pipeline
    from atticsweep.llm import queries as llm_queries
except ImportError:  # the text operators and their pipeline may be left out
    corpus_pipeline = llm_queries = None
else:
    cloudpickle.register_pickle_by_value(corpus_pipeline)

# Executors need not have the package installed.
cloudpickle.register_pickle_by_value(att)

SMOKE_DIR = "/root/testdata/sf0.001"
AS_OF = datetime(2001, 6, 1, tzinfo=timezone.utc)
OPTS = att.ScanOptions(sep="/")
# As for key sets too large to broadcast.
OWN_LISTS = att.ScanOptions(sep="/", excluded_folders=("CUST_7", "cust_12"), ignored_files=("*.TMP", "~*"), ignore_empty_files=False)
LARGE = att.ScanOptions(sep="/", broadcast_bytes=0)


def entry(spark: SparkSession) -> DataFrame:
    """The 100 largest visible files."""
    return big_files(spark, SMOKE_DIR)


# Inputs ---------------------------------------------------------------------


def _inventory(spark: SparkSession, sf_dir: str, name: str, recipe: str, query: str, root: str) -> DataFrame:
    """Recipe rows, stored, taken in as an inventory and stored; scans read that table.

    A listing is a table of its own: taken in right from the recipe, its tests would be
    worked out within the recipe's joins, once more for each, in code too long to be compiled.
    """
    listing = _table(spark, sf_dir, f"{name}-listing", recipe, query)
    return fixtures.stored(spark, sf_dir, name, lambda: att.inventory_from_table(listing, "/", root), spread=False)


def _table(spark: SparkSession, sf_dir: str, name: str, recipe: str, query: str) -> DataFrame:
    return fixtures.stored(spark, sf_dir, name, lambda: fixtures.select(spark, sf_dir, recipe, query))


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir, "files", fixtures.FILES, "SELECT * FROM inv", "/vol")


def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = """SELECT full_path, name, parent_path, is_directory, CAST(octet_length(text) AS BIGINT) AS size_bytes,
                      TIMESTAMP '2020-01-01 00:00:00' + make_interval(0, 0, 0, CAST(age_rank AS INT)) AS modified
               FROM docs"""
    return _inventory(spark, sf_dir, "documents", fixtures.DOCS, query, "/lake")


def document_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.select(spark, sf_dir, fixtures.DOCS, "SELECT '' AS root_id, full_path, text AS content FROM docs")


def app_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir, "apps", fixtures.APPS, "SELECT * FROM app_inv", "/apps")


def app_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = "SELECT DISTINCT '' AS root_id, concat('/apps/', label) AS path, label FROM app_dirs"
    return _table(spark, sf_dir, "locations", fixtures.APPS, query)


def app_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.installed_names(_table(spark, sf_dir, "programs", fixtures.APPS, "SELECT * FROM installed"))


def installed_and_running_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = _table(spark, sf_dir, "programs", fixtures.APPS, "SELECT * FROM installed")
    processes = fixtures.select(spark, sf_dir, fixtures.APPS, "SELECT * FROM running")
    return att.installed_names(programs, processes).select("token")


def long_path_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir, "long-paths", fixtures.LONG_PATHS, "SELECT * FROM longp", "/deep")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "probes", fixtures.FILES, "SELECT * FROM probe")


def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "manifest", fixtures.FILES, "SELECT * FROM manifest")


def fleet(spark: SparkSession, sf_dir: str) -> att.Inputs:
    """All inventories as one, each a root of its own, with everything the scans need."""

    def rooted(df: DataFrame, root_id: str) -> DataFrame:
        return df.withColumn("root_id", F.lit(root_id))

    def all_roots() -> DataFrame:
        return (
            rooted(file_inventory(spark, sf_dir), "vol")
            .unionByName(rooted(document_inventory(spark, sf_dir), "lake"))
            .unionByName(rooted(app_inventory(spark, sf_dir), "apps"))
            .unionByName(rooted(long_path_inventory(spark, sf_dir), "deep"))
        )

    inventory = fixtures.stored(spark, sf_dir, "fleet", all_roots)
    return att.Inputs(
        inventory=inventory,
        as_of=AS_OF,
        contents=rooted(document_contents(spark, sf_dir), "lake"),
        probes=rooted(probes(spark, sf_dir), "vol"),
        members=rooted(archive_manifest(spark, sf_dir), "vol"),
        locations=rooted(app_locations(spark, sf_dir), "apps"),
        names=rooted(app_names(spark, sf_dir), "apps"),
    )


def _run(name: str, spark: SparkSession, sf_dir: str, opts: att.ScanOptions = OPTS, **inputs: DataFrame) -> DataFrame:
    inv = inputs.pop("inventory", None)
    inv = file_inventory(spark, sf_dir) if inv is None else inv
    return att.run_scan(name, att.Inputs(inventory=inv, as_of=AS_OF, **inputs), opts)


def _depth(n: int) -> att.ScanOptions:
    return att.ScanOptions(sep="/", max_depth=n)


# Columns and predicates -----------------------------------------------------


def ingested_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listing records (parent, name, attribute bits, split size and time) taken in as an inventory."""
    records = fixtures.select(
        spark,
        sf_dir,
        fixtures.FILES,
        """SELECT parent_path, name, link_target,
                  CAST(16 * CAST(is_directory AS INT) + 2 * CAST(is_hidden AS INT) + 4 * CAST(is_system AS INT)
                       + 1024 * CAST(is_reparse_point AS INT) AS BIGINT) AS attributes,
                  shiftright(size_bytes * 1000, 32) AS size_hi, (size_bytes * 1000) & 4294967295 AS size_lo,
                  shiftright(ticks, 32) AS time_hi, ticks & 4294967295 AS time_lo
           FROM (SELECT *, CASE WHEN size_bytes = 0 THEN 0L
                           ELSE (unix_micros(modified) + 11644473600000000) * 10 END AS ticks FROM inv)""",
    )
    inv = att.inventory_from_find_records(records, "/", "/vol")
    return inv.withColumn("depth", F.col("depth").cast("bigint"))


def decode_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ("is_directory", 16), ("is_hidden", 2), ("is_system", 4), ("is_reparse_point", 1024)
    bits = sum((F.col(c).cast("bigint") * F.lit(bit) for c, bit in flags), F.lit(0))
    rows = file_inventory(spark, sf_dir).select("full_path", bits.alias("bits"))
    return rows.select("full_path", "bits", attributes.decode_attributes(F.col("bits")).alias("flags")).select(
        "full_path", "bits", "flags.*"
    )


def decode_size_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size_bytes") * F.lit(1000)
    ticks = F.when(size == 0, F.lit(0)).otherwise((F.unix_micros("modified") + F.lit(11644473600000000)) * F.lit(10))
    low = F.lit(0xFFFFFFFF)
    rows = file_inventory(spark, sf_dir).select(
        "full_path",
        F.shiftright(size, 32).alias("size_hi"),
        size.bitwiseAND(low).alias("size_lo"),
        F.shiftright(ticks, 32).alias("time_hi"),
        ticks.bitwiseAND(low).alias("time_lo"),
    )
    return rows.select(
        "full_path",
        att.decode_size(F.col("size_hi"), F.col("size_lo")).alias("size_bytes"),
        att.decode_filetime(F.col("time_hi"), F.col("time_lo")).alias("modified"),
    )


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("full_path")
    return file_inventory(spark, sf_dir).select(
        "full_path",
        att.name_of(path, "/").alias("name"),
        att.parent_of(path, "/").alias("parent_path"),
        att.extension_of(att.name_of(path, "/")).alias("extension"),
        att.depth_of(path, "/", "/vol").cast("bigint").alias("depth"),
    )


def visible_entries(spark: SparkSession, sf_dir: str, opts: att.ScanOptions = OPTS) -> DataFrame:
    return att.visible(file_inventory(spark, sf_dir), opts).select("full_path", "is_directory", "size_bytes")


def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = att.files(file_inventory(spark, sf_dir))
    ignored = att.is_ignored(F.col("name"), F.col("size_bytes"), OPTS)
    return files.filter(ignored).select("full_path", "name", "size_bytes")


def wildcard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = {"tmp": "*.tmp", "order": "order_*", "middle": "*_1*.DAT", "exact": "order_7.dat", "any": "*"}
    return att.files(file_inventory(spark, sf_dir)).select(
        "full_path", "name", *[match.wildcard_match(F.col("name"), p).alias(f"is_{n}") for n, p in patterns.items()]
    )


def result_size_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    opts = att.ScanOptions(sep="/", min_size=500, max_size=2000)
    return att.candidate_files(document_inventory(spark, sf_dir), opts).select("full_path", "size_bytes")


def formatted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all magnitudes: bytes as they are and times 100 and 10,000."""
    rows = att.files(file_inventory(spark, sf_dir)).select(
        "full_path", "modified", F.explode(F.array(*[F.lit(n) for n in (1, 100, 10_000)])).alias("factor"), "size_bytes"
    )
    size = F.col("size_bytes") * F.col("factor")
    return rows.select(
        "full_path",
        size.alias("size_bytes"),
        att.format_size(size).alias("size_text"),
        att.format_modified(F.col("modified")).alias("modified_text"),
    )


# Folders --------------------------------------------------------------------


def folder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.folder_stats(file_inventory(spark, sf_dir), OPTS).withColumn("depth", F.col("depth").cast("bigint"))


def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.folder_rollup(file_inventory(spark, sf_dir), OPTS)


# Scans ----------------------------------------------------------------------


def big_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run("big_files", spark, sf_dir)


def big_files_per_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as a root; the five largest files of each."""
    region = F.get(F.split("full_path", "/"), 2)
    rows = file_inventory(spark, sf_dir).filter(F.col("depth") >= 1).drop("depth").withColumn("root_id", region)
    inv = att.inventory_from_table(rows, "/", F.concat(F.lit("/vol/"), region))
    return att.big_files(inv, OPTS, n=5, per_root=True)


def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(
        "duplicate_files",
        spark,
        sf_dir,
        inventory=document_inventory(spark, sf_dir),
        contents=document_contents(spark, sf_dir),
    )


def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = att.candidate_files(document_inventory(spark, sf_dir), OPTS)
    return att.size_candidates(files).select("full_path", "size_bytes")


def broken_shortcuts_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets written with a variable per region, the variables taken from the region table."""
    inv = file_inventory(spark, sf_dir)
    target = F.regexp_replace("link_target", "^/vol/([A-Z ]+)/", "%root_$1%/")
    query = "SELECT '' AS root_id, concat('ROOT_', r_name) AS name, concat('/vol/', r_name) AS value FROM region"
    env = fixtures.select(spark, sf_dir, "", query)
    return _run("broken_shortcuts", spark, sf_dir, inventory=inv.withColumn("link_target", target), env=env)


def long_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run("long_paths", spark, sf_dir, inventory=long_path_inventory(spark, sf_dir))


def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run("unreadable_files", spark, sf_dir, probes=probes(spark, sf_dir))


def cased_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir, "cased", fixtures.CASES, "SELECT * FROM cased", "/vol")


def big_files_of_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that differ in case only are one entry."""
    return _run("big_files", spark, sf_dir, inventory=cased_inventory(spark, sf_dir))


# The inventories of the queries have the root ''.
BY_CASE = att.ScanOptions(sep="/", case_sensitive_roots=("",))


def deletion_plan_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root in which paths that differ in case are two."""
    results = _run("temp_files", spark, sf_dir, BY_CASE, inventory=cased_inventory(spark, sf_dir))
    return att.deletion_plan(results, "Permanent", BY_CASE)


def inventory_after_plan_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = cased_inventory(spark, sf_dir)
    plan = att.deletion_plan(_run("temp_files", spark, sf_dir, BY_CASE, inventory=inv).filter("name = upper(name)"), opts=BY_CASE)
    return att.apply_plan(inv, plan, BY_CASE).select("full_path", "is_directory", "size_bytes")


def unreadable_files_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with several probes of a file; the last counts."""
    return _run("unreadable_files", spark, sf_dir, probes=_table(spark, sf_dir, "probe-log", fixtures.CASES, "SELECT * FROM probe_log"))


def unpacked_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run("unpacked_archives", spark, sf_dir, members=archive_manifest(spark, sf_dir))


def orphaned_app_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(
        "orphaned_app_data",
        spark,
        sf_dir,
        inventory=app_inventory(spark, sf_dir),
        locations=app_locations(spark, sf_dir),
        names=app_names(spark, sf_dir),
    )


def own_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the user's own beside a built-in one."""

    @att.scanner("dat_files", "Data files")
    def dat_files(inputs: att.Inputs, opts: att.ScanOptions) -> DataFrame:
        rows = prune.visible_files(inputs.inventory, opts).filter(F.lower("name").endswith(".dat"))
        return registry.to_results(rows, "dat_files", detail=F.format_string("Data file of %d bytes", "size_bytes"))

    try:
        return file_results(spark, sf_dir, ("dat_files", "temp_files"))
    finally:
        registry.unregister("dat_files")


# Sources and sinks ----------------------------------------------------------


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fixtures.select(spark, sf_dir, fixtures.NODES, "SELECT * FROM nodes")
    return att.resolve_paths(nodes, "C:", "/").select("frn", "path")


def resolved_odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with most files, cycles, ids that were used again; folders of a hundred files already count as hot."""
    nodes = fixtures.select(spark, sf_dir, fixtures.ODD_NODES, "SELECT * FROM nodes")
    return att.resolve_paths(nodes, "C:", "/", hot=100).select("frn", "path")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.csv_rows(_run("temp_files", spark, sf_dir))


def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export-csv")
    att.export_csv(att.temp_files(file_inventory(spark, sf_dir), OPTS), path)
    return export.read_csv_export(spark, path)


def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export-json")
    att.export_json(att.temp_files(file_inventory(spark, sf_dir), OPTS), path)
    fields = "Name string, FullPath string, SizeBytes bigint, Size string, Modified string, Detail string"
    return spark.read.schema(f"{fields}, Group string, IsSelected boolean, IsDirectory boolean").json(path)


# Result lists and plans -----------------------------------------------------


def fleet_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.scan_all(fleet(spark, sf_dir), OPTS)


def file_results(spark: SparkSession, sf_dir: str, scans: tuple[str, ...]) -> DataFrame:
    return att.scan_all(att.Inputs(inventory=file_inventory(spark, sf_dir), as_of=AS_OF), OPTS, list(scans))


def result_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.filter_text(_run("temp_files", spark, sf_dir), "OFFICE lock")


def result_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.by_parent_folder(_run("temp_files", spark, sf_dir), "/")


def sorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.sort_results(_run("temp_files", spark, sf_dir), "Size", ascending=False)


def displayed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.display(_run("old_files", spark, sf_dir), "old_files")


def scan_all_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.scan_summary(fleet_results(spark, sf_dir))


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.selection_summary(file_results(spark, sf_dir, ("temp_files", "old_files", "empty_folders")))


def inverted_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = file_results(spark, sf_dir, ("temp_files", "old_files"))
    return att.invert(results).select("scanner", "full_path", "is_selected")


def select_all_and_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = file_results(spark, sf_dir, ("temp_files", "old_files"))
    both = att.select_all(results).withColumn("choice", F.lit("all"))
    both = both.unionByName(att.select_none(results).withColumn("choice", F.lit("none")))
    return both.groupBy("choice", "scanner", "is_selected").agg(F.count(F.lit(1)).alias("findings"))


def remaining_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _run("temp_files", spark, sf_dir)
    return att.remove_results(results, results.filter(F.col("detail").startswith("Temp extension")))


PLANNED = ("temp_files", "zero_length_files", "empty_folders")


def deletion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.deletion_plan(file_results(spark, sf_dir, PLANNED), "RecycleBin")


def inventory_after_plan(spark: SparkSession, sf_dir: str, opts: att.ScanOptions = OPTS) -> DataFrame:
    plan = att.deletion_plan(file_results(spark, sf_dir, PLANNED))
    # What is asked for is chosen first: a large plan is swept together with all columns that it is given.
    rows = file_inventory(spark, sf_dir).select("root_id", "full_path", "is_directory", "size_bytes")
    return att.apply_plan(rows, plan, opts).drop("root_id")


def freed_bytes(spark: SparkSession, sf_dir: str, opts: att.ScanOptions = OPTS) -> DataFrame:
    plan = att.deletion_plan(file_results(spark, sf_dir, PLANNED))
    return att.freed_bytes(file_inventory(spark, sf_dir), plan, opts)


# Streaming ------------------------------------------------------------------


def streamed(
    scan: str, inventory: Callable[[SparkSession, str], DataFrame] = file_inventory
) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The inventory written out, read as a stream, scanned, and the findings read back."""
        base = scratch_path(spark, "stream")
        inv = inventory(spark, sf_dir)
        inv.write.parquet(f"{base}/inventory")
        blocked = prune.blocked_subtrees(inv, OPTS)
        stream = spark.readStream.schema(att.INVENTORY_SCHEMA).option("maxFilesPerTrigger", 4).parquet(f"{base}/inventory")
        found = att.stream_scan(stream, scan, OPTS, AS_OF, blocked)
        (
            found.writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{base}/found")
            .option("checkpointLocation", f"{base}/progress")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
        return spark.read.schema(att.RESULT_SCHEMA).parquet(f"{base}/found")

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own_queries() | ({**llm_queries.QUERIES, "pipeline": corpus_pipeline.run} if llm_queries else {})


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "ingested_inventory": ingested_inventory,
        "decode_attributes": decode_attributes,
        "decode_size_time": decode_size_time,
        "path_parts": path_parts,
        "visible_entries": visible_entries,
        "visible_entries_depth2": lambda s, d: visible_entries(s, d, _depth(2)),
        "visible_entries_skip_hidden": lambda s, d: visible_entries(s, d, att.ScanOptions(sep="/", skip_hidden=True)),
        "ignored_files": ignored_files,
        "wildcard_match": wildcard_match,
        "result_size_bounds": result_size_bounds,
        "formatted_rows": formatted_rows,
        "folder_stats": folder_stats,
        "folder_rollup": folder_rollup,
        "empty_folders": lambda s, d: _run("empty_folders", s, d),
        "empty_folders_strict": lambda s, d: _run("empty_folders", s, d, att.ScanOptions(sep="/", strict_empty=True)),
        "empty_folders_own_lists": lambda s, d: _run("empty_folders", s, d, OWN_LISTS),
        "temp_files_own_lists": lambda s, d: _run("temp_files", s, d, OWN_LISTS),
        "empty_folders_depth2": lambda s, d: _run("empty_folders", s, d, _depth(2)),
        "big_files": big_files,
        "big_files_per_root": big_files_per_root,
        "big_files_of_any_case": big_files_of_any_case,
        "duplicate_files": duplicate_files,
        "duplicate_candidates": duplicate_candidates,
        "temp_files": lambda s, d: _run("temp_files", s, d),
        "temp_files_depth3": lambda s, d: _run("temp_files", s, d, _depth(3)),
        "own_scan": own_scan,
        "zero_length_files": lambda s, d: _run("zero_length_files", s, d),
        "old_files": lambda s, d: _run("old_files", s, d),
        "broken_links": lambda s, d: _run("broken_links", s, d),
        "broken_shortcuts": lambda s, d: _run("broken_shortcuts", s, d),
        "broken_shortcuts_env": broken_shortcuts_env,
        "long_paths": long_paths,
        "unreadable_files": unreadable_files,
        "unreadable_files_of_log": unreadable_files_of_log,
        "unpacked_archives": unpacked_archives,
        "installed_names": lambda s, d: app_names(s, d).select("token"),
        "installed_and_running_names": installed_and_running_names,
        "orphaned_app_data": orphaned_app_data,
        "resolved_paths": resolved_paths,
        "resolved_odd_paths": resolved_odd_paths,
        "export_rows": export_rows,
        "exported_csv": exported_csv,
        "exported_json": exported_json,
        "result_filter": result_filter,
        "result_by_folder": result_by_folder,
        "sorted_results": sorted_results,
        "displayed_results": displayed_results,
        "scan_all_summary": scan_all_summary,
        "selection_summary": selection_summary,
        "inverted_selection": inverted_selection,
        "select_all_and_none": select_all_and_none,
        "remaining_results": remaining_results,
        "deletion_plan": deletion_plan,
        "deletion_plan_by_case": deletion_plan_by_case,
        "inventory_after_plan_by_case": inventory_after_plan_by_case,
        "inventory_after_plan": inventory_after_plan,
        "inventory_after_large_plan": lambda s, d: inventory_after_plan(s, d, LARGE),
        "freed_bytes": freed_bytes,
        "freed_bytes_of_large_plan": lambda s, d: freed_bytes(s, d, LARGE),
        "streamed_temp_files": streamed("temp_files"),
        "streamed_old_files": streamed("old_files"),
        "streamed_zero_length_files": streamed("zero_length_files"),
        "streamed_long_paths": streamed("long_paths", long_path_inventory),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | (llm_queries.ORACLE_SQL if llm_queries else {})
