"""Per-folder statistics and empty folders.

Files are summed up per folder before anything else, so a folder with very many
files leaves each task as one row. The aggregates hold fixed-width values only
(no sort-based aggregation); names and times are joined on at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.functions import match, paths
from atticsweep.operators import prune
from atticsweep.operators.lookup import KeySet, join_keys
from atticsweep.registry import scanner, to_results
from atticsweep.schema import ScanOptions

KEYS = ["root_id", "path_key"]


def _keyed_folders(inv: DataFrame, opts: ScanOptions, *columns: str) -> DataFrame:
    return (
        prune.folders(inv)
        .filter(F.col("depth") >= 0)
        .select("root_id", opts.key(F.col("full_path")).alias("path_key"), *columns)
    )


def _folder_facts(inv: DataFrame, opts: ScanOptions, blocked: KeySet | None, folder_rows: DataFrame | None = None) -> DataFrame:
    """One row per entered folder; ``has_row`` is false for one that only shows up as a parent path.

    ``folder_rows`` are the folder rows of ``inv``, where they are a table of their own.
    """
    folder_rows = prune.folders(inv) if folder_rows is None else folder_rows
    is_folder = F.col("is_directory")
    zero = F.lit(0).cast("bigint")
    children = prune.reachable_by_path(inv, opts).select(
        "root_id",
        opts.key(F.col("parent_path")).alias("path_key"),
        (F.col("depth") - F.lit(1)).alias("depth"),
        (~is_folder).cast("bigint").alias("file_count"),
        F.when(~is_folder, F.col("size_bytes")).otherwise(zero).alias("total_size"),
        (~is_folder & ~match.is_ignored(F.col("name"), F.col("size_bytes"), opts)).alias("has_non_ignored"),
        (is_folder & ~prune.is_blocked(opts)).cast("bigint").alias("subfolder_count"),
        (is_folder & prune.is_blocked(opts)).alias("has_blocked"),
        F.lit(False).alias("has_row"),
    )
    rows = folder_rows.filter(F.col("depth") >= 0)
    if opts.max_depth >= 0:
        rows = rows.filter(F.col("depth") <= opts.max_depth)
    hidden_by_name = prune.below_excluded_name(F.col("parent_path"), F.col("depth"), opts)
    rows = rows.filter((F.col("depth") == 0) | ~(prune.is_blocked(opts) | hidden_by_name)).select(
        "root_id",
        opts.key(F.col("full_path")).alias("path_key"),
        "depth",
        zero.alias("file_count"),
        zero.alias("total_size"),
        F.lit(False).alias("has_non_ignored"),
        zero.alias("subfolder_count"),
        F.lit(False).alias("has_blocked"),
        F.lit(True).alias("has_row"),
    )
    facts = (
        children.unionByName(rows)
        .groupBy(*KEYS)
        .agg(
            F.max("depth").alias("depth"),
            F.sum("file_count").alias("file_count"),
            F.sum("total_size").alias("total_size"),
            F.max("has_non_ignored").alias("has_non_ignored"),
            F.sum("subfolder_count").alias("subfolder_count"),
            F.max("has_blocked").alias("has_blocked"),
            F.max("has_row").alias("has_row"),
        )
    )
    if blocked is None:
        blocked = prune.blocked_subtrees(inv, opts)
    return join_keys(facts, [F.col(k) for k in KEYS], blocked, "left_anti")


def folder_stats(inv: DataFrame, opts: ScanOptions, blocked: KeySet | None = None) -> DataFrame:
    """Direct files, their size, whether any counts as content, direct subfolders; the root included."""
    facts = _folder_facts(inv, opts, blocked).filter("has_row").drop("has_row", "has_blocked")
    return (
        _keyed_folders(inv, opts, "full_path", "name")
        .join(facts.hint("merge"), KEYS)
        .select(
            "root_id",
            "full_path",
            "name",
            "depth",
            "file_count",
            "total_size",
            "has_non_ignored",
            "subfolder_count",
        )
    )


@scanner(
    "empty_folders",
    "Folders without content, nested ones included",
    columns=(("Path", "full_path"), ("Modified", "modified"), ("Detail", "detail")),
    order=lambda sep: [paths.segment_count(F.col("full_path"), sep).desc()],
    run=lambda i, o, blocked: empty_folders(i.inventory, o, blocked, i.extra.get("folders")),
)
def empty_folders(
    inv: DataFrame, opts: ScanOptions, blocked: KeySet | None = None, folder_rows: DataFrame | None = None
) -> DataFrame:
    """Folders with no content in them or in any entered folder below.

    Each folder with content marks itself and its ancestors; a folder without a
    mark is empty. ``strict_empty`` also counts subfolders that were not entered.
    """
    occupied = F.col("has_non_ignored")
    if opts.strict_empty:
        occupied = occupied | F.col("has_blocked")
        if opts.max_depth >= 0:
            occupied = occupied | ((F.col("depth") == opts.max_depth) & (F.col("subfolder_count") > 0))
    facts = _folder_facts(inv, opts, blocked, folder_rows).filter(F.col("depth") >= 1)

    # A folder with content marks all levels up to 1, any other folder its own.
    first = F.when(occupied, F.lit(1)).otherwise(F.col("depth"))
    facts = facts.select(
        *KEYS, "depth", occupied.alias("occupied"), "file_count", "has_row",
        F.explode(paths.levels(F.col("depth"), first)).alias("level"),
    ).withColumn("marked", paths.ancestor(F.col("path_key"), F.col("depth"), F.col("level"), opts.sep))
    itself = F.col("marked") == F.col("path_key")
    empty = (
        facts.groupBy("root_id", "marked")
        .agg(
            F.max("occupied").alias("occupied"),
            F.sum(F.when(itself, F.col("file_count")).otherwise(F.lit(0))).alias("file_count"),
            F.max(itself & F.col("has_row")).alias("has_row"),
        )
        .filter(F.col("has_row") & ~F.col("occupied"))
        .select("root_id", F.col("marked").alias("path_key"), "file_count")
    )
    detail = F.when(
        F.col("file_count") > 0, F.concat(F.col("file_count").cast("string"), F.lit(" ignored file(s)"))
    ).otherwise(F.lit("Empty"))
    return to_results(
        _keyed_folders(inv if folder_rows is None else folder_rows, opts, "full_path", "name", "modified").join(empty.hint("merge"), KEYS),
        "empty_folders",
        detail=detail,
        size_bytes=F.lit(0),
        is_directory=F.lit(True),
    )
