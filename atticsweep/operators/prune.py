"""Which entries a scan can see.

A folder is *blocked* when it is a link, hidden or system (options), or has an
excluded name; nothing below a blocked folder is seen. Excluded names show in the
path itself, so they need no join. The other flags are on folder rows: their
subtrees are found once, on folder rows only, and taken away with an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.functions import match, paths
from atticsweep.operators.lookup import KeySet, join_keys, settled
from atticsweep.schema import ScanOptions


def files(inv: DataFrame) -> DataFrame:
    return inv.filter(~F.col("is_directory"))


def folders(inv: DataFrame) -> DataFrame:
    return inv.filter(F.col("is_directory"))


def has_blocking_flag(opts: ScanOptions) -> Column:
    test = F.col("is_reparse_point")
    if opts.skip_hidden:
        test = test | F.col("is_hidden")
    if opts.skip_system:
        test = test | F.col("is_system")
    return test


def is_blocked(opts: ScanOptions) -> Column:
    return has_blocking_flag(opts) | match.name_in(F.col("name"), opts.excluded_folders)


def below_excluded_name(parent_path: Column, depth: Column, opts: ScanOptions) -> Column:
    """Whether a folder between the root and this entry has an excluded name."""
    if not opts.excluded_folders:
        return F.lit(False)
    between = paths.last_segments(F.upper(parent_path), depth - F.lit(1), opts.sep)
    names = "|".join(paths.quote(n.upper()) for n in opts.excluded_folders)
    sep = paths.quote(opts.sep)
    return between.rlike(rf"(?:\A|{sep})(?:{names})(?:{sep}|\z)")


def reachable_by_path(entries: DataFrame, opts: ScanOptions) -> DataFrame:
    """The row-local part of the walk rules: below the root, depth limit, excluded names."""
    depth = F.col("depth")
    out = entries.filter(depth >= 1)
    if opts.max_depth >= 0:
        out = out.filter(depth <= opts.max_depth + 1)
    return out.filter(~below_excluded_name(F.col("parent_path"), depth, opts))


def subtree_keys(inv: DataFrame, marked: DataFrame, opts: ScanOptions) -> DataFrame:
    """(key_root, key_path) of the folders of ``inv`` that are, or are below, a marked folder.

    ``marked`` has key_root and key_path. One folder row becomes one row per level, files
    none. A folder near the root is above all others; adaptive execution splits its key.
    """
    rows = folders(inv).select(
        "root_id",
        opts.key(F.col("full_path")).alias("path_key"),
        "depth",
        F.explode(paths.levels(F.col("depth"))).alias("level"),
    )
    above = paths.ancestor(F.col("path_key"), F.col("depth"), F.col("level"), opts.sep)
    hits = join_keys(
        rows.withColumn("above", above),
        [F.col("root_id"), F.col("above")],
        settled(marked, opts.broadcast_bytes),
        "left_semi",
    )
    return hits.select(F.col("root_id").alias("key_root"), F.col("path_key").alias("key_path"))


def blocked_subtrees(inv: DataFrame, opts: ScanOptions) -> KeySet:
    """Folders that are not entered because of a flag on them or on a folder above."""
    candidates = reachable_by_path(folders(inv), opts)
    marked = candidates.filter(has_blocking_flag(opts)).select(
        F.col("root_id").alias("key_root"), opts.key(F.col("full_path")).alias("key_path")
    )
    return settled(subtree_keys(candidates, marked, opts), opts.broadcast_bytes)


def listed(entries: DataFrame, inv: DataFrame, opts: ScanOptions, blocked: KeySet | None = None) -> DataFrame:
    """The rows of ``entries`` (any part of ``inv``) whose folder is entered.

    Scans filter their candidates first and prune last, so that only candidates
    take part in the join. ``blocked`` saves computing the blocked subtrees again.
    """
    if blocked is None:
        blocked = blocked_subtrees(inv, opts)
    folder = [F.col("root_id"), opts.key(F.col("parent_path"))]
    return join_keys(reachable_by_path(entries, opts), folder, blocked, "left_anti")


def visible(inv: DataFrame, opts: ScanOptions, blocked: KeySet | None = None) -> DataFrame:
    """Everything a walk from the root comes across: files of entered folders, unblocked folders."""
    seen = inv.filter(~F.col("is_directory") | ~is_blocked(opts))
    return listed(seen, inv, opts, blocked)


def visible_files(inv: DataFrame, opts: ScanOptions, blocked: KeySet | None = None) -> DataFrame:
    return listed(files(inv), inv, opts, blocked)
