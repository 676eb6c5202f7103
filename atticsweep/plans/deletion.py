"""What to delete, in which order, and what that would leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.functions import paths
from atticsweep.operators import intervals
from atticsweep.schema import DELETE_MODES, SIMULATE, ScanOptions


def deletion_plan(results: DataFrame, mode: str = SIMULATE, opts: ScanOptions = ScanOptions()) -> DataFrame:
    """The selected paths once each, longest first, so that contents come before their folder.

    A path found by several scans names them all. In a case-sensitive root (``opts``) paths that
    differ by case are two.
    """
    if mode not in DELETE_MODES:
        raise ValueError(f"mode is one of {', '.join(DELETE_MODES)}")
    return (
        results.filter("is_selected")
        .groupBy("root_id", opts.key(F.col("full_path")).alias("path_key"))
        .agg(
            F.min("full_path").alias("full_path"),
            F.max("is_directory").alias("is_directory"),
            F.max("size_bytes").alias("size_bytes"),
            F.array_join(F.sort_array(F.collect_set("scanner")), ",").alias("scanners"),
        )
        .select(
            F.lit(mode).alias("mode"),
            "root_id",
            "full_path",
            "is_directory",
            "size_bytes",
            "scanners",
            paths.utf16_length(F.col("full_path")).alias("path_length"),
        )
        .orderBy(F.col("path_length").desc(), "root_id", "full_path")
    )


def apply_plan(inv: DataFrame, plan: DataFrame, opts: ScanOptions) -> DataFrame:
    """The inventory as it would be after the plan; deleting a folder takes all below it along."""
    marked = intervals.mark_subtrees(inv, plan, opts)
    return marked.filter(~F.col("marked")).drop("marked")


def freed_bytes(inv: DataFrame, plan: DataFrame, opts: ScanOptions) -> DataFrame:
    """Files, folders and bytes the plan removes per root, each entry counted once."""
    rows = inv.select("root_id", "full_path", "is_directory", "size_bytes")
    return (
        intervals.mark_subtrees(rows, plan, opts)
        .filter("marked")
        .groupBy("root_id")
        .agg(
            F.count_if(~F.col("is_directory")).alias("files"),
            F.count_if(F.col("is_directory")).alias("folders"),
            F.sum(F.when(F.col("is_directory"), F.lit(0)).otherwise(F.col("size_bytes"))).alias("freed_bytes"),
        )
    )
