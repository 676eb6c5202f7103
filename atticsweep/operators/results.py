"""Working with result lists: filters, summaries, orders, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.functions import paths
from atticsweep.functions.text import format_modified, format_size
from atticsweep.operators.lookup import join_keys, settled
from atticsweep.registry import SCANNERS
from atticsweep.schema import ScanOptions

ROW_KEYS = ["scanner", "root_id", "full_path"]


def filter_text(results: DataFrame, text: str) -> DataFrame:
    """Rows with the text in name, path or detail, any case; all rows for a blank text."""
    if not text or not text.strip():
        return results
    wanted = F.upper(F.lit(text))
    hit = F.lit(False)
    for column in ("name", "full_path", "detail"):
        hit = hit | F.contains(F.upper(column), wanted)
    return results.filter(hit)


def selection_summary(results: DataFrame) -> DataFrame:
    """Number and bytes of the selected rows per scan."""
    chosen = F.col("is_selected")
    return results.groupBy("scanner").agg(
        F.count_if(chosen).alias("selected_count"),
        F.sum(F.when(chosen, F.col("size_bytes")).otherwise(F.lit(0))).alias("selected_bytes"),
    )


def scan_summary(results: DataFrame) -> DataFrame:
    """Findings and bytes per scan; for duplicates also what deleting the selected copies frees, and the groups."""
    is_copy = F.col("scanner") == "duplicate_files"
    chosen = is_copy & F.col("is_selected")
    # Groups are counted through the distinct group names; each task passes a name on once.
    per_group = results.groupBy("scanner", "root_id", F.when(is_copy, F.col("group")).alias("copy_group")).agg(
        F.count(F.lit(1)).alias("findings"),
        F.sum("size_bytes").alias("total_bytes"),
        F.count_if(chosen).alias("recoverable_files"),
        F.sum(F.when(chosen, F.col("size_bytes")).otherwise(F.lit(0))).alias("recoverable_bytes"),
    )
    return per_group.groupBy("scanner").agg(
        F.sum("findings").alias("findings"),
        F.sum("total_bytes").alias("total_bytes"),
        F.sum("recoverable_files").alias("recoverable_files"),
        F.sum("recoverable_bytes").alias("recoverable_bytes"),
        F.count("copy_group").alias("duplicate_groups"),
    )


def by_parent_folder(results: DataFrame, sep: str = "\\") -> DataFrame:
    """Findings and bytes per scan and folder."""
    return results.groupBy(
        "scanner", "root_id", paths.parent_of(F.col("full_path"), sep).alias("parent_folder")
    ).agg(F.count(F.lit(1)).alias("findings"), F.sum("size_bytes").alias("total_bytes"))


def sort_results(results: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Order by a displayed column: Size by bytes, Modified by time, all others as text.

    ``column`` is a header of any scan (such as Name, Path, Size, Age) or a result column.
    """
    headers = {"Selected": "is_selected", "Detail": "detail", "Group": "group"}
    for spec in SCANNERS.values():
        headers.update(spec.columns)
    field = headers.get(column, column)
    key = F.col(f"`{field}`") if field in ("size_bytes", "modified", "is_selected") else F.upper(f"`{field}`")
    return results.orderBy(key.asc() if ascending else key.desc(), *ROW_KEYS)


def display(results: DataFrame, scanner: str) -> DataFrame:
    """The columns a scan shows, under its headers, with sizes and times as text."""
    shown = {"size_bytes": format_size(F.col("size_bytes")), "modified": format_modified(F.col("modified"))}
    rows = results.filter(F.col("scanner") == scanner)
    return rows.select(
        *[shown.get(field, F.col(f"`{field}`")).alias(header) for header, field in SCANNERS[scanner].columns]
    )


def remove_results(results: DataFrame, rows: DataFrame, limit_bytes: int = ScanOptions.broadcast_bytes) -> DataFrame:
    """Results without the given rows (scanner, root_id, full_path)."""
    gone = settled(rows.select(*[F.col(k).alias(f"key_{k}") for k in ROW_KEYS]).distinct(), limit_bytes)
    return join_keys(results, [F.col(k) for k in ROW_KEYS], gone, "left_anti")


def _with_selection(results: DataFrame, selected: Column) -> DataFrame:
    return results.withColumn("is_selected", selected)


def select_all(results: DataFrame) -> DataFrame:
    return _with_selection(results, F.lit(True))


def select_none(results: DataFrame) -> DataFrame:
    return _with_selection(results, F.lit(False))


def invert(results: DataFrame) -> DataFrame:
    return _with_selection(results, ~F.col("is_selected"))
