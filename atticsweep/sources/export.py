"""Result lists as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.functions.text import format_modified, format_size


def csv_rows(results: DataFrame) -> DataFrame:
    return results.select(
        F.initcap(F.col("is_selected").cast("string")).alias("Selected"),
        F.col("name").alias("Name"),
        F.col("full_path").alias("Path"),
        F.col("size_bytes").alias("Size"),
        format_modified(F.col("modified")).alias("Modified"),
        F.col("detail").alias("Detail"),
        F.col("group").alias("Group"),
    )


def json_rows(results: DataFrame) -> DataFrame:
    return results.select(
        F.col("name").alias("Name"),
        F.col("full_path").alias("FullPath"),
        F.col("size_bytes").alias("SizeBytes"),
        format_size(F.col("size_bytes")).alias("Size"),
        format_modified(F.col("modified")).alias("Modified"),
        F.col("detail").alias("Detail"),
        F.col("group").alias("Group"),
        F.col("is_selected").alias("IsSelected"),
        F.col("is_directory").alias("IsDirectory"),
    )


def export_csv(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All results as CSV part files with a header each; quotes are doubled."""
    csv_rows(results).write.mode(mode).csv(
        path, header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_csv_export(spark, path: str) -> DataFrame:
    """What ``export_csv`` wrote, line breaks inside values included."""
    schema = "Selected string, Name string, Path string, Size bigint, Modified string, Detail string, Group string"
    rows = spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True, nullValue="\0")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c != "Size" else F.col(c) for c in rows.columns])


def export_json(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All results as JSON, one object per line."""
    json_rows(results).write.mode(mode).json(path)
