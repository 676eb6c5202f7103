"""Sizes and times as the text that result lists show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


def format_size(size: Column) -> Column:
    """Base 1024: ``n B``, one decimal for KB and MB, two for GB, '' below zero."""
    return (
        F.when(size < 0, F.lit(""))
        .when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < MIB, F.format_string("%.1f KB", size / F.lit(float(KIB))))
        .when(size < GIB, F.format_string("%.1f MB", size / F.lit(float(MIB))))
        .otherwise(F.format_string("%.2f GB", size / F.lit(float(GIB))))
    )


def format_modified(modified: Column) -> Column:
    return F.coalesce(F.date_format(modified, "yyyy-MM-dd HH:mm"), F.lit(""))
