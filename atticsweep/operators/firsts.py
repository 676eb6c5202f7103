"""One row of each key: the one with the smallest or the largest number.

The number comes out of a hash aggregation, which holds fixed-width values only and adds
up before rows are exchanged. Only keys that occur more than once are looked at again,
and among their rows only those with that number; ties go by an order over columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atticsweep.operators.lookup import join_keys, settled


def one_of_each(rows: DataFrame, keys: list[str], number: str, ties: list[Column], limit_bytes: int, last: bool = False) -> DataFrame:
    """``rows`` (written already, as they are read twice) with one row a key: that with the smallest ``number``, or the largest.

    ``number`` is a column without nulls. Keys that occur twice are a key set of their own,
    measured; a key with very many rows is narrowed down before they are exchanged.
    """
    best = F.max(number) if last else F.min(number)
    seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_key"), best.alias("key_number"))
    names = [F.col(k).alias(f"key_{k}") for k in keys]
    several = settled(seen.filter(F.col("rows_of_key") > 1).select(*names, "key_number"), limit_bytes)
    if several.empty:
        return rows
    own = [F.col(k) for k in keys]
    once = join_keys(rows, own, several.select(*[f"key_{k}" for k in keys]), "left_anti")
    tied = join_keys(rows, [*own, F.col(number)], several, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*ties))
    return once.unionByName(tied.withColumn("place_in_key", place).filter(F.col("place_in_key") == 1).drop("place_in_key"))
