"""Joins against key sets: broadcast when measured small, by a sort-merge join otherwise.

A key set is written once and its rows are measured; no planner estimate takes part,
as that is made of compressed file sizes. A large key set carries a merge hint, so
that neither the planner nor adaptive execution broadcasts it after all; hot keys on
the other side are split by adaptive execution.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atticsweep.session import written

ROW_OVERHEAD = 16
# A key with this many rows gets a way of its own.
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class KeySet:
    """One side of a join, whether it may be broadcast, and whether it is known to have no rows."""

    df: DataFrame
    small: bool
    empty: bool = False

    def select(self, *columns) -> KeySet:
        return KeySet(self.df.select(*columns), self.small, self.empty)

    def hinted(self) -> DataFrame:
        return F.broadcast(self.df) if self.small else self.df.hint("merge")


def _measured(df: DataFrame) -> int:
    widths = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, T.StringType) else F.lit(8)
        for f in df.schema.fields
    ]
    width = reduce(Column.__add__, widths, F.lit(ROW_OVERHEAD)).cast("bigint")
    return df.agg(F.sum(width)).first()[0] or 0


def settled(df: DataFrame, limit_bytes: int) -> KeySet:
    """``df``, written once, with the answer to whether it is at most this large."""
    df = written(df)
    size = _measured(df)
    return KeySet(df, 0 < limit_bytes and size <= limit_bytes, size == 0)


def join_keys(left: DataFrame, left_keys: list[Column], keys: KeySet, how: str) -> DataFrame:
    """Join on all columns of ``keys`` named like ``key_*`` in order; those columns go away."""
    right = keys.hinted()
    names = [c for c in right.columns if c.startswith("key_")]
    same = [a == F.col(b) for a, b in zip(left_keys, names, strict=True)]
    return left.join(right, reduce(Column.__and__, same), how).drop(*names)


def existing_keys(wanted: DataFrame, present: DataFrame, limit_bytes: int, *facts: str) -> KeySet:
    """The distinct ``wanted`` (root_id, path_key) that ``present`` also has, as (key_root, key_path), with its ``facts``.

    ``present`` is usually a whole inventory. While the wanted keys are few they
    travel to it, so it is read once and not shuffled.
    """
    keys = ["root_id", "path_key"]
    asked = settled(wanted.select(*keys).distinct(), limit_bytes)
    if asked.small:
        found = present.select(*keys, *facts).join(asked.hinted(), keys, "left_semi").distinct()
    elif facts:
        found = present.select(*keys, *facts).join(asked.hinted(), keys).distinct()
    else:
        found = asked.df.join(present.select(*keys).hint("merge"), keys, "left_semi")
    return KeySet(found.select(F.col("root_id").alias("key_root"), F.col("path_key").alias("key_path"), *facts), asked.small)


def join_hot(
    left: DataFrame, left_keys: list[Column], right: DataFrame, how: str, limit_bytes: int, hot: int = HOT_ROWS
) -> DataFrame:
    """Join with ``right`` (one row a key, columns key_* and others) where few keys may hold most of the ``left`` rows.

    Keys of at least ``hot`` left rows are counted, so there are at most left / ``hot``.
    Their right rows are broadcast, if measured small, and their left rows do not move;
    all other keys meet by a sort-merge join.
    """
    names = [c for c in right.columns if c.startswith("key_")]

    def met(rows: DataFrame, to: DataFrame, way: str = how) -> DataFrame:
        same = [a == F.col(b) for a, b in zip(left_keys, names, strict=True)]
        return rows.join(to, reduce(Column.__and__, same), way).drop(*names)

    if left.count() < hot:
        return met(left, right.hint("merge"))
    counted = left.groupBy(*[k.alias(n) for k, n in zip(left_keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    keys = settled(counted.filter(F.col("n") >= hot).select(*names).dropna(), limit_bytes)
    if not keys.small or keys.empty:
        return met(left, right.hint("merge"))
    there = settled(right.join(keys.hinted(), names, "left_semi").select(*right.columns), limit_bytes)
    if not there.small:
        return met(left, right.hint("merge"))
    same = [a == F.col(b) for a, b in zip(left_keys, names, strict=True)]
    mine = reduce(Column.__and__, same)
    rest = left.join(keys.hinted(), mine, "left_anti")
    return met(left.join(keys.hinted(), mine, "left_semi"), there.hinted()).unionByName(met(rest, right.hint("merge")))
