"""Paths from a table of ids and parent ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.operators.firsts import one_of_each
from atticsweep.operators.lookup import HOT_ROWS, join_hot, join_keys, settled
from atticsweep.schema import ScanOptions
from atticsweep.session import written

# The record number is the low 48 bits of an id; parents below 5 are
# reserved records, where a path ends.
RECORD_MASK = 0xFFFFFFFFFFFF
FIRST_PARENT = 5
FIRST_ARRIVAL = -(1 << 63)

KEYS = ["root_id", "frn"]


def latest_records(nodes: DataFrame, *facts: str, limit_bytes: int = ScanOptions.broadcast_bytes) -> DataFrame:
    """One row per masked id: the last by ``seq``, or without it the one with the highest reuse count.

    Of records that tie, the one with the largest parent, then name. Arrivals are numbers, so the last
    of each id comes out of a hash aggregation; only ids that occur twice are looked at again.
    """
    mask = F.lit(RECORD_MASK).cast("bigint")
    arrival = F.col("seq") if "seq" in nodes.columns else F.shiftrightunsigned(F.col("frn"), 48)
    kept = ["parent_frn", "name", *facts]
    rows = written(
        nodes.select(
            (F.col("root_id") if "root_id" in nodes.columns else F.lit("")).alias("root_id"),
            F.col("frn").cast("bigint").bitwiseAND(mask).alias("frn"),
            F.coalesce(arrival.cast("bigint"), F.lit(FIRST_ARRIVAL)).alias("arrival"),
            F.col("parent_frn").cast("bigint").bitwiseAND(mask).alias("parent_frn"),
            F.coalesce("name", F.lit("")).alias("name"),
            *facts,
        )
    )
    ties = [F.col("parent_frn").desc(), F.col("name").desc()]
    return one_of_each(rows, KEYS, "arrival", ties, limit_bytes, last=True).select(*KEYS, *kept)


def _ends() -> Column:
    return (F.col("parent_frn") == F.col("frn")) | (F.col("parent_frn") < FIRST_PARENT)


def _folder_tails(records: DataFrame, parents: DataFrame, sep: str, hot: int, limit_bytes: int) -> DataFrame:
    """(root_id, frn, tail) of every record that is somebody's parent: the names from the top of its chain down."""
    chains = join_keys(records, [F.col(k) for k in KEYS], settled(parents, limit_bytes), "left_semi")
    above = F.when(~_ends(), F.col("parent_frn"))
    known = written(
        chains.select(
            *KEYS,
            F.when(above.isNull(), F.col("name")).alias("tail"),
            F.when(above.isNotNull(), F.array("frn")).alias("ids"),
            F.when(above.isNotNull(), F.array("name")).alias("names"),
            above.alias("next"),
        )
    )
    down = F.array_join(F.reverse("names"), sep)
    done, open_ = known.filter("next IS NULL"), known.filter("next IS NOT NULL")
    while not open_.isEmpty():
        end = done.unionByName(open_).select(
            F.col("root_id").alias("key_root"),
            F.col("frn").alias("key_frn"),
            F.col("tail").alias("end_tail"),
            F.col("ids").alias("end_ids"),
            F.col("names").alias("end_names"),
            F.col("next").alias("end_next"),
        )
        joined = join_hot(open_, [F.col("root_id"), F.col("next")], end, "left", limit_bytes, hot)
        all_ids = F.concat("ids", "end_ids")
        ids = F.array_distinct(all_ids)
        # A chain that ended well is a text; nothing has to be found in it again.
        tail = F.when(F.col("end_tail").isNotNull(), F.concat("end_tail", F.lit(sep), down)).when(F.col("end_ids").isNull(), down)
        stepped = joined.select(
            *KEYS,
            tail.alias("tail"),
            F.when(tail.isNull(), ids).alias("ids"),
            F.when(tail.isNull(), F.slice(F.concat("names", "end_names"), F.lit(1), F.size(ids))).alias("names"),
            F.when(tail.isNull() & (F.size(ids) == F.size(all_ids)), F.col("end_next")).alias("next"),
        )
        stepped = written(stepped)
        done, open_ = done.unionByName(stepped.filter("next IS NULL")), stepped.filter("next IS NOT NULL")
    return done.select(*KEYS, F.coalesce("tail", down).alias("tail"))


def resolve_paths(
    nodes: DataFrame,
    prefix: str,
    sep: str = "\\",
    facts: tuple[str, ...] = (),
    hot: int = HOT_ROWS,
    limit_bytes: int = ScanOptions.broadcast_bytes,
) -> DataFrame:
    """(root_id, frn, path, and ``facts`` of the last record) for nodes (frn, parent_frn, name and perhaps root_id, seq).

    A chain ends at an unknown parent, at itself, at a reserved parent, or where it
    would come back to a node it has passed.

    Only nodes that are somebody's parent take part in the search: each holds the
    chain it knows, and each round appends the chain of that chain's end, so chains
    double in length. A chain that ended well goes on as a text; only open ones carry
    their ids. A chain that returns to itself repeats the ids it has; dropping
    repeats leaves the walk up to that point. All other nodes, the many files,
    are joined once at the end. Ends that many chains have in common, and folders with
    many files (``hot`` rows or more), are broadcast; all others meet by a merge join.
    """
    records = written(latest_records(nodes, *facts, limit_bytes=limit_bytes))
    parents = records.filter(~_ends()).select(F.col("root_id").alias("key_root"), F.col("parent_frn").alias("key_frn")).distinct()
    parents = written(parents)
    folders = written(_folder_tails(records, parents, sep, hot, limit_bytes))
    path = F.concat(F.lit(prefix), F.lit(sep), F.col("tail")).alias("path")
    inner = folders
    if facts:
        inner = records.select(*KEYS, *facts).join(folders.hint("merge"), KEYS)
    leaves = join_keys(records, [F.col(k) for k in KEYS], settled(parents, limit_bytes), "left_anti")
    # A leaf cannot be on its parent's chain, else it would be a parent itself.
    above = folders.select(F.col("root_id").alias("key_root"), F.col("frn").alias("key_frn"), F.col("tail").alias("folder_tail"))
    met = join_hot(leaves, [F.col("root_id"), F.when(~_ends(), F.col("parent_frn"))], above, "left", limit_bytes, hot)
    outer = met.withColumn("tail", F.concat_ws(sep, "folder_tail", "name"))
    return inner.select(*KEYS, path, *facts).unionByName(outer.select(*KEYS, path, *facts))


def inventory_rows(nodes: DataFrame, prefix: str, sep: str = "\\") -> DataFrame:
    """Resolved paths as rows for ``inventory_from_table``; ``nodes`` has is_directory or attributes too."""
    facts = tuple(c for c in ("is_directory", "attributes", "size_bytes", "modified") if c in nodes.columns)
    return resolve_paths(nodes, prefix, sep, facts).withColumnRenamed("path", "full_path")
