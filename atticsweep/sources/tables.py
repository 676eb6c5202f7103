"""Inventories from tables of any layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.functions import attributes, paths
from atticsweep.schema import INVENTORY_SCHEMA


def inventory_from_table(df: DataFrame, sep: str = "\\", root: Column | str | None = None) -> DataFrame:
    """Rows with at least ``full_path`` as an inventory; whatever is absent is derived.

    ``root`` is the folder the scan starts in (a path, or a column where roots
    differ by row); it gets depth 0 and rows outside it are left out. Without it the
    first path segment is the root. All row-local. Store the outcome and scan the
    stored table: filters on its columns then reach the files.
    """
    have = {c.lower() for c in df.columns}
    path = F.col("full_path")
    if root is not None:
        if isinstance(root, str) and root.endswith(sep):
            # A root such as C:\ is kept without its separator, like all other folders.
            bare = root.rstrip(sep)
            path = F.when(F.upper(path) == root.upper(), F.lit(bare)).otherwise(path)
            root = bare
        root = F.lit(root) if isinstance(root, str) else root
        inside = F.concat(F.upper("full_path"), F.lit(sep)).startswith(F.concat(F.upper(root), F.lit(sep)))
        df = df.filter(inside).withColumn("full_path", path)
        path = F.col("full_path")
    if "attributes" in have:
        flags = attributes.decode_attributes(F.coalesce(F.col("attributes"), F.lit(0)))
    else:
        flags = dict.fromkeys(("is_directory", "is_hidden", "is_system", "is_reparse_point"), F.lit(False))

    def given(name: str, otherwise: Column) -> Column:
        return F.col(name) if name in have else otherwise

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in have else flags[name]

    columns = {
        "root_id": F.coalesce(F.col("root_id"), F.lit("")) if "root_id" in have else F.lit(""),
        "full_path": path,
        "name": given("name", paths.name_of(path, sep)),
        "parent_path": given("parent_path", paths.parent_of(path, sep)),
        "depth": given("depth", paths.depth_of(path, sep, root)),
        "is_directory": flag("is_directory"),
        "is_hidden": flag("is_hidden"),
        "is_system": flag("is_system"),
        "is_reparse_point": flag("is_reparse_point"),
        "size_bytes": F.coalesce(F.col("size_bytes"), F.lit(0)) if "size_bytes" in have else F.lit(0),
        "modified": given("modified", F.lit(None)),
        "attributes": given("attributes", F.lit(None)),
        "link_target": given("link_target", F.lit(None)),
    }
    out = df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in INVENTORY_SCHEMA.fields])
    return out.filter(~F.col("name").isin(".", ".."))


def inventory_from_find_records(df: DataFrame, sep: str = "\\", root: Column | str | None = None) -> DataFrame:
    """Raw directory-enumeration records as an inventory.

    Columns: ``parent_path``, ``name``, ``attributes``, ``size_hi``, ``size_lo``,
    ``time_hi``, ``time_lo`` and optionally ``root_id``, ``link_target``.
    """
    c = F.col
    decoded = (
        df.withColumn("full_path", F.concat(c("parent_path"), F.lit(sep), c("name")))
        .withColumn("size_bytes", attributes.decode_size(c("size_hi"), c("size_lo")))
        .withColumn("modified", attributes.decode_filetime(c("time_hi"), c("time_lo")))
    )
    return inventory_from_table(decoded, sep, root)
