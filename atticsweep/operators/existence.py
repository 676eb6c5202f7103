"""Which paths exist, and as what: one look at the inventory for all that several scans ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.operators import prune
from atticsweep.operators.lookup import KeySet, existing_keys
from atticsweep.schema import ScanOptions
from atticsweep.session import written


def found_paths(wanted: DataFrame, inv: DataFrame, opts: ScanOptions) -> KeySet:
    """The ``wanted`` (root_id, path_key) that are entries: (key_root, key_path, is_file, is_open_folder).

    An open folder is one that no flag or name of its own blocks. Where several entries
    have a key, each kind among them is a row. Written once.
    """
    present = inv.select(
        "root_id",
        opts.key(F.col("full_path")).alias("path_key"),
        (~F.col("is_directory")).alias("is_file"),
        (F.col("is_directory") & ~prune.is_blocked(opts)).alias("is_open_folder"),
    )
    found = existing_keys(wanted, present, opts.broadcast_bytes, "is_file", "is_open_folder")
    return KeySet(written(found.df), found.small)


def of_kind(found: KeySet, kind: Column | None = None) -> KeySet:
    """The keys alone, once each, of those entries."""
    rows = found.df if kind is None else found.df.filter(kind)
    return KeySet(rows.select("key_root", "key_path").distinct(), found.small)
