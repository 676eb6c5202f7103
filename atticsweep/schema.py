"""Table layouts and scan options.

Every scan reads an *inventory* (one row per file or folder, many roots in one
table) and returns *results* (one row per finding).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from atticsweep.functions import paths

INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("root_id", T.StringType()),
        T.StructField("full_path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("is_directory", T.BooleanType()),
        T.StructField("is_hidden", T.BooleanType()),
        T.StructField("is_system", T.BooleanType()),
        T.StructField("is_reparse_point", T.BooleanType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("attributes", T.LongType()),
        T.StructField("link_target", T.StringType()),
    ]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("scanner", T.StringType()),
        T.StructField("root_id", T.StringType()),
        T.StructField("full_path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("group", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("is_directory", T.BooleanType()),
        T.StructField("is_selected", T.BooleanType()),
    ]
)

# Folder names that are never entered, and file names that do not
# count as content of a folder.
EXCLUDED_FOLDERS = (
    "System Volume Information",
    "RECYCLER",
    "$RECYCLE.BIN",
    "winsxs",
    "System32",
    "GAC_MSIL",
    "GAC_32",
    "node_modules",
    ".git",
    ".svn",
    ".hg",
)
IGNORED_FILES = ("desktop.ini", "Thumbs.db", ".DS_Store", "._*")

RECYCLE_BIN = "RecycleBin"
PERMANENT = "Permanent"
SIMULATE = "Simulate"
DELETE_MODES = (RECYCLE_BIN, PERMANENT, SIMULATE)


@dataclass(frozen=True)
class ScanOptions:
    """What a scan may enter and what it ignores; compiled into column expressions.

    ``max_depth`` -1 means no limit; the root has depth 0. ``min_size`` and
    ``max_size`` of 0 are off. ``broadcast_bytes`` is the largest measured table
    that a scan ships to every executor; larger ones (or 0) go through a shuffle
    join instead. ``case_sensitive_roots`` are the roots whose paths differ by case,
    ``("*",)`` all of them; names in option lists are compared in any case everywhere.
    """

    sep: str = "\\"
    max_depth: int = -1
    skip_hidden: bool = False
    skip_system: bool = True
    excluded_folders: tuple[str, ...] = EXCLUDED_FOLDERS
    ignored_files: tuple[str, ...] = IGNORED_FILES
    ignore_empty_files: bool = True
    min_size: int = 0
    max_size: int = 0
    strict_empty: bool = False
    broadcast_bytes: int = 64 << 20
    case_sensitive_roots: tuple[str, ...] = ()

    def key(self, path: Column, root_id: Column | None = None) -> Column:
        """What paths of a root (the column ``root_id`` without another) are compared by."""
        return paths.key_of(path, self.case_sensitive_roots, root_id)


@dataclass(frozen=True)
class Inputs:
    """The tables that the registered scans read; only ``inventory`` is always needed.

    contents   root_id, full_path, content
    probes     root_id, full_path, outcome, hresult, exception_name
    members    root_id, archive_path, entry_name
    env        root_id, name, value
    locations  root_id, path, label
    names      root_id, token
    """

    inventory: DataFrame
    as_of: datetime | None = None
    contents: DataFrame | None = None
    probes: DataFrame | None = None
    members: DataFrame | None = None
    env: DataFrame | None = None
    locations: DataFrame | None = None
    names: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)
