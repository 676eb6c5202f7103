"""Scans on a stream of inventory rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.operators import prune, rowlocal
from atticsweep.operators.lookup import KeySet, join_keys
from atticsweep.schema import ScanOptions

STREAMED = ("temp_files", "zero_length_files", "old_files", "long_paths")


def stream_scan(
    stream_inv: DataFrame, scan: str, opts: ScanOptions, as_of: datetime | None = None, blocked: KeySet | None = None
) -> DataFrame:
    """The findings of a row-local scan, row by row and without state; append mode.

    What a row itself tells prunes it: depth, excluded names on its path, a folder's own
    flags. Flags of folders above are on other rows; ``blocked``, the blocked subtrees of
    the last full inventory (``prune.blocked_subtrees``), takes their entries away with a
    join against a static table. With it, findings are those of the batch scan.
    """
    if scan == "temp_files":
        finding = rowlocal.temp_finding(opts)
    elif scan == "zero_length_files":
        finding = rowlocal.zero_length_finding(opts)
    elif scan == "old_files":
        if as_of is None:
            raise ValueError("old_files needs as_of")
        finding = rowlocal.old_finding(opts, as_of)
    elif scan == "long_paths":
        finding = rowlocal.long_path_finding(opts)
    else:
        raise ValueError(f"{scan} needs the whole inventory; on a stream: {', '.join(STREAMED)}")
    rows = prune.reachable_by_path(stream_inv.filter(finding.where), opts)
    rows = rows.filter(F.col("depth") >= 1)
    if blocked is not None:
        rows = join_keys(rows, [F.col("root_id"), opts.key(F.col("parent_path"))], blocked, "left_anti")
    return rowlocal.judged(rows, finding)
