"""Files that could not be opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atticsweep.operators import prune
from atticsweep.operators.firsts import one_of_each
from atticsweep.operators.lookup import KeySet, join_keys, settled
from atticsweep.registry import scanner, to_results
from atticsweep.schema import ScanOptions
from atticsweep.session import written

# The codes of a sharing violation and a lock violation, as signed ints.
SHARING_VIOLATION = -2147024864
LOCK_VIOLATION = -2147024863
FIRST_TIME = -(1 << 63)


def access_reason(outcome: Column, hresult: Column, exception_name: Column) -> Column:
    """The text for a probe outcome (``unauthorized``, ``io``, other); NULL if the file opened."""
    return (
        F.when(outcome == "unauthorized", F.lit("Access denied"))
        .when((outcome == "io") & (hresult == SHARING_VIOLATION), F.lit("Locked by another process"))
        .when((outcome == "io") & (hresult == LOCK_VIOLATION), F.lit("Lock violation"))
        .when(outcome == "io", F.format_string("I/O error (0x%08X)", hresult.cast("int")))
        .otherwise(exception_name)
    )


@scanner(
    "unreadable_files",
    "Files that are locked or cannot be read",
    columns=(
        ("Name", "name"),
        ("Path", "full_path"),
        ("Reason", "detail"),
        ("Size", "size_bytes"),
        ("Modified", "modified"),
    ),
    run=lambda i, o, blocked: unreadable_files(i.inventory, i.probes, o, blocked),
    needs=("probes",),
)
def unreadable_files(
    inv: DataFrame, probes: DataFrame, opts: ScanOptions, blocked: KeySet | None = None
) -> DataFrame:
    """Visible files whose last access probe failed; one finding each.

    ``probes`` is a log that is only ever added to. With a column ``probed_at`` the last probe
    of a file counts, rows without a time before all others. Of several at one time, and of
    all without that column, a failed one counts before one that opened the file, then the
    first reason in order.
    """
    root = F.col("root_id") if "root_id" in probes.columns else F.lit("")
    at = F.lit(FIRST_TIME)
    if "probed_at" in probes.columns:
        known = F.col("probed_at")
        known = F.unix_micros(known) if isinstance(probes.schema["probed_at"].dataType, T.TimestampType) else known.cast("bigint")
        at = F.coalesce(known, at)
    log = written(
        probes.select(
            root.alias("key_root"),
            opts.key(F.col("full_path"), root).alias("key_path"),
            access_reason(F.col("outcome"), F.col("hresult"), F.col("exception_name")).alias("reason"),
            at.alias("at"),
        )
    )
    ties = [F.col("reason").isNull(), F.col("reason")]
    last = one_of_each(log, ["key_root", "key_path"], "at", ties, opts.broadcast_bytes, last=True)
    failed = last.filter(F.col("reason").isNotNull()).drop("at")
    own = [F.col("root_id"), opts.key(F.col("full_path"))]
    hit = join_keys(prune.files(inv), own, settled(failed, opts.broadcast_bytes), "inner")
    return to_results(
        prune.listed(hit, inv, opts, blocked), "unreadable_files", detail=F.col("reason"), selected=False
    )
