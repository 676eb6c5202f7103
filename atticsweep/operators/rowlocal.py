"""Scans that judge each entry by itself: temporary, empty, old files and long paths.

Each is a ``Finding``, a set of column expressions. One scan filters by it; a
sweep over several evaluates them side by side in a single pass over the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.functions import match, paths
from atticsweep.operators import prune
from atticsweep.operators.lookup import KeySet
from atticsweep.registry import scanner, to_results
from atticsweep.schema import ScanOptions

# Extensions of temporary files, and names and name beginnings with
# the text that is shown for them, in order of precedence.
TEMP_EXTENSIONS = (
    ".tmp", ".temp", ".bak", ".old", ".orig",
    ".log", ".~", ".swp", ".swo",
    ".dmp", ".crash", ".stackdump",
    ".chk", ".gid", ".cnt",
    ".cache", ".lck", ".lock",
)
TEMP_NAMES = (
    ("thumbs.db", "Windows thumbnail cache"),
    ("desktop.ini", "Windows folder settings"),
    (".ds_store", "macOS metadata"),
)
TEMP_BEGINNINGS = (
    ("._", "macOS resource fork"),
    ("~$", "Office lock file"),
    ("~", "Temp/backup file"),
    ("etilqs_", "SQLite temp file"),
)
STALE_DAYS = 365
MAX_PATH = 260
MICROS_PER_DAY = 86_400_000_000


@dataclass(frozen=True)
class Finding:
    scanner: str
    where: Column
    detail: Column
    group: Column
    selected: bool
    size_bytes: Column


def temp_reason(name: Column) -> Column:
    """Why a file name looks temporary; NULL if it does not."""
    ext = paths.extension_of(name)
    upper = F.upper(name)
    reason = F.when(match.name_in(ext, TEMP_EXTENSIONS), F.concat(F.lit("Temp extension ("), ext, F.lit(")")))
    for exact, text in TEMP_NAMES:
        reason = reason.when(upper == exact.upper(), F.lit(text))
    for beginning, text in TEMP_BEGINNINGS:
        reason = reason.when(upper.startswith(beginning.upper()), F.lit(text))
    return reason


def is_temp_name(name: Column) -> Column:
    """Whether there is a ``temp_reason``, in one look: several scans' tests together have to stay short code."""
    ends = "|".join(paths.quote(e.upper()) for e in TEMP_EXTENSIONS)
    whole = "|".join(paths.quote(n.upper()) for n, _ in TEMP_NAMES)
    begins = "|".join(paths.quote(b.upper()) for b, _ in TEMP_BEGINNINGS)
    # No extension has a second dot, so a name that ends in one has it.
    return F.upper(name).rlike(rf"\A(?:{begins})|\A(?:{whole})\z|(?:{ends})\z")


def temp_finding(opts: ScanOptions) -> Finding:
    reason = temp_reason(F.col("name"))
    where = ~F.col("is_directory") & is_temp_name(F.col("name"))
    return Finding("temp_files", where, reason, F.lit(""), True, F.col("size_bytes"))


def zero_length_finding(opts: ScanOptions) -> Finding:
    where = ~F.col("is_directory") & (F.col("size_bytes") == 0)
    return Finding(
        "zero_length_files", where, paths.extension_of(F.col("name")), F.lit(""), True, F.lit(0).cast("bigint")
    )


def old_finding(opts: ScanOptions, as_of: datetime, days: int = STALE_DAYS) -> Finding:
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    cutoff = F.timestamp_micros(now - F.lit(days * MICROS_PER_DAY))
    where = ~F.col("is_directory") & (F.col("modified") < cutoff)
    if opts.ignore_empty_files:
        where = where & (F.col("size_bytes") != 0)
    age = (now - F.unix_micros("modified")) / F.lit(float(MICROS_PER_DAY))
    detail = F.when(age >= STALE_DAYS, F.format_string("%.1f years", age / F.lit(365.0))).otherwise(
        F.format_string("%d days", F.floor(age).cast("int"))
    )
    return Finding("old_files", where, detail, F.lit(""), False, F.col("size_bytes"))


def long_path_finding(opts: ScanOptions, limit: int = MAX_PATH) -> Finding:
    path = F.col("full_path")
    length = paths.utf16_length(path)
    # A path never has more UTF-16 units than bytes, so most rows need no encoding.
    where = (F.octet_length(path) > limit) & (length > limit)
    where = where & (~F.col("is_directory") | ~prune.is_blocked(opts))
    return Finding(
        "long_paths",
        where,
        length.cast("string"),
        F.when(F.col("is_directory"), F.lit("Directory")).otherwise(F.lit("File")),
        False,
        F.when(F.col("is_directory"), F.lit(0)).otherwise(F.col("size_bytes")).cast("bigint"),
    )


def judged(rows: DataFrame, finding: Finding) -> DataFrame:
    """The findings among rows that were filtered and pruned already."""
    return to_results(
        rows,
        finding.scanner,
        detail=finding.detail,
        group=finding.group,
        selected=finding.selected,
        size_bytes=finding.size_bytes,
    )


def _scan(inv: DataFrame, opts: ScanOptions, finding: Finding, blocked: KeySet | None) -> DataFrame:
    return judged(prune.listed(inv.filter(finding.where), inv, opts, blocked), finding)


def hits(findings: list[Finding]) -> Column:
    """Which of the findings hold for an entry, by number; an entry may have more than one."""
    return F.array_compact(F.array(*[F.when(f.where, F.lit(i)) for i, f in enumerate(findings)]))


def split_hits(rows: DataFrame, findings: list[Finding]) -> DataFrame:
    """A finding for each of the ``hits`` of each row. What it shows is worked out here, where it may not be asked for."""
    rows = rows.select("root_id", "full_path", "name", "size_bytes", "modified", "is_directory", F.explode("hits").alias("hit"))

    def of(value: Callable[[Finding], Column]) -> Column:
        return reduce(lambda out, f: out.when(F.col("hit") == f[0], value(f[1])), enumerate(findings), F)

    return rows.select(
        of(lambda f: F.lit(f.scanner)).alias("scanner"),
        "root_id",
        "full_path",
        "name",
        of(lambda f: f.size_bytes.cast("bigint")).alias("size_bytes"),
        "modified",
        of(lambda f: f.group).alias("group"),
        of(lambda f: f.detail).alias("detail"),
        "is_directory",
        of(lambda f: F.lit(f.selected)).alias("is_selected"),
    )


@scanner(
    "temp_files",
    "Temporary and junk files",
    columns=(
        ("Name", "name"),
        ("Path", "full_path"),
        ("Size", "size_bytes"),
        ("Type", "detail"),
        ("Modified", "modified"),
    ),
    run=lambda i, o, blocked: temp_files(i.inventory, o, blocked),
)
def temp_files(inv: DataFrame, opts: ScanOptions, blocked: KeySet | None = None) -> DataFrame:
    """Files whose extension, name or name beginning says temporary; the first rule gives the text."""
    return _scan(inv, opts, temp_finding(opts), blocked)


@scanner(
    "zero_length_files",
    "Files with 0 bytes",
    columns=(("Name", "name"), ("Path", "full_path"), ("Modified", "modified")),
    run=lambda i, o, blocked: zero_length_files(i.inventory, o, blocked),
)
def zero_length_files(inv: DataFrame, opts: ScanOptions, blocked: KeySet | None = None) -> DataFrame:
    return _scan(inv, opts, zero_length_finding(opts), blocked)


@scanner(
    "old_files",
    "Files not modified for over a year",
    columns=(
        ("Name", "name"),
        ("Path", "full_path"),
        ("Size", "size_bytes"),
        ("Modified", "modified"),
        ("Age", "detail"),
    ),
    order=lambda sep: [F.col("modified").asc()],
    run=lambda i, o, blocked: old_files(i.inventory, o, i.as_of, blocked=blocked),
    needs=("as_of",),
)
def old_files(
    inv: DataFrame, opts: ScanOptions, as_of: datetime, days: int = STALE_DAYS, blocked: KeySet | None = None
) -> DataFrame:
    """Files last modified more than ``days`` before ``as_of``; those without a time are left out."""
    return _scan(inv, opts, old_finding(opts, as_of, days), blocked)


@scanner(
    "long_paths",
    "Files and folders whose path is longer than 260 characters",
    columns=(
        ("Name", "name"),
        ("Path", "full_path"),
        ("Length", "detail"),
        ("Size", "size_bytes"),
        ("Modified", "modified"),
    ),
    order=lambda sep: [F.col("detail").cast("int").desc()],
    run=lambda i, o, blocked: long_paths(i.inventory, o, blocked=blocked),
)
def long_paths(
    inv: DataFrame, opts: ScanOptions, limit: int = MAX_PATH, blocked: KeySet | None = None
) -> DataFrame:
    """Entries whose path has more than ``limit`` UTF-16 units."""
    return _scan(inv, opts, long_path_finding(opts, limit), blocked)
