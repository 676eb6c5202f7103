"""The list of scans, open to scans of the user's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.operators.lookup import KeySet
from atticsweep.schema import RESULT_SCHEMA, Inputs, ScanOptions

STANDARD_COLUMNS = (
    ("Name", "name"),
    ("Path", "full_path"),
    ("Size", "size_bytes"),
    ("Modified", "modified"),
    ("Detail", "detail"),
    ("Group", "group"),
)


@dataclass(frozen=True)
class Scanner:
    """A scan: what it is called, what it shows, in which order, and how it runs.

    ``run`` takes (Inputs, ScanOptions, blocked subtrees or None). ``needs`` names
    the optional inputs without which it cannot run.
    """

    name: str
    description: str
    columns: tuple[tuple[str, str], ...]
    order: Callable[[str], list[Column]]
    run: Callable[[Inputs, ScanOptions, KeySet | None], DataFrame]
    needs: tuple[str, ...] = ()


SCANNERS: dict[str, Scanner] = {}


def scanner(name, description, columns=STANDARD_COLUMNS, order=None, run=None, needs=()):
    """Register a scan. Without ``run`` the function itself takes (Inputs, ScanOptions)."""

    def register(function):
        call = run or (lambda inputs, opts, blocked: function(inputs, opts))
        SCANNERS[name] = Scanner(name, description, tuple(columns), order or (lambda sep: []), call, tuple(needs))
        return function

    return register


def unregister(name: str) -> None:
    SCANNERS.pop(name)


def run_scan(
    name: str, inputs: Inputs, opts: ScanOptions, ordered: bool = True, blocked: KeySet | None = None
) -> DataFrame:
    """The findings of one scan, in its own order unless they go on into another step."""
    spec = SCANNERS[name]
    missing = [n for n in spec.needs if getattr(inputs, n) is None]
    if missing:
        raise ValueError(f"scan {name} needs the inputs {', '.join(missing)}")
    out = spec.run(inputs, opts, blocked)
    check_results(out, name)
    return in_order(out, name, opts.sep) if ordered else out


def check_results(df: DataFrame, name: str) -> None:
    have = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in RESULT_SCHEMA.fields]
    if have != want:
        raise TypeError(f"scan {name} does not return the result columns: {df.schema.simpleString()}")


def in_order(results: DataFrame, name: str, sep: str = "\\") -> DataFrame:
    """The order in which a scan lists its findings; paths break ties, so no range is one key only."""
    keys = SCANNERS[name].order(sep)
    return results.orderBy(*keys, F.col("root_id"), F.upper("full_path"), F.col("full_path")) if keys else results


def to_results(rows: DataFrame, scan: str, detail=None, group=None, selected=True, **changed: Column) -> DataFrame:
    """Inventory rows as findings. Keyword columns replace the inventory's own."""
    columns = {
        "scanner": F.lit(scan),
        "group": F.lit("") if group is None else group,
        "detail": F.lit("") if detail is None else detail,
        "is_selected": selected if isinstance(selected, Column) else F.lit(selected),
        **changed,
    }
    return rows.select(
        *[columns.get(f.name, F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields]
    )
