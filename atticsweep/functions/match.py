"""Name and size predicates built from the scan options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from atticsweep.functions.paths import quote
from atticsweep.schema import ScanOptions


def wildcard_match(name: Column, pattern: str) -> Column:
    """``*`` wildcards, any case, each piece at its leftmost place and never moved again.

    So ``*.tmp`` matches ``a.tmp`` but not ``a.tmp.tmp``; atomic groups say just that.
    """
    pieces = pattern.upper().split("*")
    parts = [quote(pieces[0])] + [f"(?>.*?{quote(p)})" for p in pieces[1:] if p]
    end = "" if pattern.endswith("*") else r"\z"
    return F.upper(name).rlike(r"(?s)\A" + "".join(parts) + end)


def name_in(name: Column, names: tuple[str, ...]) -> Column:
    return F.upper(name).isin([n.upper() for n in names]) if names else F.lit(False)


def is_ignored(name: Column, size: Column, opts: ScanOptions) -> Column:
    """Files that do not count as content: empty ones (option) and the listed names."""
    exact = tuple(p for p in opts.ignored_files if p and "*" not in p)
    tests = [wildcard_match(name, p) for p in opts.ignored_files if "*" in p]
    if exact:
        tests.append(name_in(name, exact))
    if opts.ignore_empty_files:
        tests.append(size == 0)
    return reduce(Column.__or__, tests, F.lit(False))


def size_between(size: Column, lo: int = 0, hi: int = 0) -> Column:
    """Non-empty and within the bounds; a bound of 0 is off."""
    test = size > 0
    if lo > 0:
        test = test & (size >= lo)
    if hi > 0:
        test = test & (size <= hi)
    return test
