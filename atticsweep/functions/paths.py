"""Path parts and ancestor chains as column expressions.

Paths carry no trailing separator. Comparisons use *keys*: upper-cased paths, and in
case-sensitive roots the paths as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# In place of the case-sensitive roots: every root is one.
EVERY_ROOT = ("*",)


def key_of(path: Column, case_sensitive_roots: tuple[str, ...] = (), root_id: Column | None = None) -> Column:
    """The form of a path that joins, groupings and orders compare."""
    if not case_sensitive_roots:
        return F.upper(path)
    if tuple(case_sensitive_roots) == EVERY_ROOT:
        return path
    root_id = F.col("root_id") if root_id is None else root_id
    return F.when(root_id.isin(list(case_sensitive_roots)), path).otherwise(F.upper(path))


def name_of(path: Column, sep: str) -> Column:
    return F.substring_index(path, sep, -1)


def parent_of(path: Column, sep: str) -> Column:
    """The folder of a path; '' where the path has one segment."""
    keep = F.length(path) - F.length(name_of(path, sep)) - F.lit(len(sep))
    return F.when(keep > 0, F.substring(path, F.lit(1), keep)).when(path.isNotNull(), F.lit(""))


def extension_of(name: Column) -> Column:
    """From the last dot of a name on; '' without a dot or with nothing behind it."""
    last = F.substring_index(name, ".", -1)
    return F.when(F.contains(name, F.lit(".")) & (last != ""), F.concat(F.lit("."), last)).otherwise(F.lit(""))


def stem_of(name: Column) -> Column:
    """A name without its last dot and what follows."""
    last = F.substring_index(name, ".", -1)
    cut = F.length(name) - F.length(last) - F.lit(1)
    return F.when(F.contains(name, F.lit(".")), F.substring(name, F.lit(1), cut)).otherwise(name)


def segment_count(path: Column, sep: str) -> Column:
    removed = F.length(path) - F.length(F.replace(path, F.lit(sep), F.lit("")))
    return (removed / F.lit(len(sep)) if len(sep) > 1 else removed).cast("int") + F.lit(1)


def depth_of(path: Column, sep: str, root: Column | str | None = None) -> Column:
    """Folder levels below ``root`` (itself 0); without a root, below the first segment."""
    if root is None:
        return segment_count(path, sep) - F.lit(1)
    root = F.lit(root) if isinstance(root, str) else root
    return segment_count(path, sep) - segment_count(root, sep)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / F.lit(2)).cast("bigint")


def levels(depth: Column, lowest: Column | int = 0) -> Column:
    """The levels from ``lowest`` to ``depth``, to explode; NULL for a folder above ``lowest``."""
    lowest = F.lit(lowest) if isinstance(lowest, int) else lowest
    return F.when(depth >= lowest, F.sequence(lowest.cast("int"), depth.cast("int")))


def ancestor(key: Column, depth: Column, level: Column, sep: str) -> Column:
    """The folder at ``level`` above (or equal to) a folder that has level ``depth``."""
    segments = segment_count(key, sep) - depth + level
    return F.call_function("substring_index", key, F.lit(sep), segments.cast("int"))


def last_segments(path: Column, count: Column, sep: str) -> Column:
    """The last ``count`` segments of a path; '' for none."""
    return F.call_function("substring_index", path, F.lit(sep), F.negate(count).cast("int"))


def quote(literal: str) -> str:
    """A regular expression that matches exactly this text."""
    return "".join(c if c.isalnum() else "\\" + c for c in literal)
