"""All scans at once.

What a scan looks for in single entries is a tag: temporary, empty, old, long, a link, a
shortcut, an archive. One pass over the inventory tags entries, prunes the tagged ones
once and writes them down. The paths that links, shortcuts and archives point to are
looked up together, in one more pass. Scans that need all files or folders (largest,
copies, empty folders, probes, leftovers) read the inventory themselves, their own
columns only; folder rows are written down once, as they are few and asked for often.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.operators import archives, links, prune, rowlocal
from atticsweep.operators.existence import found_paths
from atticsweep.operators.lookup import KeySet
from atticsweep.registry import SCANNERS, run_scan
from atticsweep.schema import Inputs, ScanOptions
from atticsweep.session import written

POINTING = ("broken_links", "broken_shortcuts", "unpacked_archives")


def scan_all(inputs: Inputs, opts: ScanOptions, scans: list[str] | None = None) -> DataFrame:
    """The findings of the named scans (all whose inputs are given) in one table."""
    if scans is None:
        scans = [s.name for s in SCANNERS.values() if all(getattr(inputs, n) is not None for n in s.needs)]
    inv = inputs.inventory
    folders = written(prune.folders(inv))
    blocked = prune.blocked_subtrees(folders, opts)
    one_pass = {
        "temp_files": lambda: rowlocal.temp_finding(opts),
        "zero_length_files": lambda: rowlocal.zero_length_finding(opts),
        "old_files": lambda: rowlocal.old_finding(opts, inputs.as_of),
        "long_paths": lambda: rowlocal.long_path_finding(opts),
    }
    findings = [one_pass[s]() for s in scans if s in one_pass]
    tags: dict[str, Callable[[], Column]] = {
        "broken_links": links.is_link, "broken_shortcuts": links.is_shortcut, "unpacked_archives": archives.is_archive,
    }
    pointing = [s for s in scans if s in POINTING]
    parts = []
    if findings or pointing:
        wanted = [f.where for f in findings] + [tags[s]() for s in pointing]
        tagged = inv.filter(reduce(Column.__or__, wanted))
        columns = ["root_id", "full_path", "name", "parent_path", "size_bytes", "modified", "is_directory", "is_reparse_point", "link_target"]
        hits = [rowlocal.hits(findings).alias("hits")] if findings else []
        tagged = written(prune.listed(tagged, inv, opts, blocked).select(*columns, *hits))
        if findings:
            parts.append(rowlocal.split_hits(tagged, findings))
        parts += _pointing(tagged, inputs, opts, pointing)
    # Folder rows of the inventory are read from their own table where a scan wants nothing else.
    rest = [s for s in scans if s not in one_pass and s not in POINTING]
    some = replace(inputs, extra={**inputs.extra, "folders": folders})
    parts += [run_scan(s, some, opts, ordered=False, blocked=blocked) for s in rest]
    return reduce(DataFrame.unionByName, parts)


def _pointing(tagged: DataFrame, inputs: Inputs, opts: ScanOptions, scans: list[str]) -> list[DataFrame]:
    """Scans that look up other paths: what they ask for is looked up together."""
    asked, judges = [], []
    if "broken_links" in scans:
        pointers = links.link_pointers(tagged.filter(links.is_link()), opts)
        asked.append(links.wanted_targets(pointers))
        judges.append(lambda found, rows=pointers: links.dangling_links(rows, found))
    if "broken_shortcuts" in scans:
        shortcuts = links.shortcut_pointers(tagged.filter(links.is_shortcut()), inputs.env, opts)
        asked.append(links.wanted_targets(shortcuts))
        judges.append(lambda found, rows=shortcuts: links.dangling_shortcuts(rows, found))
    if "unpacked_archives" in scans:
        packed = archives.with_folder_key(tagged.filter(archives.is_archive()), opts)
        expected = None if inputs.members is None else archives.expected_members(packed, inputs.members, opts)
        asked.append(archives.wanted_by_archives(packed, expected))
        judges.append(lambda found: archives.judged_archives(packed, expected, found, opts))
    if not asked:
        return []
    found: KeySet = found_paths(reduce(DataFrame.unionByName, asked), inputs.inventory, opts)
    return [judge(found) for judge in judges]
