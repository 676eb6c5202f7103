"""Pruning, folder statistics and empty folders against a recursive walk."""

import pytest
from helpers import Walk, entry, inventory, paths, random_tree

import atticsweep as att

OPTIONS = [
    att.ScanOptions(),
    att.ScanOptions(max_depth=0),
    att.ScanOptions(max_depth=2),
    att.ScanOptions(skip_hidden=True, skip_system=False),
    att.ScanOptions(excluded_folders=(), ignore_empty_files=False),
    att.ScanOptions(broadcast_bytes=0),
]


@pytest.mark.parametrize("opts", OPTIONS)
@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, opts, seed):
    rows = random_tree(seed)
    inv, walk = inventory(spark, rows), Walk(rows, opts)
    assert paths(att.visible(inv, opts)) == walk.visible()
    assert paths(att.empty_folders(inv, opts)) == walk.empty()
    stats = {
        (r["full_path"], r["depth"], r["file_count"], r["total_size"], r["has_non_ignored"], r["subfolder_count"])
        for r in att.folder_stats(inv, opts).collect()
    }
    assert stats == {
        (f, d, len(files), sum(r[5] for r in files), any(map(walk.counts_as_content, files)), len(subs))
        for f, d, files, subs in walk.folders()
    }


def test_excluded_name_of_the_root_itself(spark):
    rows = [entry("C:\\node_modules"), entry("C:\\node_modules\\a.txt", 1)]
    inv = inventory(spark, rows, root="C:\\node_modules")
    assert paths(att.visible(inv, att.ScanOptions())) == ["C:\\node_modules\\a.txt"]


def test_case_of_parents_does_not_matter(spark):
    rows = [entry("C:\\data"), entry("C:\\data\\Sys", system=True), entry("c:\\DATA\\sYS\\a.txt", 1)]
    assert paths(att.visible(inventory(spark, rows), att.ScanOptions())) == []


def test_roots_do_not_mix(spark):
    rows = [entry("C:\\data\\x", system=True), entry("C:\\data\\x\\f", 1)]
    a = inventory(spark, rows).selectExpr("'a' AS root_id", "* EXCEPT (root_id)")
    b = inventory(spark, [entry("C:\\data\\x"), entry("C:\\data\\x\\f", 1)]).selectExpr("'b' AS root_id", "* EXCEPT (root_id)")
    seen = att.visible(a.unionByName(b), att.ScanOptions()).select("root_id", "full_path").collect()
    assert sorted(map(tuple, seen)) == [("b", "C:\\data\\x"), ("b", "C:\\data\\x\\f")]


def test_empty_folder_details_and_strictness(spark):
    rows = [
        entry("C:\\data"),
        entry("C:\\data\\a"),
        entry("C:\\data\\a\\b"),
        entry("C:\\data\\a\\Thumbs.db", 9),
        entry("C:\\data\\c"),
        entry("C:\\data\\c\\.git"),
        entry("C:\\data\\c\\.git\\f", 9),
        entry("C:\\data\\d"),
        entry("C:\\data\\d\\e"),
        entry("C:\\data\\d\\e\\f", 9),
    ]
    inv = inventory(spark, rows)
    found = {r["full_path"]: r for r in att.empty_folders(inv, att.ScanOptions()).collect()}
    assert {p: r["detail"] for p, r in found.items()} == {
        "C:\\data\\a": "1 ignored file(s)",
        "C:\\data\\a\\b": "Empty",
        "C:\\data\\c": "Empty",
    }
    assert all(r["is_selected"] and r["is_directory"] and r["size_bytes"] == 0 for r in found.values())
    strict = att.empty_folders(inv, att.ScanOptions(strict_empty=True))
    assert paths(strict) == ["C:\\data\\a", "C:\\data\\a\\b"]
    # At depth 1 the content of d\e is out of sight, so d counts as empty unless strict.
    assert "C:\\data\\d" in paths(att.empty_folders(inv, att.ScanOptions(max_depth=1)))
    assert "C:\\data\\d" not in paths(att.empty_folders(inv, att.ScanOptions(max_depth=1, strict_empty=True)))


def test_folder_without_a_row_still_counts(spark):
    rows = [entry("C:\\data"), entry("C:\\data\\a"), entry("C:\\data\\a\\b\\f.txt", 3)]
    inv = inventory(spark, rows)
    assert paths(att.empty_folders(inv, att.ScanOptions())) == []


def rollup(rows, folder, sep="\\"):
    total = 0
    for r in rows:
        if r[0].rsplit(sep, 1)[0] == folder and r[0] != folder:
            if not r[1]:
                total += r[5]
            elif not r[4]:
                total += rollup(rows, r[0], sep)
    return total


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_recursive_sizes(spark, seed):
    rows = random_tree(seed)
    got = {r["folder"]: r["size_bytes"] for r in att.folder_rollup(inventory(spark, rows), "\\").collect()}
    assert got == {r[0]: rollup(rows, r[0]) for r in rows if r[1]}
