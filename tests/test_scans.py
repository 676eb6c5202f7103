from datetime import datetime

import pytest
from helpers import entry, inventory, paths

import atticsweep as att

OPTS = att.ScanOptions()
SHUFFLED = att.ScanOptions(broadcast_bytes=0)


def by_path(df):
    return {r["full_path"]: r for r in df.collect()}


def test_big_files(spark):
    rows = [entry("C:\\data")] + [entry(f"C:\\data\\f{i:03}", i // 2) for i in range(150)] + [entry("C:\\data\\d")]
    got = att.run_scan("big_files", att.Inputs(inventory(spark, rows)), OPTS).collect()
    expected = sorted(((i // 2, f"C:\\data\\f{i:03}") for i in range(150)), key=lambda r: (r[0], r[1].upper()), reverse=True)
    assert [(r["size_bytes"], r["full_path"]) for r in got] == expected[:100]
    assert not any(r["is_selected"] for r in got)


def test_big_files_order_underscore_above_letters(spark):
    rows = [entry("C:\\data\\a_b", 5), entry("C:\\data\\aab", 5), entry("C:\\data\\aAb2", 5)]
    got = att.run_scan("big_files", att.Inputs(inventory(spark, rows)), OPTS).collect()
    assert [r["name"] for r in got] == ["a_b", "aAb2", "aab"]


def test_big_files_per_root(spark):
    inv = inventory(spark, [entry(f"C:\\data\\f{i}", i) for i in range(6)])
    roots = inv.withColumn("root_id", (inv.size_bytes % 2).cast("string"))
    got = att.big_files(roots, OPTS, n=2, per_root=True).collect()
    assert sorted((r["root_id"], r["size_bytes"]) for r in got) == [("0", 2), ("0", 4), ("1", 3), ("1", 5)]


def test_old_files(spark):
    as_of = datetime(2021, 6, 1)
    rows = [
        entry("C:\\data\\edge", 1, modified=datetime(2020, 6, 1)),
        entry("C:\\data\\old", 1, modified=datetime(2020, 5, 31, 23, 59, 59)),
        entry("C:\\data\\older", 1, modified=datetime(2011, 6, 4)),
        entry("C:\\data\\empty", 0, modified=datetime(2011, 6, 4)),
    ]
    inv = inventory(spark, rows)
    got = att.run_scan("old_files", att.Inputs(inv, as_of=as_of), OPTS).collect()
    assert [(r["name"], r["detail"]) for r in got] == [("older", "10.0 years"), ("old", "1.0 years")]
    with_empty = att.old_files(inv, att.ScanOptions(ignore_empty_files=False), as_of)
    assert "C:\\data\\empty" in paths(with_empty)
    no_time = inv.withColumn("modified", inv.modified.cast("string").cast("timestamp")).selectExpr(
        "* EXCEPT (modified)", "CAST(NULL AS TIMESTAMP) AS modified"
    )
    assert paths(att.old_files(no_time, OPTS, as_of)) == []


def test_long_paths(spark):
    long = "C:\\data\\" + "x" * 252
    emoji = "C:\\data\\" + "😀" * 127
    rows = [
        entry(long + "y", 3),
        entry(long, 3),
        entry(emoji, 3),
        entry("C:\\data\\" + "d" * 260),
        entry("C:\\data\\" + "e" * 260, link=True),
    ]
    got = by_path(att.long_paths(inventory(spark, rows), OPTS))
    assert {p: (r["detail"], r["group"], r["size_bytes"]) for p, r in got.items()} == {
        long + "y": ("261", "File", 3),
        emoji: ("262", "File", 3),
        "C:\\data\\" + "d" * 260: ("268", "Directory", 0),
    }


def test_long_folder_below_the_depth_limit_is_reported(spark):
    folder = "C:\\data\\" + "d" * 260
    rows = [entry(folder), entry(folder + "\\f", 1)]
    assert paths(att.long_paths(inventory(spark, rows), att.ScanOptions(max_depth=0))) == [folder]


@pytest.mark.parametrize("opts", [OPTS, SHUFFLED])
def test_broken_links(spark, opts):
    rows = [
        entry("C:\\data\\ok", 1, link=True, target="c:\\DATA\\there"),
        entry("C:\\data\\there", 1),
        entry("C:\\data\\gone", 7, link=True, target="C:\\data\\missing"),
        entry("C:\\data\\dir", link=True, hidden=True, system=True, target="C:\\nowhere\\"),
        entry("C:\\data\\.git", link=True, target="C:\\nowhere"),
        entry("C:\\data\\dir\\below", 1, link=True, target="C:\\nowhere"),
        entry("C:\\data\\unknown", 1, link=True),
        entry("C:\\data\\folderlink", link=True, target="C:\\data\\"),
        entry("C:\\data"),
    ]
    got = by_path(att.broken_links(inventory(spark, rows), opts))
    assert {p: (r["detail"], r["size_bytes"]) for p, r in got.items()} == {
        "C:\\data\\gone": ("File symlink", 0),
        "C:\\data\\dir": ("Junction/Dir symlink", 0),
        "C:\\data\\.git": ("Junction/Dir symlink", 0),
    }


@pytest.mark.parametrize("opts", [OPTS, SHUFFLED])
def test_broken_shortcuts(spark, opts):
    rows = [
        entry("C:\\data\\a.LNK", 5, target="%Base%\\gone"),
        entry("C:\\data\\b.lnk", 5, target="%base%\\there"),
        entry("C:\\data\\there"),
        entry("C:\\data\\c.lnk", 5, target=" "),
        entry("C:\\data\\d.lnk", 5),
        entry("C:\\data\\e.txt", 5, target="C:\\gone"),
    ]
    env = spark.createDataFrame([("", "BASE", "C:\\data"), ("other", "BASE", "D:")], "root_id string, name string, value string")
    got = by_path(att.broken_shortcuts(inventory(spark, rows), env, opts))
    assert {p: r["detail"] for p, r in got.items()} == {"C:\\data\\a.LNK": "C:\\data\\gone"}
    plain = by_path(att.broken_shortcuts(inventory(spark, rows), None, opts))
    assert plain["C:\\data\\b.lnk"]["detail"] == "%base%\\there"


@pytest.mark.parametrize("opts", [OPTS, SHUFFLED])
def test_unreadable_files(spark, opts):
    rows = [entry("C:\\data\\a", 1), entry("C:\\data\\b", 2), entry("C:\\data\\.git"), entry("C:\\data\\.git\\c", 1)]
    probes = spark.createDataFrame(
        [
            ("c:\\data\\A", "unauthorized", None, None),
            ("C:\\data\\b", "ok", None, None),
            ("C:\\data\\.git\\c", "unauthorized", None, None),
        ],
        "full_path string, outcome string, hresult int, exception_name string",
    )
    got = by_path(att.unreadable_files(inventory(spark, rows), probes, opts))
    assert {p: (r["detail"], r["is_selected"]) for p, r in got.items()} == {"C:\\data\\a": ("Access denied", False)}


@pytest.mark.parametrize("opts", [OPTS, SHUFFLED])
def test_unpacked_archives(spark, opts):
    rows = [
        entry("C:\\data\\Full.zip", 9),
        entry("C:\\data\\full"),
        entry("C:\\data\\full\\A.txt", 1),
        entry("C:\\data\\full\\sub"),
        entry("C:\\data\\full\\sub\\b.txt", 1),
        entry("C:\\data\\part.ZIP", 9),
        entry("C:\\data\\part"),
        entry("C:\\data\\part\\x", 1),
        entry("C:\\data\\none.zip", 9),
        entry("C:\\data\\none"),
        entry("C:\\data\\src.tar.gz", 9),
        entry("C:\\data\\SRC"),
        entry("C:\\data\\alone.zip", 9),
        entry("C:\\data\\secret.7z", 9),
        entry("C:\\data\\secret", system=True),
    ]
    members = spark.createDataFrame(
        [
            ("C:\\data\\Full.zip", "a.TXT"),
            ("C:\\data\\Full.zip", "sub/"),
            ("C:\\data\\Full.zip", "sub/b.txt"),
            ("C:\\data\\part.ZIP", "x"),
            ("C:\\data\\part.ZIP", "y"),
            ("C:\\data\\part.ZIP", "z"),
            ("C:\\data\\none.zip", "only/"),
            ("C:\\data\\src.tar.gz", "not asked"),
        ],
        "archive_path string, entry_name string",
    )
    got = by_path(att.unpacked_archives(inventory(spark, rows), members, opts))
    assert {r["name"]: (r["detail"], r["group"]) for r in got.values()} == {
        "Full.zip": ("100% content match with Full/", "High confidence"),
        "part.ZIP": ("33% overlap with part/", "Name match"),
        "none.zip": ("Matches folder: none", "Name match"),
        "src.tar.gz": ("Matches folder: src", "Name match"),
    }
    assert len(att.unpacked_archives(inventory(spark, rows), None, opts).collect()) == 4


def test_scan_all_equals_the_single_scans(spark):
    rows = [
        entry("C:\\data"),
        entry("C:\\data\\e"),
        entry("C:\\data\\a.tmp", 0, modified=datetime(2001, 1, 1)),
        entry("C:\\data\\b.log", 5, modified=datetime(2001, 1, 1)),
        entry("C:\\data\\" + "x" * 300 + ".old", 5, modified=datetime(2001, 1, 1)),
        entry("C:\\data\\l", 5, link=True, target="C:\\gone"),
    ]
    inputs = att.Inputs(inventory(spark, rows), as_of=datetime(2021, 1, 1))
    together = sorted(map(str, att.scan_all(inputs, OPTS).collect()))
    single = []
    for name in ("unpacked_archives", "empty_folders", "big_files", "broken_links", "broken_shortcuts", "temp_files",
                 "zero_length_files", "old_files", "long_paths"):
        single += map(str, att.run_scan(name, inputs, OPTS).collect())
    assert together == sorted(single)


def test_a_scan_of_the_users_own(spark):
    @att.scanner("readme_files", "Files called readme")
    def readme_files(inputs, opts):
        from atticsweep.registry import to_results

        return to_results(att.visible(inputs.inventory, opts).filter("upper(name) LIKE 'README%'"), "readme_files")

    @att.scanner("wrong", "Not a result")
    def wrong(inputs, opts):
        return inputs.inventory

    try:
        inputs = att.Inputs(inventory(spark, [entry("C:\\data\\ReadMe.md", 1), entry("C:\\data\\b", 1)]))
        assert paths(att.run_scan("readme_files", inputs, OPTS)) == ["C:\\data\\ReadMe.md"]
        assert "readme_files" in {r["scanner"] for r in att.scan_all(inputs, OPTS, ["readme_files", "temp_files"]).collect()}
        with pytest.raises(TypeError):
            att.run_scan("wrong", inputs, OPTS)
    finally:
        att.unregister("readme_files")
        att.unregister("wrong")
    with pytest.raises(ValueError):
        att.run_scan("old_files", inputs, OPTS)
