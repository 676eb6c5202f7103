import io
import os
import random
import zipfile
from datetime import datetime

import pytest
from helpers import entry, inventory

import atticsweep as att
from atticsweep.sources import export, idtree, storage

NODES = "frn bigint, parent_frn bigint, name string"


def walk_up(nodes, start):
    """One chain, one step at a time."""
    parts, passed, at = [], set(), start
    while at in nodes:
        if at in passed:
            break
        passed.add(at)
        parent, name = nodes[at]
        parts.append(name)
        if parent == at or parent < 5:
            break
        at = parent
    return "C:\\" + "\\".join(reversed(parts))


def resolved(spark, nodes, **settings):
    df = spark.createDataFrame([(i, p, n) for i, (p, n) in nodes.items()], NODES)
    return {r["frn"]: r["path"] for r in att.resolve_paths(df, "C:", **settings).collect()}


def test_chains_cycles_and_ends(spark):
    nodes = {
        5: (5, "root"),  # its own parent
        10: (5, "a"),
        11: (10, "b"),
        20: (3, "reserved"),
        3: (10, "low"),
        30: (99, "dangling"),
        40: (41, "c1"),
        41: (42, "c2"),
        42: (40, "c3"),
        43: (40, "into cycle"),
        44: (43, "deeper"),
        50: (51, "p1"),
        51: (50, "p2"),
    }
    for i in range(100, 170):
        nodes[i] = (i - 1 if i > 100 else 11, f"d{i}")
    assert resolved(spark, nodes) == {i: walk_up(nodes, i) for i in nodes}


def test_random_graphs(spark):
    rng = random.Random(11)
    nodes = {i: (rng.randrange(1, 60), f"n{i}") for i in range(1, 58)}
    assert resolved(spark, nodes) == {i: walk_up(nodes, i) for i in nodes}


def test_masked_ids_and_the_last_record(spark):
    rows = [(10 | (1 << 48), 5, "old", 1), (10 | (1 << 48), 5, "new", 2), (11, 10 | (7 << 48), "x", 3)]
    df = spark.createDataFrame(rows, NODES + ", seq bigint")
    assert {r["frn"]: r["path"] for r in att.resolve_paths(df, "C:").collect()} == {10: "C:\\new", 11: "C:\\new\\x"}
    reused = spark.createDataFrame([(10 | (2 << 48), 5, "second"), (10 | (1 << 48), 5, "first")], NODES)
    assert [r["path"] for r in att.resolve_paths(reused, "C:").collect()] == ["C:\\second"]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_hot_folders_and_ends(spark, limit):
    """Most files in one folder, most folders below one end; and with nothing broadcast."""
    nodes = {9: (5, "top"), 10: (9, "hot")} | {1000 + i: (10, f"f{i}") for i in range(200)}
    nodes |= {100 + i: (10, f"d{i}") for i in range(50)} | {2000 + i: (100 + i % 50, f"g{i}") for i in range(100)}
    nodes |= {20: (21, "x"), 21: (20, "y")} | {3000 + i: (20, f"h{i}") for i in range(40)} | {4000: (3000, "below")}
    assert resolved(spark, nodes, hot=30, limit_bytes=limit) == {i: walk_up(nodes, i) for i in nodes}


def test_ties_of_records_and_facts(spark):
    rows = [(10, 5, "b", 1, 7), (10, 6, "a", 1, 8), (10, 6, "c", 1, 9), (10, 9, "z", None, 1), (11, 10, "leaf", 2, 3)] * 2
    df = spark.createDataFrame(rows, NODES + ", seq bigint, size_bytes bigint")
    got = sorted((r["frn"], r["path"], r["size_bytes"]) for r in att.resolve_paths(df, "C:", facts=("size_bytes",)).collect())
    assert got == [(10, "C:\\c", 9), (11, "C:\\c\\leaf", 3)]
    assert att.resolve_paths(df.limit(0), "C:").count() == 0


def test_records_are_found_in_hash_aggregates(spark, tmp_path):
    spark.createDataFrame([(10, 5, "a"), (10, 5, "b"), (11, 10, "c")], NODES).write.parquet(str(tmp_path / "n"))
    df = idtree.latest_records(spark.read.parquet(str(tmp_path / "n")))
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 2


def test_id_tree_as_inventory(spark):
    nodes = spark.createDataFrame([(10, 5, "d", 0x10), (11, 10, "f", 0)], NODES + ", attributes bigint")
    inv = att.inventory_from_table(idtree.inventory_rows(nodes, "C:"), "\\", "C:")
    got = sorted((r["full_path"], r["depth"], r["is_directory"], r["parent_path"]) for r in inv.collect())
    assert got == [("C:\\d", 1, True, "C:"), ("C:\\d\\f", 2, False, "C:\\d")]


def test_inventory_from_any_table(spark):
    df = spark.createDataFrame([("C:\\",), ("c:\\A\\b.txt",), ("C:\\A\\.",), ("D:\\x",)], "full_path string")
    got = sorted((r["full_path"], r["name"], r["parent_path"], r["depth"]) for r in att.inventory_from_table(df, "\\", "C:\\").collect())
    assert got == [("C:", "C:", "", 0), ("c:\\A\\b.txt", "b.txt", "c:\\A", 2)]
    free = att.inventory_from_table(df.filter("full_path LIKE 'D%'")).collect()[0]
    assert (free["depth"], free["root_id"], free["size_bytes"], free["is_directory"]) == (1, "", 0, False)


@pytest.fixture
def tree(tmp_path):
    for folder in ("a/b/c", "a/empty", ".hidden", "z"):
        (tmp_path / folder).mkdir(parents=True)
    for i, path in enumerate(["a/f.txt", "a/b/_g", "a/b/c/.h", "z/zero", ".hidden/x"]):
        (tmp_path / path).write_bytes(b"x" * i)
    os.symlink("../a/f.txt", tmp_path / "z/link")
    os.symlink("nowhere", tmp_path / "z/broken")
    os.symlink(tmp_path / "a", tmp_path / "z/dirlink")
    return tmp_path


def listing(df):
    return sorted(
        (r["full_path"], r["depth"], r["is_directory"], r["size_bytes"], r["is_reparse_point"], r["is_hidden"], r["link_target"])
        for r in df.collect()
        if not r["is_reparse_point"] or r["link_target"]
    )


def test_listing_of_shared_storage(spark, tree):
    storage.register(spark)
    root = str(tree)
    level_by_level = listing(att.walk_storage(spark, root))
    found = {p[len(root) :]: rest for p, *rest in level_by_level}
    assert set(found) == {
        "", "/a", "/a/b", "/a/b/c", "/a/empty", "/.hidden", "/z", "/a/f.txt", "/a/b/_g", "/a/b/c/.h", "/z/zero",
        "/.hidden/x", "/z/link", "/z/broken", "/z/dirlink",
    }
    assert found["/a/b/c/.h"][:3] == [4, False, 2] and found["/z/dirlink"][1] and found["/z/dirlink"][3]
    assert found["/z/link"][5] == root + "/a/f.txt"
    for n in (1, 3, 64):
        source = spark.read.format("inventory").option("path", root).option("numPartitions", n).load()
        assert listing(source) == level_by_level


def test_scans_on_a_listing(spark, tree):
    inv = att.inventory_from_table(att.walk_storage(spark, str(tree)).drop("depth"), "/", str(tree))
    opts = att.ScanOptions(sep="/")
    assert [r["name"] for r in att.broken_links(inv, opts).collect()] == ["broken"]
    assert [r["name"] for r in att.empty_folders(inv, opts).collect()] == ["empty"]
    strict = {r["name"] for r in att.empty_folders(inv, att.ScanOptions(sep="/", ignored_files=())).collect()}
    assert "empty" in strict and "a" not in strict


def test_contents_and_digests(spark, tree):
    paths = [str(tree / p) for p in ("a/f.txt", "a/b/_g", "missing")]
    files = spark.createDataFrame([("", p, 1) for p in paths], "root_id string, full_path string, size_bytes bigint")
    read = {r["full_path"]: bytes(r["content"]) for r in att.contents(files).collect()}
    assert read == {paths[0]: b"", paths[1]: b"x"}
    hashes = {r["full_path"]: r["hash"] for r in storage.read_digests(files).collect()}
    assert hashes[paths[2]] is None and hashes[paths[0]].startswith("e3b0c442")


def zipped(names):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for name in names:
            archive.writestr(name, "x")
    return data.getvalue()


def test_archive_members(spark, tmp_path):
    good, bad = zipped(["d/", "d/a.txt", "b"]), b"no zip"
    df = spark.createDataFrame(
        [("r", "/1.zip", bytearray(good)), ("r", "/2.zip", bytearray(bad))], "root_id string, full_path string, content binary"
    )
    got = sorted(tuple(r) for r in att.archive_members(df).collect())
    assert got == [("r", "/1.zip", "b"), ("r", "/1.zip", "d/a.txt")]
    (tmp_path / "3.zip").write_bytes(good)
    on_disk = spark.createDataFrame([("r", str(tmp_path / "3.zip")), ("r", str(tmp_path / "4.zip"))], "root_id string, full_path string")
    assert sorted(r["entry_name"] for r in att.archive_members(on_disk).collect()) == ["b", "d/a.txt"]


def results(spark):
    rows = [
        entry("C:\\data\\plain.tmp", 5),
        entry('C:\\data\\quo"te, comma.tmp', 2048),
        entry("C:\\data\\line\nbreak.tmp", 0),
        entry("C:\\data\\ padded .tmp", 7, modified=datetime(2020, 5, 6, 7, 8, 9)),
    ]
    return att.temp_files(inventory(spark, rows), att.ScanOptions())


def test_csv_round_trip(spark, tmp_path):
    found = results(spark)
    att.export_csv(found, str(tmp_path / "csv"))
    back = sorted(map(tuple, export.read_csv_export(spark, str(tmp_path / "csv")).collect()))
    assert back == sorted(map(tuple, export.csv_rows(found).collect()))
    assert ("True", 'quo"te, comma.tmp', 'C:\\data\\quo"te, comma.tmp', 2048, "2020-01-01 00:00", "Temp extension (.tmp)", "") in back
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"Selected","Name","Path","Size","Modified","Detail","Group"' in text and 'quo""te' in text


def test_json_round_trip(spark, tmp_path):
    found = results(spark)
    att.export_json(found, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    fields = ["Name", "FullPath", "SizeBytes", "Size", "Modified", "Detail", "Group", "IsSelected", "IsDirectory"]
    assert sorted(back.columns) == sorted(fields)
    assert sorted(map(tuple, back.select(fields).collect())) == sorted(map(tuple, export.json_rows(found).collect()))


def test_listing_keeps_entries_beside_bad_ones(tmp_path, monkeypatch):
    from atticsweep.sources import storage

    for name in "abcde":
        (tmp_path / name).write_text(name)
    (tmp_path / "link").symlink_to(tmp_path / "a")

    def refuse(path, **_):
        raise OSError(path)

    monkeypatch.setattr(storage.os, "readlink", refuse)
    rows = {r[2]: r for r in storage.list_folder("", str(tmp_path), 1)}
    assert sorted(rows) == ["a", "b", "c", "d", "e", "link"] and not rows["link"][-1] and rows["a"][-1]
    for missing in (str(tmp_path / "none"), f"file://{tmp_path}/none"):
        ((_, path, *_, readable),) = list(storage.list_folder("", missing, 1))
        assert path == missing and not readable
