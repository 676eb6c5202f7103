import hashlib
import random
from datetime import datetime, timedelta

import pytest
from helpers import entry, inventory
from pyspark.sql import functions as F

import atticsweep as att
from atticsweep.operators.duplicates import staged_members
from atticsweep.sources.storage import file_digest

CONTENT = "root_id string, full_path string, content binary"


def expected(files):
    """files: (path, content, modified) -> (path, group number, selected, detail)."""
    groups = {}
    for path, content, modified in files:
        if content:
            groups.setdefault((-len(content), hashlib.sha256(content).hexdigest()), []).append((modified, path))
    out = set()
    for n, (key, members) in enumerate(sorted((k, m) for k, m in groups.items() if len(m) >= 2), 1):
        for i, (_, path) in enumerate(sorted(members)):
            out.add((path, f"Group {n}", i > 0, key[1][:16] + "..."))
    return out


def found(df):
    return {(r["full_path"], r["group"], r["is_selected"], r["detail"]) for r in df.collect()}


def sample(n=200, seed=1):
    rng = random.Random(seed)
    bodies = [bytes([65 + i]) * rng.choice([1, 3, 3, 700, 5000, 5000]) for i in range(20)]
    bodies += [b"p" * 4096 + bytes([i]) for i in range(4)] + [b""]
    start = datetime(2020, 1, 1)
    return [(f"C:\\data\\f{i}", rng.choice(bodies), start + timedelta(days=rng.randrange(3))) for i in range(n)]


def tables(spark, files):
    inv = inventory(spark, [entry(p, len(c), modified=m) for p, c, m in files])
    return inv, spark.createDataFrame([("", p, bytearray(c)) for p, c, _ in files], CONTENT)


def test_groups_numbers_and_selection(spark):
    files = sample()
    inv, contents = tables(spark, files)
    assert found(att.duplicate_files(inv, contents, att.ScanOptions())) == expected(files)


def test_same_size_and_beginning_but_other_end(spark):
    files = [("C:\\data\\a", b"x" * 4096 + b"1", datetime(2020, 1, 1)), ("C:\\data\\b", b"x" * 4096 + b"2", datetime(2020, 1, 1))]
    inv, contents = tables(spark, files)
    assert found(att.duplicate_files(inv, contents, att.ScanOptions())) == set()


def test_a_file_without_content_is_left_out(spark):
    files = sample(30)
    inv, contents = tables(spark, files)
    some = contents.filter(F.col("full_path") != "C:\\data\\f3")
    assert found(att.duplicate_files(inv, some, att.ScanOptions())) == expected([f for f in files if f[0] != "C:\\data\\f3"])


def test_missing_time_counts_as_oldest(spark):
    files = [("C:\\data\\a", b"x", datetime(2020, 1, 1)), ("C:\\data\\b", b"x", datetime(2020, 1, 1))]
    inv, contents = tables(spark, files)
    inv = inv.withColumn("modified", F.when(~F.col("full_path").endswith("b"), F.col("modified")))
    rows = att.duplicate_files(inv, contents, att.ScanOptions()).collect()
    assert {r["name"]: r["is_selected"] for r in rows} == {"a": True, "b": False}


def test_roots_have_their_own_groups(spark):
    files = sample(60)
    inv, contents = tables(spark, files)
    two = [inv.withColumn("root_id", F.lit(r)) for r in "ab"], [contents.withColumn("root_id", F.lit(r)) for r in "ab"]
    got = att.duplicate_files(two[0][0].unionByName(two[0][1]), two[1][0].unionByName(two[1][1]), att.ScanOptions())
    for root in "ab":
        assert found(got.filter(F.col("root_id") == root)) == expected(files)


def test_group_numbers_are_a_row_number(spark):
    rng = random.Random(5)
    sizes = [1, 2, 1023, 1024, 1025, 4096, 4097, 1 << 33, (1 << 33) + 1, (1 << 62) + 5]
    rows = [(rng.choice("ab"), rng.choice(sizes), f"{rng.randrange(1 << 20):05x}{i:04d}") for i in range(1500)]
    groups = spark.createDataFrame(rows, "root_id string, size_bytes bigint, hash string").withColumn("keep_path", F.lit("p"))
    got = {(r["root_id"], r["size_bytes"], r["hash"]): r["group_no"] for r in att.number_groups(groups).collect()}
    for root in "ab":
        ordered = sorted((r for r in rows if r[0] == root), key=lambda r: (-r[1], r[2]))
        assert [got[r] for r in ordered] == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize("limit, hot", [(0, 1), (1 << 20, 1), (200, 25), (200, 1)])
def test_large_groups_are_joined_apart(spark, limit, hot):
    files = sample(150)
    members = spark.createDataFrame(
        [("", p, len(c), m, hashlib.sha256(c).hexdigest()) for p, c, m in files if c],
        "root_id string, full_path string, size_bytes bigint, modified timestamp, hash string",
    )
    groups = att.number_groups(att.hash_groups(members, F.col("hash")))
    rows = att.keep_oldest(members, groups, limit, hot).collect()
    got = {(r["full_path"], f"Group {r['group_no']}", r["is_selected"], r["hash"][:16] + "...") for r in rows}
    assert got == expected(files) and len(rows) == len(got)


@pytest.fixture
def folder(tmp_path):
    files = sample(80, seed=7)
    out = []
    for i, (_, content, modified) in enumerate(files):
        path = tmp_path / f"f{i}"
        path.write_bytes(content)
        out.append((str(path), content, modified))
    return tmp_path, out


def test_reading_files_in_stages(spark, folder):
    root, files = folder
    rows = [entry(p, len(c), modified=m) for p, c, m in files] + [entry(str(root / "gone"), 3)]
    inv = inventory(spark, rows, "/", str(root))
    opts = att.ScanOptions(sep="/")
    assert found(att.duplicate_files(inv, None, opts)) == expected(files)


def test_stages_read_no_more_than_needed(spark, folder):
    root, files = folder
    seen = []

    def digest_of(df, prefix_bytes):
        rows = [r.asDict() for r in df.collect()]
        seen.append((prefix_bytes, {r["full_path"] for r in rows}))
        rows = [{**r, "hash": file_digest(r["full_path"], prefix_bytes)} for r in rows]
        return spark.createDataFrame(rows, df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", hash string")

    inv = inventory(spark, [entry(p, len(c), modified=m) for p, c, m in files if c], "/", str(root))
    staged_members(att.candidate_files(inv, att.ScanOptions(sep="/")), digest_of).collect()
    (first, sized), (second, begun) = seen
    assert first == 4096 and second is None
    sizes = [len(c) for _, c, _ in files]
    assert sized == {p for p, c, _ in files if c and sizes.count(len(c)) >= 2}
    begins = [(len(c), c[:4096]) for _, c, _ in files]
    assert begun == {p for p, c, _ in files if c and begins.count((len(c), c[:4096])) >= 2}


def test_only_files_in_company_are_digested(spark, monkeypatch):
    """Unique sizes are never digested, and unique beginnings never in full."""
    from atticsweep.operators import duplicates

    start = datetime(2020, 1, 1)
    files = [(f"C:\\data\\alone{i}", b"s" * (10 + i), start) for i in range(50)]  # sizes of their own
    files += [(f"C:\\data\\begin{i}", bytes([65 + i]) * 6000, start) for i in range(20)]  # one size, other beginnings
    files += [(f"C:\\data\\end{i}", b"x" * 5000 + bytes([i // 2]), start) for i in range(10)]  # pairs
    inv, contents = tables(spark, files)
    asked = []

    def watched(contents, some, prefix, opts, real=duplicates.content_digests):
        asked.append((prefix, sorted(r["full_path"] for r in some.collect())))
        return real(contents, some, prefix, opts)

    monkeypatch.setattr(duplicates, "content_digests", watched)
    for limit in (64 << 20, 0):
        asked.clear()
        assert found(att.duplicate_files(inv, contents, att.ScanOptions(broadcast_bytes=limit))) == expected(files)
        (first, begun), (second, whole) = asked
        assert (first, second) == (4096, None)
        assert len(begun) == 30 and not any("alone" in p for p in begun)
        assert len(whole) == 10 and all("end" in p for p in whole)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_contents_do_not_move_and_groups_are_hashed(spark, tmp_path, limit):
    from atticsweep.operators import duplicates

    inv, contents = tables(spark, sample(40))
    contents.write.parquet(str(tmp_path / "contents"))
    opts = att.ScanOptions(broadcast_bytes=limit)
    files = duplicates.candidate_files(inv, opts)
    digests = duplicates.content_digests(spark.read.parquet(str(tmp_path / "contents")), files, 4096, opts)
    plan = digests._jdf.queryExecution().optimizedPlan().toString()
    join, digest = plan.index("Join"), plan.index("sha2")
    # Few files: digests above a broadcast join, contents where they are. Many: digests below the join.
    assert (digest < join) if limit else (digest > join)
    members = digests.select("root_id", "full_path", "size_bytes", "modified", "hash")
    groups = duplicates.number_groups(duplicates.hash_groups(members, F.col("hash"), limit))
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and ("BroadcastHashJoin" in plan) <= bool(limit)


def test_oldest_of_a_group(spark):
    start = datetime(2020, 1, 1)
    files = [("C:\\data\\b", b"x", start), ("C:\\data\\a", b"x", start), ("C:\\data\\c", b"x", start + timedelta(days=1)), ("C:\\data\\d", b"yy", start)]
    inv, contents = tables(spark, files)
    members = att.candidate_files(inv, att.ScanOptions()).withColumn("hash", F.when(F.col("size_bytes") == 1, "h").otherwise("g"))
    assert [(r.n, r.keep_path) for r in att.hash_groups(members, F.col("hash")).collect()] == [(3, "C:\\data\\a")]
