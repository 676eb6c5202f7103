from datetime import datetime

import pytest
from pyspark.sql import functions as F

import atticsweep as att
from atticsweep.functions import paths
from atticsweep.operators.access import access_reason
from atticsweep.operators.archives import archive_base_name
from atticsweep.operators.links import expand_variables
from atticsweep.operators.rowlocal import temp_reason


def values(spark, rows, column, *exprs, schema=None):
    df = spark.createDataFrame([(r,) for r in rows], schema or f"{column} string")
    return [tuple(r) if len(exprs) > 1 else r[0] for r in df.select(*exprs).collect()]


def test_path_parts_with_backslash(spark):
    c = F.col("p")
    got = values(spark, ["C:\\a\\b.txt", "C:\\x", "plain"], "p", att.name_of(c, "\\"), att.parent_of(c, "\\"), att.depth_of(c, "\\"))
    assert got == [("b.txt", "C:\\a", 2), ("x", "C:", 1), ("plain", "", 0)]


def test_depth_below_root(spark):
    got = values(spark, ["/vol", "/vol/a", "/vol/a/b"], "p", att.depth_of(F.col("p"), "/", "/vol"))
    assert got == [0, 1, 2]


@pytest.mark.parametrize(
    "name, ext, stem",
    [("a.TXT", ".TXT", "a"), ("a.b.c", ".c", "a.b"), ("a", "", "a"), ("a.", "", "a"), (".git", ".git", "")],
)
def test_extension_and_stem(spark, name, ext, stem):
    assert values(spark, [name], "n", att.extension_of(F.col("n")), paths.stem_of(F.col("n"))) == [(ext, stem)]


def test_utf16_length(spark):
    assert values(spark, ["a😀", "äb", ""], "t", paths.utf16_length(F.col("t"))) == [3, 2, 0]


def test_ancestors(spark):
    df = spark.createDataFrame([("C:\\A\\B\\C", 3), ("C:", 0)], "key string, depth int")

    def chain(lowest):
        rows = df.select("key", "depth", F.explode(paths.levels(F.col("depth"), lowest)).alias("level"))
        above = paths.ancestor(F.col("key"), F.col("depth"), F.col("level"), "\\")
        return [tuple(r) for r in rows.select("level", above).collect()]

    assert chain(0) == [(0, "C:"), (1, "C:\\A"), (2, "C:\\A\\B"), (3, "C:\\A\\B\\C"), (0, "C:")]
    assert chain(2) == [(2, "C:\\A\\B"), (3, "C:\\A\\B\\C")]


@pytest.mark.parametrize(
    "pattern, name, expected",
    [
        ("*.tmp", "a.tmp", True),
        ("*.tmp", "A.TMP", True),
        ("*.tmp", "a.tmp.tmp", False),  # leftmost place, no second try
        ("._*", "._x", True),
        ("._*", "x._", False),
        ("*mid*", "amidb", True),
        ("a*b*c", "a1b2c", True),
        ("a*b*c", "ab1bc", True),
        ("a*b", "abxb", False),
        ("*", "", True),
        ("a(1)*.t", "A(1)x.T", True),
        ("a*", "a\nb", True),
    ],
)
def test_wildcards(spark, pattern, name, expected):
    assert values(spark, [name], "n", att.wildcard_match(F.col("n"), pattern)) == [expected]


def leftmost(name, pattern):
    """The matching rule step by step."""
    name, pieces, at = name.upper(), pattern.upper().split("*"), 0
    for i, piece in enumerate(pieces):
        if not piece:
            continue
        found = name.find(piece, at)
        if found < 0 or (i == 0 and found != 0):
            return False
        at = found + len(piece)
    return pattern.endswith("*") or at == len(name)


def test_wildcards_against_the_rule(spark):
    from itertools import product

    names = ["".join(p) for n in range(5) for p in product("ab.", repeat=n)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    patterns = ["*a", "a*", "*a*", "a*b", "ab*b", "*a*b", "*.a", "a*.b*", "**a", "*a.*b"]
    rows = df.select("n", *[att.wildcard_match(F.col("n"), p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for r in rows:
        for i, p in enumerate(patterns):
            assert r[f"p{i}"] == leftmost(r["n"], p), (r["n"], p)


def test_ignored_files(spark):
    df = spark.createDataFrame([("Thumbs.DB", 5), ("._a", 5), ("x", 0), ("x", 1)], "n string, s bigint")
    ignored = [r[0] for r in df.select(att.is_ignored(F.col("n"), F.col("s"), att.ScanOptions())).collect()]
    assert ignored == [True, True, True, False]
    opts = att.ScanOptions(ignore_empty_files=False, ignored_files=("", "x"))
    assert [r[0] for r in df.select(att.is_ignored(F.col("n"), F.col("s"), opts)).collect()] == [False, False, True, True]
    none = att.ScanOptions(ignore_empty_files=False, ignored_files=())
    assert not any(r[0] for r in df.select(att.is_ignored(F.col("n"), F.col("s"), none)).collect())


def test_size_bounds(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (11,)], "s bigint")
    kept = lambda lo, hi: [r[0] for r in df.filter(att.size_between(F.col("s"), lo, hi)).collect()]
    assert kept(0, 0) == [1, 10, 11]
    assert kept(10, 0) == [10, 11]
    assert kept(0, 10) == [1, 10]


def test_size_text(spark):
    sizes = [-1, 0, 1023, 1024, 1280, 1 << 20, 1 << 30, 5 << 40]
    got = values(spark, sizes, "s", att.format_size(F.col("s")), schema="s bigint")
    assert got == ["", "0 B", "1023 B", "1.0 KB", "1.3 KB", "1.0 MB", "1.00 GB", "5120.00 GB"]


def test_time_text(spark):
    got = values(spark, [datetime(2020, 2, 3, 4, 5, 59), None], "t", att.format_modified(F.col("t")), schema="t timestamp")
    assert got == ["2020-02-03 04:05", ""]


def test_attribute_bits(spark):
    df = spark.createDataFrame([(0x10 | 0x400,), (0x06,)], "b bigint")
    got = [tuple(r[0]) for r in df.select(att.decode_attributes(F.col("b"))).collect()]
    assert got == [(True, False, False, True), (False, True, True, False)]


def test_size_and_time_halves(spark):
    df = spark.createDataFrame([(1, -1, 0, 0), (0, 7, 27111902, -717324288)], "hi int, lo int, th int, tl int")
    got = df.select(
        att.decode_size(F.col("hi"), F.col("lo")), att.decode_filetime(F.col("th"), F.col("tl"))
    ).collect()
    assert got[0][0] == (1 << 32) + 0xFFFFFFFF and got[0][1] is None
    assert got[1][0] == 7 and got[1][1] == datetime(1970, 1, 1)


@pytest.mark.parametrize(
    "name, reason",
    [
        ("a.BaK", "Temp extension (.BaK)"),
        ("~$a.tmp", "Temp extension (.tmp)"),
        ("THUMBS.db", "Windows thumbnail cache"),
        ("desktop.INI", "Windows folder settings"),
        (".DS_Store", "macOS metadata"),
        ("._x", "macOS resource fork"),
        ("~$x.docx", "Office lock file"),
        ("~x", "Temp/backup file"),
        ("ETILQS_1", "SQLite temp file"),
        ("a.~", "Temp extension (.~)"),
        ("a.txt", None),
    ],
)
def test_temp_rules(spark, name, reason):
    assert values(spark, [name], "n", temp_reason(F.col("n"))) == [reason]


@pytest.mark.parametrize(
    "name, base",
    [("a.zip", "a"), ("a.tar.GZ", "a"), ("a.TAR.xz", "a"), ("a.tar", "a"), ("a.tar.zip", "a.tar"), ("a.b.7z", "a.b"), (".zip", "")],
)
def test_archive_base_name(spark, name, base):
    assert values(spark, [name], "n", archive_base_name(F.col("n"))) == [base]


def test_access_reasons(spark):
    rows = [
        ("unauthorized", None, None, "Access denied"),
        ("io", -2147024864, None, "Locked by another process"),
        ("io", -2147024863, None, "Lock violation"),
        ("io", -2147024809, None, "I/O error (0x80070057)"),
        ("other", None, "NotSupportedException", "NotSupportedException"),
        ("ok", None, None, None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "o string, h int, e string")
    got = [r[0] for r in df.select(access_reason(F.col("o"), F.col("h"), F.col("e"))).collect()]
    assert got == [r[3] for r in rows]


def test_variables_in_targets(spark):
    env = F.create_map(F.lit("A"), F.lit("1%B%"), F.lit("B"), F.lit("2"), F.lit("P(X)"), F.lit("$\\"))
    texts = ["%a%\\x", "%no%\\x", "%no%b%", "100%", "%A%%B%", "x", "%%", "%p(x)%", "%no%a%b%"]
    got = values(spark, texts, "t", expand_variables(F.col("t"), env))
    assert got == ["1%B%\\x", "%no%\\x", "%no2", "100%", "1%B%2", "x", "%%", "$\\", "%no1%B%b%"]
