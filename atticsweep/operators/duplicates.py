"""Files with the same content.

Sizes, then the digest of the first 4 KiB, then that of all bytes narrow the files down:
each stage digests only what the one before left over. With a table of contents, the
files that are left are a measured key set. While it may be broadcast, contents are met
where they are read, and only those are digested. A larger one would move contents, so
then digests are made where contents are read, and only these meet the key set.

One size, and one group of copies, may hold a large part of all rows. Groups are
therefore built by aggregation (partial per task), never by a window over members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atticsweep.functions import match, paths
from atticsweep.operators import prune
from atticsweep.operators.lookup import KeySet, join_keys, settled
from atticsweep.registry import scanner, to_results
from atticsweep.schema import ScanOptions
from atticsweep.session import written
from atticsweep.sources.storage import PREFIX_BYTES, read_digests

# Bits of a size kept to tell size classes apart: at most 64 * 2^10 classes.
CLASS_BITS = 10
PREFIX_DIGITS = 4
HOT_COPIES = 1_000_000
NO_TIME = -(1 << 63)


def _in_company(rows: DataFrame, keys: list[str], limit_bytes: int) -> DataFrame:
    """Rows whose keys another row has as well."""
    shared = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    shared = shared.select(*[F.col(k).alias(f"key_{k}") for k in keys])
    known = settled(shared, limit_bytes)
    return join_keys(rows, [F.col(k) for k in keys], known, "left_semi")


def size_candidates(files: DataFrame, limit_bytes: int = ScanOptions.broadcast_bytes) -> DataFrame:
    """Files that share their size with another file of the same root."""
    return _in_company(files, ["root_id", "size_bytes"], limit_bytes)


def hash_groups(members: DataFrame, digest: Column, limit_bytes: int = ScanOptions.broadcast_bytes) -> DataFrame:
    """Groups of two or more files with one size and digest: count, bytes, and the file to keep.

    The oldest stays, a file without a time before all others; of several the first by path.
    Times are numbers here; paths are looked at only where the oldest of a group tie.
    """
    keys = ["root_id", "size_bytes", "hash"]
    age = F.coalesce(F.unix_micros("modified"), F.lit(NO_TIME))
    rows = members.select("root_id", "size_bytes", digest.alias("hash"), "full_path", age.alias("age"))
    counted = rows.groupBy(*keys).agg(F.min("age").alias("oldest"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    several = settled(counted.select(*[F.col(k).alias(f"key_{k}") for k in keys], F.col("oldest").alias("key_oldest"), "n"), limit_bytes)
    oldest = join_keys(rows, [*[F.col(k) for k in keys], F.col("age")], several, "inner")
    # Each task drops what cannot be first before rows are exchanged.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("full_path"))
    first = oldest.withColumn("place", place).filter(F.col("place") == 1)
    return first.select(*keys, "n", F.col("full_path").alias("keep_path"))


def _running_total(df: DataFrame, within: list[str], order: list[Column]) -> Column:
    """How many groups come before this row among its siblings."""
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n_groups").over(before), F.lit(0).cast("bigint"))


def number_groups(groups: DataFrame) -> DataFrame:
    """``group_no`` from 1 per root, by size (largest first) and then digest.

    A plain ``row_number`` would put all groups of a root into one task. Instead
    groups are counted per size class, size and digest beginning, running totals of
    these counts give each bucket its first number, and only a bucket is numbered
    row by row. A bucket has one size and 16 bits of the digest in common.
    """
    width = F.greatest(F.length(F.bin("size_bytes")) - F.lit(CLASS_BITS), F.lit(0))
    in_class = F.expr(f"shiftright(size_bytes, cast(greatest(length(bin(size_bytes)) - {CLASS_BITS}, 0) as int))")
    coded = groups.withColumn("class", width.cast("bigint") * F.lit(1 << CLASS_BITS) + in_class).withColumn(
        "begin", F.substring("hash", 1, PREFIX_DIGITS)
    )
    per_begin = coded.groupBy("root_id", "class", "size_bytes", "begin").agg(F.count(F.lit(1)).alias("n_groups"))
    per_size = per_begin.groupBy("root_id", "class", "size_bytes").agg(F.sum("n_groups").alias("n_groups"))
    per_class = per_size.groupBy("root_id", "class").agg(F.sum("n_groups").alias("n_groups"))

    class_first = per_class.select(
        "root_id", "class", _running_total(per_class, ["root_id"], [F.col("class").desc()]).alias("class_first")
    )
    size_first = per_size.select(
        "root_id",
        "class",
        "size_bytes",
        _running_total(per_size, ["root_id", "class"], [F.col("size_bytes").desc()]).alias("size_first"),
    )
    begin_first = per_begin.select(
        "root_id",
        "class",
        "size_bytes",
        "begin",
        _running_total(per_begin, ["root_id", "class", "size_bytes"], [F.col("begin")]).alias("begin_first"),
    )
    first = begin_first.join(size_first.hint("merge"), ["root_id", "class", "size_bytes"]).join(class_first.hint("merge"), ["root_id", "class"])
    in_bucket = F.row_number().over(Window.partitionBy("root_id", "class", "size_bytes", "begin").orderBy("hash"))
    return (
        coded.withColumn("in_bucket", in_bucket)
        .join(first.hint("merge"), ["root_id", "class", "size_bytes", "begin"])
        .withColumn("group_no", F.col("class_first") + F.col("size_first") + F.col("begin_first") + F.col("in_bucket"))
        .select(*groups.columns, "group_no")
    )


def keep_oldest(members: DataFrame, groups: DataFrame, limit_bytes: int = 0, hot: int = HOT_COPIES) -> DataFrame:
    """Members with their group's columns and ``is_selected``: true for all but the oldest copy.

    A group list that may be broadcast is. Of a larger one, only groups with at least
    ``hot`` copies are (there are at most as many as members / ``hot``); their members
    stay out of the shuffle, in which each key then has fewer rows than that.
    """
    keys = ["root_id", "size_bytes", "hash"]

    def joined(rows: DataFrame, to: DataFrame) -> DataFrame:
        return rows.join(to, keys).withColumn("is_selected", F.col("full_path") != F.col("keep_path"))

    known = settled(groups, limit_bytes)
    if known.small:
        return joined(members, known.hinted())
    large = settled(known.df.filter(F.col("n") >= hot), limit_bytes)
    if not large.small:
        return joined(members, known.hinted())
    rest = members.join(F.broadcast(large.df.select(*keys)), keys, "left_anti")
    rare = known.df.filter(F.col("n") < hot)
    return joined(members, large.hinted()).unionByName(joined(rest, rare.hint("merge")))


def _keyed_contents(contents: DataFrame, opts: ScanOptions) -> DataFrame:
    root = F.col("root_id") if "root_id" in contents.columns else F.lit("")
    return contents.filter(F.col("content").isNotNull()).select(
        root.alias("digest_root"), opts.key(F.col("full_path"), root).alias("digest_key"), F.col("content").cast("binary").alias("content")
    )


def content_digests(contents: DataFrame, files: DataFrame, prefix_bytes: int | None, opts: ScanOptions) -> DataFrame:
    """``files`` that have contents, with ``hash``: of the first ``prefix_bytes``, or of all bytes."""
    keyed = _keyed_contents(contents, opts)
    taken = F.col("content") if prefix_bytes is None else F.substring("content", 1, prefix_bytes)
    known = files.select(F.col("root_id").alias("key_root"), opts.key(F.col("full_path")).alias("key_path"), *[F.col(c).alias(f"file_{c}") for c in files.columns])
    known = settled(known, opts.broadcast_bytes)
    digest = F.sha2(taken, 256).alias("hash")
    if not known.small:
        keyed = keyed.select("digest_root", "digest_key", digest)
        digest = F.col("hash")
    met = join_keys(keyed, [F.col("digest_root"), F.col("digest_key")], known, "inner")
    return met.select(*[F.col(f"file_{c}").alias(c) for c in files.columns], digest)


def candidate_files(inv: DataFrame, opts: ScanOptions, blocked: KeySet | None = None) -> DataFrame:
    """Visible, non-empty files within the size bounds."""
    sized = prune.files(inv).filter(match.size_between(F.col("size_bytes"), opts.min_size, opts.max_size))
    return prune.listed(sized, inv, opts, blocked).select("root_id", "full_path", "size_bytes", "modified")


def staged_members(
    files: DataFrame, digest_of=read_digests, limit_bytes: int = ScanOptions.broadcast_bytes
) -> DataFrame:
    """Candidates with a full digest, each stage reading only what the one before left over.

    ``digest_of(files, prefix_bytes)`` adds ``hash``, NULL for unreadable files.
    """
    sized = size_candidates(files, limit_bytes)
    # Each stage is read twice, once to find what has company; what it has read is not read again.
    begun = written(digest_of(sized, PREFIX_BYTES).filter(F.col("hash").isNotNull()).withColumnRenamed("hash", "begin_hash"))
    left_over = _in_company(begun, ["root_id", "size_bytes", "begin_hash"], limit_bytes).drop("begin_hash")
    return digest_of(left_over, None).filter(F.col("hash").isNotNull())


@scanner(
    "duplicate_files",
    "Files with equal content",
    columns=(
        ("Name", "name"),
        ("Path", "full_path"),
        ("Size", "size_bytes"),
        ("Modified", "modified"),
        ("Group", "group"),
    ),
    order=lambda sep: [
        F.col("size_bytes").desc(),
        F.regexp_extract("group", r"(\d+)$", 1).cast("bigint"),
        F.col("modified").asc(),
    ],
    run=lambda i, o, blocked: duplicate_files(i.inventory, i.contents, o, blocked),
    needs=("contents",),
)
def duplicate_files(
    inv: DataFrame, contents: DataFrame | None, opts: ScanOptions, blocked: KeySet | None = None
) -> DataFrame:
    """Groups of files with equal SHA-256 in a root; all but the oldest of each are selected.

    ``contents`` is (root_id, full_path, content), or None to read the files at
    their paths. Files without content are left out.
    """
    # Candidates are counted by size and then narrowed down; the walk rules are worked out once.
    files = written(candidate_files(inv, opts, blocked))
    digest_of = read_digests if contents is None else lambda some, prefix: content_digests(contents, some, prefix, opts)
    members = staged_members(files, digest_of, opts.broadcast_bytes)
    # Grouping, numbering and the final join all start here.
    members = written(members.select("root_id", "full_path", "size_bytes", "modified", "hash"))
    groups = number_groups(written(hash_groups(members, F.col("hash"), opts.broadcast_bytes)))
    return to_results(
        keep_oldest(members, groups, opts.broadcast_bytes),
        "duplicate_files",
        name=paths.name_of(F.col("full_path"), opts.sep),
        group=F.concat(F.lit("Group "), F.col("group_no").cast("string")),
        detail=F.concat(F.substring("hash", 1, 16), F.lit("...")),
        is_directory=F.lit(False),
        selected=F.col("is_selected"),
    )
