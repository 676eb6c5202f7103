"""Archives that lie next to the folder they were unpacked into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.functions import match, paths
from atticsweep.operators import prune
from atticsweep.operators.existence import found_paths, of_kind
from atticsweep.operators.lookup import KeySet, join_keys, settled
from atticsweep.registry import scanner, to_results
from atticsweep.schema import ScanOptions
from atticsweep.session import written

# Archive extensions, those that may follow .tar, and the share of
# members in percent from which a match counts as certain.
ARCHIVE_EXTENSIONS = (".zip", ".7z", ".rar", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".cab", ".iso")
AFTER_TAR = (".gz", ".bz2", ".xz")
CERTAIN_PERCENT = 80


def archive_base_name(name: Column) -> Column:
    """The name without its archive extension, and without ``.tar`` before a compression one."""
    stem = paths.stem_of(name)
    double = match.name_in(paths.extension_of(name), AFTER_TAR) & match.name_in(paths.extension_of(stem), (".tar",))
    return F.when(double, paths.stem_of(stem)).otherwise(stem)


@scanner(
    "unpacked_archives",
    "Archives that seem to be unpacked already",
    columns=(
        ("Archive", "name"),
        ("Path", "full_path"),
        ("Size", "size_bytes"),
        ("Match", "detail"),
        ("Modified", "modified"),
    ),
    run=lambda i, o, blocked: unpacked_archives(i.inventory, i.members, o, blocked),
)
def unpacked_archives(
    inv: DataFrame, members: DataFrame | None, opts: ScanOptions, blocked: KeySet | None = None
) -> DataFrame:
    """Archives whose base name is a visible sibling folder.

    For ``.zip`` files in ``members`` (root_id, archive_path, entry_name) the share
    of member files that exist below that folder is told as well.
    """
    archives = with_folder_key(prune.listed(inv.filter(is_archive()), inv, opts, blocked), opts)
    if members is not None:
        archives = written(archives)
    expected = None if members is None else expected_members(archives, members, opts)
    return judged_archives(archives, expected, found_paths(wanted_by_archives(archives, expected), inv, opts), opts)


def is_archive() -> Column:
    is_one = match.name_in(paths.extension_of(F.col("name")), ARCHIVE_EXTENSIONS)
    return ~F.col("is_directory") & is_one & (archive_base_name(F.col("name")) != "")


def with_folder_key(archives: DataFrame, opts: ScanOptions) -> DataFrame:
    """``base``, and ``folder_key``: the folder beside the archive that has this name."""
    archives = archives.withColumn("base", archive_base_name(F.col("name")))
    return archives.withColumn("folder_key", opts.key(F.concat(F.col("parent_path"), F.lit(opts.sep), F.col("base"))))


def expected_members(archives: DataFrame, members: DataFrame, opts: ScanOptions) -> DataFrame:
    """Where the member files of zip archives would be: (root_id, archive_key, path_key). Written once."""
    zips = archives.filter(F.upper("name").endswith(".ZIP")).select(
        F.col("root_id").alias("key_root"), opts.key(F.col("full_path")).alias("key_path"), "folder_key"
    )
    root = F.col("root_id") if "root_id" in members.columns else F.lit("")
    entry = F.col("entry_name")
    listed = members.filter(~(entry.endswith("/") | entry.endswith("\\"))).select(
        root.alias("root_id"),
        opts.key(F.col("archive_path"), root).alias("archive_key"),
        F.replace(entry, F.lit("/"), F.lit(opts.sep)).alias("entry"),
    )
    met = join_keys(listed, [F.col("root_id"), F.col("archive_key")], settled(zips, opts.broadcast_bytes), "inner")
    place = F.concat(F.col("folder_key"), F.lit(opts.sep), opts.key(F.col("entry")))
    return written(met.select("root_id", "archive_key", place.alias("path_key")))


def wanted_by_archives(archives: DataFrame, expected: DataFrame | None) -> DataFrame:
    """The paths to look up: sibling folders and expected members."""
    beside = archives.select("root_id", F.col("folder_key").alias("path_key"))
    return beside if expected is None else beside.unionByName(expected.select("root_id", "path_key"))


def judged_archives(archives: DataFrame, expected: DataFrame | None, found: KeySet, opts: ScanOptions) -> DataFrame:
    # The folder has the archive's own parent, so only its own flags can hide it.
    beside = of_kind(found, F.col("is_open_folder"))
    matched = join_keys(archives, [F.col("root_id"), F.col("folder_key")], beside, "left_semi")
    percent = F.lit(None).cast("int")
    if expected is not None:
        shares = settled(_found_shares(expected, found), opts.broadcast_bytes)
        matched = join_keys(matched, [F.col("root_id"), opts.key(F.col("full_path"))], shares, "left")
        percent = F.col("percent")
    folder = F.concat(F.col("base"), F.lit("/"))
    certain = percent >= CERTAIN_PERCENT
    detail = (
        F.when(certain, F.concat(percent.cast("string"), F.lit("% content match with "), folder))
        .when(percent.isNotNull(), F.concat(percent.cast("string"), F.lit("% overlap with "), folder))
        .otherwise(F.concat(F.lit("Matches folder: "), F.col("base")))
    )
    group = F.when(certain, F.lit("High confidence")).otherwise(F.lit("Name match"))
    return to_results(matched, "unpacked_archives", detail=detail, group=group)


def _found_shares(expected: DataFrame, found: KeySet) -> DataFrame:
    """Per archive the whole percentage of its member files that exist where they would unpack to."""
    files = of_kind(found, F.col("is_file"))
    there = KeySet(files.df.withColumn("exists", F.lit(True)), files.small)
    return (
        join_keys(expected, [F.col("root_id"), F.col("path_key")], there, "left")
        .groupBy(F.col("root_id").alias("key_root"), F.col("archive_key").alias("key_path"))
        .agg(F.count("exists").alias("found"), F.count(F.lit(1)).alias("total"))
        .select("key_root", "key_path", F.floor(F.col("found") * F.lit(100.0) / F.col("total")).cast("int").alias("percent"))
    )
