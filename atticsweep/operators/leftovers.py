"""Folders that removed programs left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atticsweep.functions import match
from atticsweep.operators import prune
from atticsweep.operators.lookup import join_keys, settled
from atticsweep.operators.rollup import folder_rollup
from atticsweep.registry import scanner, to_results
from atticsweep.schema import ScanOptions
from atticsweep.session import written

# Folders of the system and of common tools, never reported.
KNOWN_FOLDERS = (
    "Microsoft", "Windows", "Packages", "Microsoft.Windows",
    "ConnectedDevicesPlatform", "CrashDumps", "D3DSCache",
    "Diagnostics", "GameDVR", "Publishers", "Temp", "History",
    "Temporary Internet Files", "INetCache", "INetCookies",
    "Programs", "Microsoft_Corporation",
    ".NET", ".dotnet", "NuGet", "npm", "pip", "cargo", "rustup",
    "Python", "Java", "Go", "Ruby",
    "Package Cache", "PackageManagement", "WindowsApps",
    "WinGet", "Chocolatey", "scoop",
    "Windows Defender", "Windows Security", "Windows Update",
    "WindowsPowerShell", "PowerShell",
)
SHORTEST_PART = 4
SMALLEST_FOLDER = 1024
# Lengths of the pieces by which containing texts find each other: powers of two.
PIECE_LENGTHS = (4, 8, 16, 32, 64, 128, 256)


def _own_piece_length(text: Column) -> Column:
    """The largest piece length not above the length of the text."""
    fitting = [F.when(F.length(text) >= n, F.lit(n)) for n in PIECE_LENGTHS]
    return F.greatest(*fitting)


def _pieces(text: Column) -> Column:
    """All distinct pieces of each length that a contained text may begin with."""
    return F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.when(
                        F.length(text) >= n,
                        F.transform(F.sequence(F.lit(1), F.length(text) - F.lit(n - 1)), lambda at: F.substring(text, at, F.lit(n))),
                    ).otherwise(F.array().cast("array<string>"))
                    for n in PIECE_LENGTHS
                ]
            )
        )
    )


def _longest_pieces(text: Column) -> Column:
    """The distinct pieces of the largest length that fits; a text that contains ``text`` has them all."""
    n = _own_piece_length(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + F.lit(1)), lambda at: F.substring(text, at, n)))


def meeting(inner: DataFrame, outer: DataFrame, limit_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The pieces that texts ``inner`` ask for, one each, and the rows (root_id, inner, outer) that meet on them.

    A contained text has several pieces that the other one must have as well. Pieces are
    counted over the outer texts: one that none has rules containment out, else the
    rarest, not the first, is where both meet. So what meets follows the texts' own
    words, not the words that all of them begin with.
    """
    held = written(outer.select("root_id", "outer", F.explode(_pieces(F.col("outer"))).alias("piece")))
    often = held.groupBy("root_id", "piece").agg(F.count(F.lit(1)).alias("outer_texts"))
    own = inner.select("root_id", "inner", F.explode(_longest_pieces(F.col("inner"))).alias("piece"))
    # Every text of a piece is one row here, so a piece that all share is spread by adaptive execution.
    judged = own.join(often.hint("merge"), ["root_id", "piece"], "left").withColumn("outer_texts", F.coalesce("outer_texts", F.lit(0)))
    # A text has at most as many pieces as characters.
    place = F.row_number().over(Window.partitionBy("root_id", "inner").orderBy("outer_texts", "piece"))
    rarest = judged.withColumn("place", place).filter((F.col("place") == 1) & (F.col("outer_texts") > 0))
    asked = settled(rarest.select(F.col("root_id").alias("key_root"), F.col("piece").alias("key_piece"), "inner"), limit_bytes)
    met = join_keys(held, [F.col("root_id"), F.col("piece")], asked, "inner")
    return asked.df, met.select("root_id", "inner", "outer")


def _containing(inner: DataFrame, outer: DataFrame, limit_bytes: int) -> DataFrame:
    """(root_id, inner, outer) where the text ``inner`` of a root is part of its text ``outer``; both have 4 characters or more."""
    _, met = meeting(inner, outer, limit_bytes)
    return met.filter(F.contains("outer", F.col("inner")))


def without_related_name(folders: DataFrame, names: DataFrame, limit_bytes: int = ScanOptions.broadcast_bytes) -> DataFrame:
    """Folders (root_id, name) none of whose root's names equals, contains or is part of the folder name.

    Containment counts from 4 characters on. Equal texts meet by themselves; the others
    on the rarest piece of the contained one. No name is compared with every folder.
    """
    folders = folders.withColumn("name_key", F.upper("name"))
    tokens = written(names.select("root_id", F.upper("token").alias("token_key")).distinct())
    asked = written(folders.select("root_id", "name_key").distinct())
    keys = ["root_id", "name_key"]
    equal = asked.join(tokens.withColumnRenamed("token_key", "name_key").hint("merge"), keys, "left_semi")
    long_names = tokens.filter(F.length("token_key") >= SHORTEST_PART)
    long_folders = asked.join(equal.hint("merge"), keys, "left_anti").filter(F.length("name_key") >= SHORTEST_PART)
    as_inner = _containing(
        long_folders.select("root_id", F.col("name_key").alias("inner")), long_names.select("root_id", F.col("token_key").alias("outer")), limit_bytes
    )
    as_outer = _containing(
        long_names.select("root_id", F.col("token_key").alias("inner")), long_folders.select("root_id", F.col("name_key").alias("outer")), limit_bytes
    )
    related = equal.unionByName(as_inner.select("root_id", F.col("inner").alias("name_key"))).unionByName(
        as_outer.select("root_id", F.col("outer").alias("name_key"))
    )
    gone = settled(related.distinct().select(F.col("root_id").alias("key_root"), F.col("name_key").alias("key_name")), limit_bytes)
    return join_keys(folders, [F.col(k) for k in keys], gone, "left_anti").drop("name_key")


@scanner(
    "orphaned_app_data",
    "Data folders of programs that are not installed",
    columns=(
        ("Folder", "name"),
        ("Path", "full_path"),
        ("Size", "size_bytes"),
        ("Location", "group"),
        ("Modified", "modified"),
    ),
    order=lambda sep: [F.col("size_bytes").desc()],
    run=lambda i, o, blocked: orphaned_app_data(i.inventory, i.locations, i.names, o, i.extra.get("folders")),
    needs=("locations", "names"),
)
def orphaned_app_data(
    inv: DataFrame, locations: DataFrame, names: DataFrame, opts: ScanOptions, folder_rows: DataFrame | None = None
) -> DataFrame:
    """Folders directly in a location (root_id, path, label) that no installed name accounts for.

    ``names`` is (root_id, token). Walk rules do not apply; hidden, system and link
    folders, known system folders and those under 1 KiB are left out.
    """
    places = locations.select(
        F.col("root_id").alias("key_root"), opts.key(F.col("path")).alias("key_path"), "label"
    )
    flagged = F.col("is_reparse_point") | F.col("is_system") | F.col("is_hidden")
    unknown = (prune.folders(inv) if folder_rows is None else folder_rows).filter(~flagged & ~match.name_in(F.col("name"), KNOWN_FOLDERS))
    parent = [F.col("root_id"), opts.key(F.col("parent_path"))]
    candidates = join_keys(
        unknown, parent, settled(places, opts.broadcast_bytes), "inner"
    ).select("root_id", "full_path", "name", "modified", "label")
    # Few rows after much matching, used for the sizes and for the outcome.
    orphans = written(without_related_name(candidates, names, opts.broadcast_bytes))
    keys = orphans.select(
        F.col("root_id").alias("key_root"), opts.key(F.col("full_path")).alias("key_path")
    )
    sizes = folder_rollup(inv, opts, settled(keys, opts.broadcast_bytes)).select(
        F.col("root_id").alias("size_root"), opts.key(F.col("folder")).alias("size_key"), "size_bytes"
    )
    same = (F.col("root_id") == F.col("size_root")) & (opts.key(F.col("full_path")) == F.col("size_key"))
    found = orphans.join(sizes.hint("merge"), same).filter(F.col("size_bytes") >= SMALLEST_FOLDER)
    return to_results(
        found, "orphaned_app_data", group=F.col("label"), selected=False, is_directory=F.lit(True)
    )
