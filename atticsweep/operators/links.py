"""Links and shortcuts whose target is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.operators import prune
from atticsweep.operators.existence import found_paths, of_kind
from atticsweep.operators.lookup import KeySet, join_keys, settled
from atticsweep.registry import scanner, to_results
from atticsweep.schema import ScanOptions


def is_link() -> Column:
    return F.col("is_reparse_point") & (F.trim("link_target") != "")


def is_shortcut() -> Column:
    return ~F.col("is_directory") & F.upper("name").endswith(".LNK") & (F.trim("link_target") != "")


def with_target_key(pointers: DataFrame, opts: ScanOptions) -> DataFrame:
    """Rows with a ``target`` get ``target_key``, by which it is looked up."""
    clean = F.when(
        F.col("target").endswith(opts.sep),
        F.substring(F.col("target"), F.lit(1), F.length("target") - F.lit(len(opts.sep))),
    ).otherwise(F.col("target"))
    return pointers.withColumn("target_key", opts.key(clean))


def wanted_targets(pointers: DataFrame) -> DataFrame:
    return pointers.select("root_id", F.col("target_key").alias("path_key"))


def _without_target(pointers: DataFrame, found: KeySet) -> DataFrame:
    """The rows whose ``target`` is no entry of the same root."""
    return join_keys(pointers, [F.col("root_id"), F.col("target_key")], of_kind(found), "left_anti")


@scanner(
    "broken_links",
    "Symbolic links and junctions that point nowhere",
    columns=(("Name", "name"), ("Path", "full_path"), ("Type", "detail"), ("Modified", "modified")),
    run=lambda i, o, blocked: broken_links(i.inventory, o, blocked),
)
def broken_links(inv: DataFrame, opts: ScanOptions, blocked: KeySet | None = None) -> DataFrame:
    """Link entries of entered folders whose target is not in the inventory.

    Link folders are judged whatever their flags or name. Links without a recorded
    target cannot be judged and are left out.
    """
    links = link_pointers(prune.listed(inv.filter(is_link()), inv, opts, blocked), opts)
    return dangling_links(links, found_paths(wanted_targets(links), inv, opts))


def link_pointers(links: DataFrame, opts: ScanOptions) -> DataFrame:
    return with_target_key(links.withColumn("target", F.col("link_target")), opts)


def dangling_links(pointers: DataFrame, found: KeySet) -> DataFrame:
    kind = F.when(F.col("is_directory"), F.lit("Junction/Dir symlink")).otherwise(F.lit("File symlink"))
    return to_results(_without_target(pointers, found), "broken_links", detail=kind, size_bytes=F.lit(0))


def expand_variables(text: Column, variables: Column) -> Column:
    """``%NAME%`` replaced from a map with upper-case keys, in one pass; unknown names stay."""
    parts = F.split(text, "%")
    last = F.size(parts) - F.lit(1)
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("plain"))

    def step(state: Column, part: Column) -> Column:
        value = F.try_element_at(variables, F.upper(part["text"]))
        is_name = ~state["plain"] & (part["at"] < last) & value.isNotNull()
        plain_text = F.concat(state["text"], part["text"])
        kept_sign = F.concat(state["text"], F.lit("%"), part["text"])
        return F.struct(
            F.when(state["plain"], plain_text)
            .when(is_name, F.concat(state["text"], value))
            .otherwise(kept_sign)
            .alias("text"),
            is_name.alias("plain"),
        )

    numbered = F.transform(parts, lambda part, at: F.struct(part.alias("text"), at.alias("at")))
    return F.aggregate(numbered, start, step, lambda state: state["text"])


def _variables_of(links: DataFrame, env: DataFrame, opts: ScanOptions) -> DataFrame:
    """Per link (key_root, key_link) a map of the variables that its own target names.

    Names are compared without case; of several spellings the first in order counts.
    """
    named = env.filter(F.col("name").isNotNull() & F.col("value").isNotNull())
    known = named.groupBy(F.col("root_id").alias("key_root"), F.upper("name").alias("key_name")).agg(
        F.min(F.struct("name", "value"))["value"].alias("value")
    )
    used = links.filter(F.contains(F.col("link_target"), F.lit("%"))).select(
        "root_id", "full_path", F.explode(F.array_distinct(F.split(F.upper("link_target"), "%"))).alias("name")
    )
    found = used.join(settled(known, opts.broadcast_bytes).hinted(), (F.col("root_id") == F.col("key_root")) & (F.col("name") == F.col("key_name")))
    # At most as many names as a target has per cent signs.
    return found.groupBy("root_id", "full_path").agg(F.collect_set(F.struct("name", "value")).alias("pairs")).select(
        F.col("root_id").alias("key_root"), F.col("full_path").alias("key_link"), F.map_from_entries("pairs").alias("variables")
    )


@scanner(
    "broken_shortcuts",
    "Shortcuts with a missing target",
    columns=(
        ("Name", "name"),
        ("Shortcut Path", "full_path"),
        ("Missing Target", "detail"),
        ("Modified", "modified"),
    ),
    run=lambda i, o, blocked: broken_shortcuts(i.inventory, i.env, o, blocked),
)
def broken_shortcuts(
    inv: DataFrame, env: DataFrame | None, opts: ScanOptions, blocked: KeySet | None = None
) -> DataFrame:
    """``.lnk`` files whose stored target, variables expanded, is not in the inventory.

    ``env`` has one row per root and variable (root_id, name, value).
    """
    links = shortcut_pointers(prune.listed(inv.filter(is_shortcut()), inv, opts, blocked), env, opts)
    return dangling_shortcuts(links, found_paths(wanted_targets(links), inv, opts))


def shortcut_pointers(links: DataFrame, env: DataFrame | None, opts: ScanOptions) -> DataFrame:
    """Shortcuts with their expanded target."""
    if env is None:
        return with_target_key(links.withColumn("target", F.col("link_target")), opts)
    own = settled(_variables_of(links, env, opts), opts.broadcast_bytes)
    links = join_keys(links, [F.col("root_id"), F.col("full_path")], own, "left")
    target = F.when(
        F.contains(F.col("link_target"), F.lit("%")) & F.col("variables").isNotNull(),
        expand_variables(F.col("link_target"), F.col("variables")),
    ).otherwise(F.col("link_target"))
    return with_target_key(links.withColumn("target", target), opts)


def dangling_shortcuts(pointers: DataFrame, found: KeySet) -> DataFrame:
    return to_results(_without_target(pointers, found), "broken_shortcuts", detail=F.col("target"))
