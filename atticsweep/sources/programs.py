"""Names that stand for installed or running programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MACHINE_HIVE = "HKLM"
SHORT_WORD = 3


def _unspaced(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def installed_names(programs: DataFrame, processes: DataFrame | None = None) -> DataFrame:
    """Distinct (root_id, token), upper case.

    ``programs`` has hive, key_name, display_name, install_location, publisher (and
    root_id): machine-wide rows give all name forms, per-user rows only the display
    name, that without spaces, and the key; blank values give none. ``processes`` has process_name.
    """
    c = F.col
    root = c("root_id") if "root_id" in programs.columns else F.lit("")
    machine = c("hive").startswith(MACHINE_HIVE)

    def filled(text: Column) -> Column:
        return F.when(F.trim(text) != "", text)

    display, publisher = filled(c("display_name")), filled(c("publisher"))
    first_word = F.element_at(F.split(display, r"[ .\-]", -1), 1)
    location = F.element_at(F.split(F.regexp_replace(filled(c("install_location")), r"[/\\]+$", ""), r"[/\\]", -1), -1)
    both = [display, _unspaced(display), filled(c("key_name"))]
    machine_only = [
        F.when(F.length(first_word) > SHORT_WORD, first_word),
        F.when(location != "", location),
        publisher,
        _unspaced(publisher),
    ]
    tokens = F.array(*both, *[F.when(machine, t) for t in machine_only])
    names = programs.select(root.alias("root_id"), F.explode(tokens).alias("token"))
    if processes is not None:
        root = c("root_id") if "root_id" in processes.columns else F.lit("")
        names = names.unionByName(
            processes.filter(F.length("process_name") > SHORT_WORD).select(
                root.alias("root_id"), c("process_name").alias("token")
            )
        )
    return names.filter(c("token").isNotNull()).select("root_id", F.upper("token").alias("token")).distinct()
