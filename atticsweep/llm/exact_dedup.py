"""Exact duplicates by distributed most-significant-digit radix partitioning.

All documents start in one group. A round cuts the next bytes off every text that
is still in question and splits each group by them; a document alone in its group
is unique, a group whose texts have ended holds equal texts, the rest go on. Digits
start narrow and widen, so the number of rounds grows with the logarithm of the
longest text. Equality is decided by the bytes themselves; the SHA-256 column is
only reported.

A group is split by one aggregation over (group, digit), combined before the
shuffle, and one join back to the rows, which adaptive execution may split: no task
needs all rows of a group. Each round is written to the shared folder, so a lost
executor costs one task and the lineage stays short.

Defined cases: null texts count as empty, and all empty texts are equal; a null
``doc_id`` comes last in ties; rows that repeat a ``doc_id`` are counted as rows, and
each row with the kept id is marked as kept; an empty table gives an empty one;
columns other than ``doc_id`` and ``text`` are not read. ``drop_exact_copies`` decides by
row: one row of each group stays, whatever ids are repeated or null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import SPACE_CLASS, first_of, numbered, texts
from atticsweep.session import written


def _rows(docs: DataFrame) -> DataFrame:
    """Of columns doc_id and text, and others that are carried along as they are."""
    bare = F.regexp_replace("text", SPACE_CLASS + "+", "")
    return docs.select(
        *[c for c in docs.columns if c != "text"],
        F.char_length("text").alias("code_points"),
        F.sha2(bare.cast("binary"), 256).alias("text_sha256"),
        F.lit(0).cast("bigint").alias("grp"),
        bare.cast("binary").alias("rest"),
    )


def _split(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """One round: the new groups of two rows or more, and all rows with the group they fall into, null if alone."""
    cut = rows.withColumns({
        "digit": F.substring("rest", 1, width),
        "ended": F.octet_length("rest") <= F.lit(width),
    })
    digits = ["grp", "digit", "ended"]
    found = cut.groupBy(*digits).agg(F.count(F.lit(1)).alias("group_size"), F.max("code_points").alias("most"))
    groups = written(found.filter("group_size > 1").withColumn("next_grp", F.monotonically_increasing_id()))
    # The groups grow with the documents: always a shuffle join, never a broadcast.
    carried = [c for c in rows.columns if c not in ("grp", "rest")]
    dealt = cut.join(groups.hint("merge"), digits, "left").select(
        *carried, "group_size", "most",
        F.col("next_grp").alias("grp"),
        F.when(F.col("next_grp").isNotNull() & ~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
    )
    return groups, written(dealt)


def _settled(docs: DataFrame, first_width: int = 64, growth: int = 8) -> DataFrame:
    """All rows with their round and group, its size and most code points; no group if alone."""
    rows, width, done = _rows(docs), first_width, []
    # Group numbers are those of one round.
    while True:
        groups, dealt = _split(rows, width)
        done.append(dealt.filter("rest IS NULL").drop("rest").withColumn("round", F.lit(len(done))))
        if groups.filter("NOT ended").isEmpty():
            break
        rows, width = dealt.filter("rest IS NOT NULL").drop("group_size", "most"), width * growth
    return reduce(DataFrame.unionByName, done)


def exact_groups(docs: DataFrame, **settings: int) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when the same without the six ASCII white-space characters. Of
    equal texts, the one with the most code points, then the smallest id, stays.
    """
    settled = _settled(texts(docs), **settings)
    alone = settled.filter("grp IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    shared = settled.filter("grp IS NOT NULL")
    keepers = written(shared.filter("code_points = most").groupBy("round", "grp").agg(F.min("doc_id").alias("keep_id")))
    together = shared.join(keepers.hint("merge"), ["round", "grp"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(together)


def drop_exact_copies(docs: DataFrame, **settings: int) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``: that with the kept id; of several, one."""
    own, row = numbered(docs)
    numbers = texts(own, row).withColumn("text_key", F.xxhash64("text"))
    shared = _settled(numbers, **settings).filter("grp IS NOT NULL")
    first = shared.filter("code_points = most").groupBy("round", "grp").agg(F.min(first_of(row)).alias("first"))
    kept = written(first.select("round", "grp", F.col("first.row").alias("kept_row")))
    copies = shared.join(kept.hint("merge"), ["round", "grp"]).filter(F.col(row) != F.col("kept_row"))
    return own.join(written(copies.select(row)).hint("merge"), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
