"""Sizes of whole subtrees, by one sweep over folders in walk order.

Files are added up per folder, once. Folders and these sums are then dealt out by ranges
of ``tree_key`` and sorted, so that a folder comes before all that is below it. A sweep
keeps the folders it is inside of on a stack; leaving one, it tells the size and adds it
to the folder around it. A link keeps its size to itself. No ancestors are listed.

A range may begin and end inside folders. What flows out of a range goes to folders on
the way to its first row, so there are at most as many such flows as that row has
ancestors, and as many folders that are still open at the range's end. These few rows a
task are put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.operators import prune
from atticsweep.operators.intervals import CUT, ROWS_A_TASK, tree_key
from atticsweep.operators.lookup import KeySet, join_keys
from atticsweep.schema import ScanOptions
from atticsweep.session import written

FOLDER, SIZE = 0, 1  # kinds of rows that go in
CLOSED, OUT, OPEN, END = 0, 1, 2, 3  # kinds of rows that come out
SWEPT = "kind int, part int, place int, tree_key string, root_id string, folder string, is_link boolean, size_bytes bigint"


def _shared(a: str, b: str) -> str:
    """The folders that both keys are in or are."""
    n = 0
    for x, y in zip(a.split(CUT)[:-1], b.split(CUT)[:-1]):
        if x != y:
            break
        n += len(x) + 1
    return a[:n]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    stack: list[list] = []  # key, root, folder, is_link, size
    flows: dict[str, int] = {}
    first = key = None
    names = [f.split()[0] for f in SWEPT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def flow(at: str, size: int) -> None:
        if stack:
            stack[-1][4] += size
        elif size:
            way = _shared(first, at)
            flows[way] = flows.get(way, 0) + size

    for batch in batches:
        out = []
        for key, kind, root, folder, is_link, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first = key if first is None else first
            while stack and not key.startswith(stack[-1][0]):
                at, its_root, its_folder, link, total = stack.pop()
                out.append((CLOSED, part, 0, None, its_root, its_folder, None, total))
                if not link:
                    flow(at, total)
            if kind == FOLDER:
                stack.append([key, root, folder, is_link, 0])
            else:
                flow(key, size)
        if out:
            yield rows(out)
    if first is not None:
        rest = [(OUT, part, 0, way, None, None, None, size) for way, size in flows.items()]
        rest += [(OPEN, part, i, at, root, folder, link, size) for i, (at, root, folder, link, size) in enumerate(stack)]
        yield rows([*rest, (END, part, 0, key, None, None, None, None)])


def _put_together(rows: list) -> list[tuple]:
    """(root_id, folder, size) of the folders that were open at the end of a range."""
    by_part: dict[int, dict[int, list]] = {}
    for r in rows:
        by_part.setdefault(r["part"], {OUT: [], OPEN: [], END: []})[r["kind"]].append(r)
    stack: list[list] = []
    done: list[tuple] = []

    def close() -> None:
        _, root, folder, link, size = stack.pop()
        done.append((root, folder, size))
        if stack and not link:
            stack[-1][4] += size

    for part in sorted(by_part):
        its = by_part[part]
        for r in its[OUT]:
            around = [e for e in stack if r["tree_key"].startswith(e[0])]
            if around:
                around[-1][4] += r["size_bytes"]
        while stack and not its[END][0]["tree_key"].startswith(stack[-1][0]):
            close()
        stack += [[r["tree_key"], r["root_id"], r["folder"], r["is_link"], r["size_bytes"]] for r in sorted(its[OPEN], key=lambda r: r["place"])]
    while stack:
        close()
    return done


def folder_rollup(inv: DataFrame, opts: ScanOptions | str, only: KeySet | None = None) -> DataFrame:
    """Size of everything below each folder, not passing through links: (root_id, folder, size_bytes).

    No walk rule applies. ``opts`` (or the separator alone) says how paths compare.
    ``only`` (key_root, key_path) limits the result to some folders.
    """
    opts = ScanOptions(sep=opts) if isinstance(opts, str) else opts
    spark = inv.sparkSession
    none = F.lit(None).cast("string")
    sums = (
        prune.files(inv)
        .filter(F.col("depth") >= 1)
        .groupBy(tree_key(F.col("root_id"), F.col("parent_path"), opts).alias("tree_key"))
        .agg(F.sum("size_bytes").alias("size_bytes"))
        .select("tree_key", F.lit(SIZE).alias("kind"), none.alias("root_id"), none.alias("folder"), F.lit(False).alias("is_link"),
                F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"))
    )
    own = prune.folders(inv).filter(F.col("depth") >= 0)
    folders = own.select(
        tree_key(F.col("root_id"), F.col("full_path"), opts).alias("tree_key"), F.lit(FOLDER).alias("kind"), "root_id",
        F.col("full_path").alias("folder"), F.coalesce("is_reparse_point", F.lit(False)).alias("is_link"), F.lit(0).cast("bigint").alias("size_bytes"),
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.count() // ROWS_A_TASK)
    dealt = folders.unionByName(sums).repartitionByRange(tasks, "tree_key").sortWithinPartitions("tree_key", "kind")
    swept = written(dealt.mapInArrow(_sweep, SWEPT))
    # A few rows a task: as many as the ancestors of its first and its last row.
    ends = spark.createDataFrame(_put_together(swept.filter(F.col("kind") != CLOSED).collect()), "root_id string, folder string, size_bytes bigint")
    out = swept.filter(F.col("kind") == CLOSED).select("root_id", "folder", "size_bytes").unionByName(ends)
    if only is not None:
        out = join_keys(out, [F.col("root_id"), opts.key(F.col("folder"))], only, "left_semi")
    return out
