"""Subtrees as ranges of one sort key.

``tree_key`` orders entries as a walk would meet them: a folder comes right before
everything below it, and nothing else comes between. So a subtree is one range, and
"is an entry in the subtree of one of these folders" needs no ancestors and no join:
entries and folders are dealt out by ranges of the key, sorted, and one sweep keeps the
last folder whose range it is in. Folders below such a folder change nothing: the sweep
reduces a set of subtrees to its topmost roots as it goes.

A range may begin inside a subtree that began in an earlier one. Each task therefore
says in which subtree it ended; these marks, one a task, are put in order, and every
task's rows are held against the subtree that reaches into it.

No task gathers a subtree or a root: one that holds most of the rows covers many ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atticsweep.operators.lookup import settled
from atticsweep.schema import ScanOptions
from atticsweep.session import written

# No path and no root has this character; it is below all others, so it sorts a folder's contents right behind it.
CUT = "\0"
ROOT, ENTRY, MARK = 0, 1, 2
ROWS_A_TASK = 1_000_000


def tree_key(root_id: Column, path: Column, opts: ScanOptions) -> Column:
    """A key that orders entries as a walk does; the keys of all that is below a folder begin with its own."""
    return F.concat(root_id, F.lit(CUT), F.replace(opts.key(path, root_id), F.lit(opts.sep), F.lit(CUT)), F.lit(CUT))


def _sweep(names: list[str]):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, root, schema = TaskContext.get().partitionId(), None, None
        for batch in batches:
            schema = batch.schema
            inside = []
            for key, kind in zip(batch.column("tree_key").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                within = root is not None and key.startswith(root)
                inside.append(within)
                if kind == ROOT and not within:
                    root = key
            columns = [*batch.columns, pa.array(inside, pa.bool_()), pa.array([part] * len(inside), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "inside", "part"])
        if schema is not None:
            mark = {"tree_key": root, "kind": MARK}
            columns = [pa.array([mark.get(f.name)], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([False]), pa.array([part], pa.int32())], names=[*names, "inside", "part"])

    return sweep


def swept(rows: DataFrame) -> DataFrame:
    """``rows`` (tree_key, kind, others) with ``inside``: the row is below a row of kind ``ROOT``, or is the same entry.

    Of equal roots one counts as topmost, and is not inside. The outcome is written once.
    """
    spark = rows.sparkSession
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(own, rows.count() // ROWS_A_TASK)
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    schema = T.StructType([*fields, T.StructField("inside", T.BooleanType()), T.StructField("part", T.IntegerType())])
    dealt = rows.repartitionByRange(tasks, "tree_key").sortWithinPartitions("tree_key", "kind")
    out = written(dealt.mapInArrow(_sweep(rows.columns), schema))
    # One row a task: the subtree in which its range ended. It reaches on into the next ranges.
    marks = {r["part"]: r["tree_key"] for r in out.filter(F.col("kind") == MARK).select("part", "tree_key").collect()}
    reaching, before = None, []
    for part in sorted(marks):
        if reaching is not None:
            before.append((part, reaching))
        last = marks[part]
        if last is not None and (reaching is None or not last.startswith(reaching)):
            reaching = last
    carried = F.broadcast(spark.createDataFrame(before, "part int, reaching string"))
    there = F.coalesce(F.startswith("tree_key", F.col("reaching")), F.lit(False))
    judged = out.filter(F.col("kind") != MARK).join(carried, "part", "left")
    return judged.withColumn("inside", F.col("inside") | there).select(*rows.columns, "inside")


def mark_subtrees(rows: DataFrame, folders: DataFrame, opts: ScanOptions) -> DataFrame:
    """``rows`` (root_id, full_path, others) with ``marked``: in the subtree of one of ``folders`` (root_id, full_path).

    While the folders are few (measured), they are broadcast, and a row's ancestors at the
    levels that occur among them are looked up: the rows do not move. Otherwise the rows
    are swept; they move once, by ranges.
    """
    key = tree_key(F.col("root_id"), F.col("full_path"), opts)
    roots = settled(folders.select(key.alias("tree_key")).distinct(), opts.broadcast_bytes)
    if roots.small:
        segments = (F.length("tree_key") - F.length(F.replace("tree_key", F.lit(CUT), F.lit("")))).alias("segments")
        by_level = roots.df.select(F.xxhash64("tree_key").alias("root_hash"), F.col("tree_key").alias("root_key"), segments)
        # Levels of paths, of which there are few.
        levels = sorted(r["segments"] for r in by_level.select("segments").distinct().collect())
        out = rows.withColumn("tree_key", key).withColumn("marked", F.lit(False))
        for n in levels:
            above = F.concat(F.call_function("substring_index", F.col("tree_key"), F.lit(CUT), F.lit(n)), F.lit(CUT))
            some = F.broadcast(by_level.filter(F.col("segments") == n).drop("segments"))
            # Numbers are the join's key; a string is looked at only where the number agrees.
            same = (F.xxhash64(above) == F.col("root_hash")) & F.startswith("tree_key", F.col("root_key"))
            out = out.join(some, same, "left").withColumn("marked", F.col("marked") | F.col("root_key").isNotNull()).drop("root_hash", "root_key")
        return out.select(*rows.columns, "marked")
    entries = rows.withColumns({"tree_key": key, "kind": F.lit(ENTRY)})
    both = entries.unionByName(roots.df.withColumn("kind", F.lit(ROOT)), allowMissingColumns=True)
    out = swept(both).filter(F.col("kind") == ENTRY)
    return out.withColumnRenamed("inside", "marked").select(*rows.columns, "marked")
