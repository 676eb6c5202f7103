"""The largest files.

Entries that are equal in root, path (by the root's own rules about case) and size are
one. Each task keeps the ``n`` best distinct entries it has seen and nothing else, so
what is exchanged is ``n`` rows a task, however many copies of an entry there are; the
same is done once more with what the tasks kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atticsweep.operators import prune
from atticsweep.operators.lookup import KeySet
from atticsweep.registry import scanner, to_results
from atticsweep.schema import ScanOptions

TOP_N = 100


def _best(n: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the ``n`` largest (size_bytes, path_key, root_id); of equal ones that with the largest path."""
        kept: dict[tuple, tuple[str, dict]] = {}
        floor = schema = None
        for batch in batches:
            schema = batch.schema
            if floor is not None:
                batch = batch.filter(pc.greater_equal(batch.column("size_bytes"), floor))
            columns = [batch.column(c).to_pylist() for c in ("size_bytes", "path_key", "root_id", "full_path")]
            for i, (size, key, root, path) in enumerate(zip(*columns, strict=True)):
                entry = (size, key, root)
                if entry in kept and kept[entry][0] >= path:
                    continue
                kept[entry] = (path, batch.slice(i, 1).to_pylist()[0])
                if len(kept) >= 2 * n + 1000:
                    kept = dict(sorted(kept.items(), reverse=True)[:n])
                    floor = min(e[0] for e in kept)
        rows = [row for _, (_, row) in sorted(kept.items(), key=lambda e: e[0], reverse=True)[:n]]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return best


@scanner(
    "big_files",
    "The largest files",
    columns=(("Name", "name"), ("Path", "full_path"), ("Size", "size_bytes"), ("Modified", "modified")),
    order=lambda sep: [F.col("size_bytes").desc(), F.upper("full_path").desc()],
    run=lambda i, o, blocked: big_files(i.inventory, o, blocked=blocked),
)
def big_files(
    inv: DataFrame, opts: ScanOptions, n: int = TOP_N, per_root: bool = False, blocked: KeySet | None = None
) -> DataFrame:
    """The ``n`` largest distinct files of all, or of each root; equal sizes by path, descending."""
    seen = prune.visible_files(inv, opts, blocked).withColumn("path_key", opts.key(F.col("full_path")))
    entry = [F.col("size_bytes").desc(), F.col("path_key").desc()]
    if per_root:
        # Ranks count distinct entries; each task drops what cannot be among its root's first ``n``.
        rank = F.dense_rank().over(Window.partitionBy("root_id").orderBy(*entry))
        top = seen.withColumn("rank", rank).filter(F.col("rank") <= n)
        copy = F.row_number().over(Window.partitionBy("root_id", "size_bytes", "path_key").orderBy(F.col("full_path").desc()))
        top = top.withColumn("copy", copy).filter(F.col("copy") == 1)
    else:
        rows = seen.select("root_id", "full_path", "name", "size_bytes", "modified", "is_directory", "path_key").filter(F.col("size_bytes").isNotNull())
        top = rows.mapInArrow(_best(n), rows.schema).repartition(1).mapInArrow(_best(n), rows.schema)
    return to_results(top, "big_files", selected=False)
