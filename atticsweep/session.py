"""Session settings and tables written on the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes the shuffle partitions, splits hot join keys and turns
# a join into a broadcast once the measured side is small.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def scratch_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; all executors reach it.

    A local session without that setting gets one temporary folder, which goes when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[name] = tempfile.TemporaryDirectory(prefix="atticsweep-")
        folder = _LOCAL_FOLDERS[name].name
    return folder


_LOCAL_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}
_OPEN: list[Workspace] = []


class Workspace:
    """A folder in the scratch folder for the tables that are written while it is open.

    Results that are still needed have to be written elsewhere before it is removed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{scratch_folder(spark)}/work-{uuid.uuid4().hex}"
        self.used = False

    def __enter__(self) -> Workspace:
        _OPEN.append(self)
        return self

    def __exit__(self, *_) -> None:
        _OPEN.remove(self)

    def is_read_by(self, df: DataFrame) -> bool:
        """Whether a table in it still has to be there when ``df`` runs."""
        return any(self.folder.rpartition("/")[2] in file for file in df.inputFiles())

    def remove(self) -> None:
        """Its tables go; an empty one takes their place, as Spark's writers can replace a folder on any storage."""
        if self.used:
            self.spark.range(0).write.mode("overwrite").parquet(self.folder)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Workspace]:
    """Tables written within it on the way are removed when it ends."""
    work = Workspace(spark)
    try:
        with work:
            yield work
    finally:
        work.remove()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, or in the workspace opened last."""
    folder = scratch_folder(spark)
    for work in _OPEN[-1:]:
        folder, work.used = work.folder, True
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows, written to the scratch folder once and read back from there.

    For what is dear to compute and used more than once, and to end a lineage that
    would grow with each round. Lost executors do not lose it, its size is known to
    the planner, and each later use reads only the columns it needs. ``compression`` is
    for tables that hold whole texts; without it the session's own is used.
    """
    path = scratch_path(df.sparkSession, "atticsweep")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
