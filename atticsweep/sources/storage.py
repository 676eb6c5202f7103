"""Shared storage: listings, file contents and digests.

Paths are local (mounted on all executors) or URIs that Arrow can open. Spark
decides which task lists or reads what; a task handles one path at a time and
never holds a whole file or listing.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from atticsweep.schema import INVENTORY_SCHEMA
from atticsweep.session import written

PREFIX_BYTES = 4096
CHUNK_BYTES = 1 << 20
BYTES_PER_TASK = 256 << 20
FILES_PER_TASK = 5_000
FOLDERS_PER_TASK = 200
ROWS_PER_BATCH = 5_000

LISTING_SCHEMA = T.StructType([*INVENTORY_SCHEMA.fields, T.StructField("readable", T.BooleanType())])


def open_file(path: str):
    """A seekable binary file for a local path or a URI."""
    if "://" in path:
        from pyarrow import fs

        filesystem, inner = fs.FileSystem.from_uri(path)
        return filesystem.open_input_file(inner)
    return open(path, "rb")


def file_digest(path: str, prefix_bytes: int | None = None) -> str | None:
    """SHA-256 of a file or of its first bytes, in hex; None if it cannot be read."""
    try:
        with open_file(path) as f:
            if prefix_bytes is not None:
                return hashlib.sha256(f.read(prefix_bytes)).hexdigest()
            digest = hashlib.sha256()
            while chunk := f.read(CHUNK_BYTES):
                digest.update(chunk)
            return digest.hexdigest()
    except (OSError, ValueError):
        return None


def read_digests(files: DataFrame, prefix_bytes: int | None = None) -> DataFrame:
    """``files`` (root_id, full_path, size_bytes, ...) with ``hash``, read by as many tasks as the bytes need."""
    files = written(files)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    tasks = ceil(n / FILES_PER_TASK)
    if prefix_bytes is None:
        tasks = max(tasks, ceil(size / BYTES_PER_TASK))
    tasks = max(tasks, min(n, files.sparkSession.sparkContext.defaultParallelism), 1)
    schema = T.StructType([*files.schema.fields, T.StructField("hash", T.StringType())])

    def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("full_path")
            digests = [file_digest(p.as_py(), prefix_bytes) for p in batch.column(column)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "hash"]
            )

    # Read once: both the grouping and the join behind it start from these rows.
    return written(files.repartition(tasks, "root_id", "full_path").mapInArrow(digest_batches, schema))


def contents(files: DataFrame) -> DataFrame:
    """(root_id, full_path, content) of files that can be read; for files that fit in memory one by one."""
    schema = T.StructType(
        [
            T.StructField("root_id", T.StringType()),
            T.StructField("full_path", T.StringType()),
            T.StructField("content", T.BinaryType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with open_file(row["full_path"]) as f:
                        data = f.read()
                except (OSError, ValueError):
                    continue
                yield pa.RecordBatch.from_pylist(
                    [{**row, "content": data}],
                    schema=pa.schema(
                        [("root_id", pa.string()), ("full_path", pa.string()), ("content", pa.binary())]
                    ),
                )

    return files.select("root_id", "full_path").mapInArrow(read, schema)


def _entry_local(root_id: str, entry: os.DirEntry, depth: int) -> tuple:
    is_link, target = False, None
    try:
        is_link = entry.is_symlink()
        if is_link:
            target = os.path.normpath(os.path.join(os.path.dirname(entry.path), os.readlink(entry.path)))
        is_directory = entry.is_dir()
        stat = entry.stat(follow_symlinks=False)
        size = 0 if is_directory else stat.st_size
        modified = datetime.fromtimestamp(stat.st_mtime, timezone.utc)
        readable = is_link or os.access(entry.path, os.R_OK)
    except OSError:
        is_directory, size, modified, readable = False, 0, None, False
    bits = 0x10 * is_directory + 0x02 * entry.name.startswith(".") + 0x400 * is_link
    return (
        root_id,
        entry.path,
        entry.name,
        os.path.dirname(entry.path),
        depth,
        is_directory,
        entry.name.startswith("."),
        False,
        is_link,
        size,
        modified,
        bits,
        target,
        readable,
    )


def list_folder(root_id: str, folder: str, depth: int) -> Iterator[tuple]:
    """The entries directly in a folder.

    A folder that cannot be opened, or whose listing breaks off, gives its own row once
    more with ``readable`` false, so that a listing with gaps shows them.
    """
    if "://" in folder:
        from pyarrow import fs

        try:
            filesystem, inner = fs.FileSystem.from_uri(folder)
            infos = filesystem.get_file_info(fs.FileSelector(inner))
        except (OSError, ValueError):
            yield _unreadable_row(root_id, folder, depth - 1)
            return
        for info in infos:
            is_directory = info.type == fs.FileType.Directory
            hidden = info.base_name.startswith(".")
            yield (
                root_id,
                f"{folder}/{info.base_name}",
                info.base_name,
                folder,
                depth,
                is_directory,
                hidden,
                False,
                False,
                0 if is_directory else info.size or 0,
                info.mtime,
                0x10 * is_directory + 0x02 * hidden,
                None,
                True,
            )
        return
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                yield _entry_local(root_id, entry, depth)
    except OSError:
        yield _unreadable_row(root_id, folder, depth - 1)


def _unreadable_row(root_id: str, folder: str, depth: int) -> tuple:
    return (*_root_row(root_id, folder)[:4], depth, *_root_row(root_id, folder)[5:-1], False)


def _root_row(root_id: str, root: str) -> tuple:
    name = root.rsplit("/", 1)[-1]
    return (root_id, root, name, root[: -len(name) - 1], 0, True, False, False, False, 0, None, 0x10, None, True)


class FolderTask(InputPartition):
    """A folder to list, alone or with all that is below."""

    def __init__(self, folder: str, depth: int, recursive: bool):
        self.folder = folder
        self.depth = depth
        self.recursive = recursive


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.root_id = options.get("root_id", "")
        self.wanted = int(options.get("numpartitions", options.get("numPartitions", 64)))

    def partitions(self) -> list[InputPartition]:
        """Open up the tree level by level until there are enough folders to share out."""
        alone, level, depth = [], [self.root], 0
        while level and len(level) < self.wanted:
            alone += [FolderTask(f, depth, False) for f in level]
            below = []
            for folder in level:
                below += [row[1] for row in list_folder(self.root_id, folder, depth + 1) if row[5] and not row[8]]
            level, depth = below, depth + 1
        return alone + [FolderTask(f, depth, True) for f in level]

    def read(self, partition: FolderTask) -> Iterator[tuple]:
        if partition.depth == 0:
            yield _root_row(self.root_id, self.root)
        pending = [(partition.folder, partition.depth)]
        while pending:
            folder, depth = pending.pop()
            for row in list_folder(self.root_id, folder, depth + 1):
                yield row
                if partition.recursive and row[5] and not row[8]:
                    pending.append((row[1], depth + 1))


class InventoryDataSource(DataSource):
    """``spark.read.format("inventory").option("path", root).load()``."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> T.StructType:
        return LISTING_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return InventoryReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(InventoryDataSource)


def walk_storage(spark: SparkSession, root: str, root_id: str = "") -> DataFrame:
    """A listing taken one level at a time, the folders of each level spread over all tasks.

    For trees whose subtrees differ much in size: no task is bound to a subtree. Links
    are listed but not entered.
    """
    root = root.rstrip("/")
    level = spark.createDataFrame([_root_row(root_id, root)], LISTING_SCHEMA)
    levels = [level]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for found in list_folder(row["root_id"], row["full_path"], row["depth"] + 1):
                    out.append(found)
                    if len(out) == ROWS_PER_BATCH:
                        yield _listing_batch(out)
                        out = []
                if out:
                    yield _listing_batch(out)

    while True:
        to_enter = level.filter(F.col("is_directory") & ~F.col("is_reparse_point"))
        n = to_enter.count()
        if n == 0:
            break
        tasks = max(ceil(n / FOLDERS_PER_TASK), min(n, spark.sparkContext.defaultParallelism))
        folders = to_enter.select("root_id", "full_path", "depth").repartition(tasks, "root_id", "full_path")
        level = written(folders.mapInArrow(expand, LISTING_SCHEMA))
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


ARROW_TYPES: dict[type, Callable[[], pa.DataType]] = {
    T.StringType: pa.string,
    T.IntegerType: pa.int32,
    T.LongType: pa.int64,
    T.BooleanType: pa.bool_,
    T.TimestampType: lambda: pa.timestamp("us", "UTC"),
}


def _listing_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [
        pa.array(values, ARROW_TYPES[type(f.dataType)]())
        for values, f in zip(columns, LISTING_SCHEMA.fields, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=LISTING_SCHEMA.fieldNames())
