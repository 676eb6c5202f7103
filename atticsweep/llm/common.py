"""What the text operators share: input columns, word splitting, settings of a job."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atticsweep.session import written

# Words are runs of anything but these six characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id``, ``text`` and ``others`` alone, null texts as empty ones; other columns, whatever they are called, stay out."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *others)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a number for each row, and that column's name, which ``docs`` does not have."""
    name, taken = "row_number", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "zstd"), name


def first_of(row: str) -> Column:
    """What comes first of rows that say the same: the smallest id, null ids last; of one id by its text, then any."""
    return F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", F.col(row).alias("row"))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


SLICE_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within it hands rows to Python in batches of about a slice (by default 64 MB, of which executors hold several)."""
    with _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES)):
        yield


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffles of each job that runs within it go as it ends; else they stay until the driver happens to collect its garbage."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    own = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def rows_of(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes, so that memory follows the longest text, not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def spread_parts(spark: SparkSession, rows: int, rows_per_part: int, least: int | None = None) -> int:
    """A number of partitions that grows with the rows, never below the session's own."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(own if least is None else least, -(-rows // rows_per_part))
