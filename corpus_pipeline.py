"""From raw documents to packed sequences: toxicity, exact and near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet into the shared folder and reads it again as the next stage's documents. What a
stage writes on the way stays until the next one begins, whose documents are then read
from elsewhere; if they are not, it stays. A stage works on all rows that the one before
kept. All but the last return the columns
of ``documents``; a text that loses repeated passages has its words joined by one space,
and ``n_chars`` follows it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atticsweep.llm import exact_dedup, jaccard_join, packing, substring_dedup, toxicity
from atticsweep.llm.common import table
from atticsweep.session import Workspace, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LAST: dict[str, Workspace] = {}


def _clear(spark: SparkSession, docs: DataFrame) -> None:
    """The tables of the last stage go, unless ``docs`` still reads them."""
    last = _LAST.pop(spark.sparkContext.applicationId, None)
    if last is not None and not last.is_read_by(docs):
        last.remove()


def in_workspace(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark, docs)
        with Workspace(spark) as work:
            _LAST[spark.sparkContext.applicationId] = work
            return stage(spark, docs, sf_dir)

    return run_stage


@in_workspace
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the threshold; the lexicon learns from the labelled rows among the stage's own."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@in_workspace
def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


@in_workspace
def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: the one with the smallest id.

    Links are those of a stage: shingles of five words, and similarity from 80 % on.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=80)


@in_workspace
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@in_workspace
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack),
]

# Toxicity and packing have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    _clear(spark, docs)
    return docs
