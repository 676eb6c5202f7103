import pytest
from pyspark.sql import functions as F

from atticsweep.operators.lookup import existing_keys, join_keys, settled
from atticsweep.session import scratch_path, workspace, written


@pytest.fixture(scope="module")
def keys(spark):
    """Long repetitive paths: a small Parquet file, many bytes of keys."""
    path = F.concat(F.lit("/a/very/long/and/repetitive/path/" * 3), F.col("id").cast("string"))
    return written(spark.range(20_000).select(F.lit("r").alias("key_root"), path.alias("key_path")))


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


def left_of(spark, keys):
    return keys.select(F.col("key_root").alias("root_id"), F.col("key_path").alias("path_key"), F.lit(1).alias("x"))


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "inner", "left"])
def test_large_key_sets_are_not_broadcast(spark, keys, how):
    left = left_of(spark, keys)
    own = [F.col("root_id"), F.col("path_key")]
    for limit, expected in ((0, False), (1000, False), (64 << 20, True)):
        known = settled(keys, limit)
        assert known.small == expected
        assert ("BroadcastHashJoin" in plan_of(join_keys(left, own, known, how))) == expected
    exploded = keys.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(8)))).drop("level")
    assert not settled(exploded, 4 << 20).small
    assert "BroadcastHashJoin" not in plan_of(join_keys(left, own, settled(exploded, 4 << 20), how))


def test_existing_keys_by_size(spark, keys):
    left = left_of(spark, keys)
    for limit, expected in ((1000, False), (64 << 20, True)):
        found = existing_keys(left, left, limit)
        assert found.small == expected and found.df.count() == 20_000
        assert ("BroadcastHashJoin" in plan_of(found.df)) == expected


def test_workspace_leaves_nothing(spark):
    import os

    with workspace(spark):
        path = scratch_path(spark, "mine")
        spark.range(3).write.parquet(path)
        assert written(spark.range(5)).count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
