"""Checkpoints: same rows, no shuffle files left, the caller's frame and settings untouched."""

import time

from pyspark.sql import functions as F

from threatloom.session import RELEASE, checkpointed


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_checkpoint_leaves_no_shuffle_files(spark):
    df = spark.range(20000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n")).repartition(3, "n")
    before, setting = shuffle_files(spark), spark.conf.get(RELEASE, None)
    copy = checkpointed(df)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(RELEASE, None) == setting
    assert sorted(copy.collect()) == [(k, 200) for k in range(100)]
    # the caller's frame keeps what it shuffles and can be run again
    assert df.count() == 100 and df.count() == 100
    assert shuffle_files(spark) - before


def test_checkpoint_keeps_a_setting_of_the_session(spark):
    spark.conf.set(RELEASE, "true")
    try:
        assert checkpointed(spark.range(10).repartition(2)).count() == 10
        assert spark.conf.get(RELEASE) == "true"
    finally:
        spark.conf.unset(RELEASE)


def test_checkpoint_of_equal_names_and_of_nothing(spark):
    twice = spark.range(3).select("id", F.col("id").alias("id"))
    assert sorted(checkpointed(twice).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert checkpointed(spark.range(0)).collect() == []
