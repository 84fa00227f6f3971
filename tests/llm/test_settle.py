"""Settled rows leave no shuffle files behind."""

from pathlib import Path

from pyspark.sql import functions as F

from tidemark.llm import components


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for d in manager.localDirsString() for f in Path(d).rglob("shuffle_*")}


def test_shuffles_go_with_the_query_that_wrote_them(spark):
    before, setting = shuffle_files(spark), spark.conf.get(components.CLEANUP)
    df = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count()
    rows = components.settle(df, "counts")
    assert not shuffle_files(spark) - before
    assert rows.agg(F.sum("count"), F.count("*")).first()[:] == (10_000, 97)
    assert components.settle(df, "again").count() == 97 and spark.conf.get(components.CLEANUP) == setting
