"""Connected components of a distributed edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path


#: Whether shuffle files go when the query that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str = "part") -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Lineage ends here and lost executors cost no recomputation. Unlike a checkpoint the rows
    forget how they were partitioned, so a later join deals both its sides anew and can split
    a key that holds a large part of the rows. What was shuffled for them is given up at once.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node on an edge ``a``, ``b``.

    Edges from a node to itself count for nothing; an empty table gives an empty one.
    Each round hangs every larger neighbour of a node on the smallest (large star), then every
    smaller one (small star); the rounds end when the edges stay as they are, which takes about
    the logarithm of the longest chain.
    """
    smaller = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(smaller)
    while before[0]:
        around = smaller.unionByName(smaller.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = settle(around.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.col("u")).alias("m")).where("m < v"), "lowest")
        large = smaller.join(lowest, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = settle(large, "large")
        lowest = settle(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        hung = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        smaller = settle(hung.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        after = mark(smaller)
        if after == before:
            break
        before = after
    return smaller.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(smaller.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def mark(edges: DataFrame) -> tuple:
    """Edge count and a sum of hashes; both stay only if the edges do."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
