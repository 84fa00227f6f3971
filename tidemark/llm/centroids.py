"""Centroid clustering of integer vectors by scalar lookup tables.

A component x becomes floor(256 * x). In every round a task tabulates, for each dimension, the
squared difference between every value that occurs there and every centroid; a vector's distances
are then gathers from those tables, summed over the dimensions. Only centroids are sent out, and
only one row of sums per cluster and task comes back, so what moves does not depend on the rows.

Vectors that are null, have another number of components or hold a null or a number that is not
finite take no part. Repeated vectors and repeated ids count as often as they occur. Centroids
start as the vectors of smallest hash of their id, ties by the vector itself, rows without an id
last; with fewer vectors than clusters there are fewer centroids, and an empty table gives an empty
result. A vector as near to two centroids goes to the smaller number. A component beyond
``LARGEST`` in size, whose squares would not fit the sums, is an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Clusters, rounds, components of a vector and factor that turns components into integers.
CLUSTERS, ROUNDS, DIMENSIONS, FACTOR = 40, 5, 64, 256
#: Largest size of an integer component: 64 squared differences fit a long.
LARGEST = 1 << 27
#: Vectors tabulated at once.
ROWS = 4_096


def kept(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, factor: int = FACTOR) -> DataFrame:
    """``id`` and ``x`` (array of longs) of the rows that take part."""
    x = F.col(column)
    whole = F.transform(x, lambda v: F.floor(F.lit(factor) * v.cast("double")))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    fits = F.forall("x", lambda v: F.abs(v) <= LARGEST)
    rows = vectors.where(x.isNotNull() & (F.size(x) == dimensions)).where(finite).select(F.col(key).alias("id"), whole.alias("x"))
    return rows.withColumn("x", F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component is too large to be clustered"))))


def starts(rows: DataFrame, clusters: int, prefix: str) -> np.ndarray:
    """The vectors of smallest hash of prefix and id, in the order of the hashes."""
    first = rows.withColumn("h", F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "x").limit(clusters)
    return np.array([r.x for r in first.collect()], np.int64)


def tables(x: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the place of every vector's value and the table of occurring values by centroids."""
    for j in range(x.shape[1]):
        values, place = np.unique(x[:, j], return_inverse=True)
        away = values[:, None] - centroids[None, :, j]
        yield place, away * away


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every vector to every centroid."""
    total = np.zeros((len(x), len(centroids)), np.int64)
    for place, table in tables(x, centroids):
        total += table[place]
    return total


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid, the smaller number of equals."""
    away = distances(x, centroids)
    cluster = away.argmin(axis=1)
    return cluster, away[np.arange(len(x)), cluster]


def matrices(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Bounded runs of the batch's vectors."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    for at in range(0, len(flat), ROWS):
        yield slice(at, at + ROWS), flat[at : at + ROWS]


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of the mean of those assigned to each; empty ones stay."""
    clusters, dimensions = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dimensions), np.int64)
        for batch in batches:
            for _, x in matrices(batch, dimensions):
                cluster, _ = nearest(x, centroids)
                order = np.argsort(cluster, kind="stable")
                there, first = np.unique(cluster[order], return_index=True)
                sums[there] += np.add.reduceat(x[order], first)
                counts += np.bincount(cluster, minlength=clusters)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there]), *map(pa.array, sums[there].T)], ["cluster", "n", *names])

    names = [f"s{j}" for j in range(dimensions)]
    parts = rows.select("x").mapInArrow(work, "cluster long, n long, " + ", ".join(f"{c} long" for c in names))
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():
        out[r.cluster] = [r[c] // r.n for c in names]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id``, ``cluster`` and ``distance`` of every vector."""
    kind, dimensions = rows.schema["id"].dataType.simpleString(), centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in matrices(batch, dimensions):
                cluster, away = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(part.start, len(x)), pa.array(cluster, pa.int32()), pa.array(away)], ["id", "cluster", "distance"])

    return rows.mapInArrow(work, f"id {kind}, cluster int, distance long")


def clustered(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, prefix: str = "2:", dimensions: int = DIMENSIONS, factor: int = FACTOR
) -> DataFrame:
    """The key of every vector that takes part with its cluster, distance, inertias and final centroid.

    ``centroid`` is an array of longs. The inertias are the distances summed over the cluster
    (``cluster_inertia``) and over all vectors (``inertia``).
    """
    rows = kept(vectors, key, column, dimensions, factor)
    centroids = starts(rows, clusters, prefix)
    names = [F.col("id").alias(key), "cluster", "distance"]
    if not len(centroids):
        none = rows.where("false").select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.select(*names, F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.array().cast("array<bigint>").alias("centroid"))
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    sums = {r.cluster: r.s for r in assigned(rows, centroids).groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = rows.sparkSession.createDataFrame(
        [(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid array<bigint>"
    )
    return assigned(rows, centroids).join(F.broadcast(facts), "cluster").select(*names, "cluster_inertia", "inertia", "centroid")
