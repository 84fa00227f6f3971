"""Centroid clustering against plain rounds over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import centroids

VECTORS = "vec_id long, embedding array<double>, label int, x string, cluster string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in zip(ids, vectors, strict=True)], VECTORS)


def plain(rows, clusters, rounds, dimensions):
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that takes part."""
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    held = [v for _, v in hashed[:clusters]]

    def assign():
        out = []
        for _, v in rows:
            away = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in held]
            out.append((away.index(min(away)), min(away)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(held)):
            own = [v for (_, v), (k, _) in zip(rows, at, strict=True) if k == c]
            if own:
                held[c] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    at = assign()
    inertia = {c: sum(d for k, d in at if k == c) for c in range(len(held))}
    return [(i, k, d, inertia[k], sum(inertia.values()), held[k]) for (i, _), (k, d) in zip(rows, at, strict=True)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def test_rounds_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(5)
    vectors = [[rng.gauss(rng.choice((-2, 0, 3)), 0.4) for _ in range(6)] for _ in range(400)]
    vectors += [vectors[0]] * 150 + [None, [], [1.0] * 5, [1.0] * 7, [None] + [1.0] * 5, [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5]
    ids = [*range(len(vectors) - 2), None, 3]
    monkeypatch.setattr(centroids, "ROWS", 64)
    got = centroids.clustered(table(spark, vectors, ids).repartition(5), clusters=9, rounds=4, dimensions=6).collect()
    want = plain(list(zip(ids, vectors, strict=True)), 9, 4, 6)
    assert order((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in got) == order(want)


def test_ties_and_fewer_vectors_than_clusters(spark):
    vectors = [[0.0, 1.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [-0.001, 1.0]]
    ids = [1, 1, 2, None, 5]
    got = centroids.clustered(table(spark, vectors, ids), clusters=40, dimensions=2).collect()
    assert order((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in got) == order(plain(list(zip(ids, vectors, strict=True)), 40, 5, 2))


def test_empty_table_gives_no_rows(spark):
    for rows in (table(spark, []), table(spark, [None, [1.0]])):
        got = centroids.clustered(rows)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and got.count() == 0


def test_tables_hold_what_occurs():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-5, 5, (300, 4)), rng.integers(-5, 5, (7, 4))
    assert (centroids.distances(x, c) == ((x[:, None] - c[None]) ** 2).sum(axis=2)).all()
    assert all(len(t) == len(np.unique(x[:, j])) for j, (_, t) in enumerate(centroids.tables(x, c)))


def test_a_component_beyond_the_bound_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(table(spark, [[1e12, 0.0]]), dimensions=2).collect()
