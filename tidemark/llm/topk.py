"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are dealt to ``LISTS`` lists; a candidate's score is the sum of its list scores.

1. Every task gathers, for each query and list, its entries with the largest list scores, with
   the largest list score of all. The k-th best whole score among them is a safe cutoff.
2. The cutoff goes back to the tasks as one threshold per list: each list's largest score less
   an equal share of what all lists' largest scores together exceed the cutoff by. A candidate
   below the threshold in every list cannot reach the cutoff. The tasks collect the entries at
   or above, and drop candidates whose collected scores, with the thresholds for the others,
   stay below the cutoff.
3. What is left is resolved exactly.

Queries go through in blocks of ``QUERIES``, so what is broadcast does not grow with the data.
Components become floor(256 x) of the double. Vectors that are null, empty or hold a null or
non-finite component take no part, nor do rows without an id; rows that share an id count as
one (with the smallest vector). Shorter vectors are padded with zeros. Scores past the range of
a long are held at its ends. Equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import settle

LISTS, QUERIES = 4, 4096
#: Candidates scored against a block of queries at once.
CANDIDATES = 1024
LONG = (-(2**63), 2**63 - 1)


def integers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``x`` (array of whole doubles) of the rows that take part."""
    x = F.col("x").cast("array<double>")
    usable = F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).select("id", x.alias("x")).where(usable)
    return rows.groupBy("id").agg(F.min("x").alias("x")).select("id", F.transform("x", lambda v: _floor(v)).alias("x"))


def _floor(v):
    """floor(256 v) as a double: doubles this large have no fraction, and ``floor`` would go through long."""
    scaled = v * 256
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, as longs; by Python integers where doubles could round."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, *LONG).astype(np.int64)


def parts(width: int) -> list[slice]:
    edges = [width * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Whether an entry is among the k largest of its row; ties at the end all are."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    return scores >= np.partition(scores, -k, axis=1)[:, [-k]]


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(at, CANDIDATES)
            yield part.column(0).to_numpy(), matrix(part.column(1), width)


def bounded(total: np.ndarray) -> np.ndarray:
    """Whole scores as doubles, for comparing with bounds."""
    return total.astype(np.float64)


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best other rows for each id divisible by ``every``."""
    spark = vectors.sparkSession
    rows = settle(integers(vectors, key, vector), "vectors")
    width = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    found = [answer(rows, block, width, k) for block in blocks_of(asked)]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found, empty)


def blocks_of(asked: DataFrame) -> Iterator[tuple[np.ndarray, list]]:
    """Ids and vectors of at most ``QUERIES`` queries at a time, in the order of their ids."""
    last = None
    while True:
        rest = asked if last is None else asked.where(F.col("id") > last)
        block = rest.orderBy("id").limit(QUERIES).collect()
        if not block:
            return
        last = block[-1].id
        yield np.array([r.id for r in block], np.int64), [r.x for r in block]


def answer(rows: DataFrame, block: tuple[np.ndarray, list], width: int, k: int) -> DataFrame:
    ids, vectors = block
    queries = np.zeros((len(ids), width))
    for i, x in enumerate(vectors):
        queries[i, : len(x)] = x
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((ids, queries))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        held: list[list[np.ndarray]] = []
        for names, candidates in chunks(batches, width):
            total = exact(queries, candidates)
            other = names[None, :] != ids[:, None]
            for number, part in enumerate(parts(width)):
                scores = np.where(other, exact(queries[:, part], candidates[:, part]), LONG[0])
                q, c = np.nonzero(best(scores, k) & other)
                held.append([np.full(len(q), number), q, names[c], scores[q, c], total[q, c]])
        if held:
            number, q, name, score, total = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((name, -score.astype(np.float64), q, number))
            group = number[order] * len(ids) + q[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            kept = order[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[kept], number[kept], name[kept], score[kept], total[kept])], ["q", "list", "id", "list_score", "score"])

    lists = settle(rows.mapInArrow(gather, "q long, list long, id long, list_score long, score long"), "lists")
    tops = lists.groupBy("q", "list").agg(F.max("list_score").alias("largest")).collect()
    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = lists.select("q", "id", "score").distinct().withColumn("rank", F.row_number().over(by_query)).where(f"rank <= {k}")
    cutoffs = ranked.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("cutoff")).collect()
    largest = np.full((len(ids), LISTS), float(LONG[0]))
    for row in tops:
        largest[row.q, row.list] = row.largest
    cutoff = np.full(len(ids), -np.inf)
    for row in cutoffs:
        if row.n >= k:
            cutoff[row.q] = row.cutoff
    known = context.broadcast((cutoff, largest - np.maximum(0, (largest.sum(axis=1) - cutoff) / LISTS)[:, None]))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, queries), (cutoff, thresholds) = shared.value, known.value
        # Doubles hold scores to a relative 2**-52, so bounds are eased by more than that.
        ease = 1e-12 * (np.abs(thresholds).sum(axis=1) + np.where(np.isfinite(cutoff), np.abs(cutoff), 0)) + 1e-6
        for names, candidates in chunks(batches, width):
            reach = np.zeros((len(ids), len(names)))
            seen = np.zeros(reach.shape, bool)
            for number, part in enumerate(parts(width)):
                scores = bounded(exact(queries[:, part], candidates[:, part]))
                collected = scores >= (thresholds[:, number] - ease)[:, None]
                seen |= collected
                reach += np.where(collected, scores, thresholds[:, [number]])
            left = seen & (reach >= (cutoff - LISTS * ease)[:, None]) & (names[None, :] != ids[:, None])
            q, c = np.nonzero(left)
            if not len(q):
                continue
            score = resolve(queries, candidates, q, c)
            good = bounded(score) >= cutoff[q] - ease[q]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[good]]), pa.array(names[c[good]]), pa.array(score[good])], ["query_id", "vec_id", "score"])

    remaining = rows.mapInArrow(collect, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return settle(remaining.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score"), "answers")


def resolve(queries: np.ndarray, candidates: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole scores of the remaining pairs."""
    if np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * queries.shape[1] < 2.0**53:
        step = 65_536
        return np.concatenate([np.einsum("ij,ij->i", queries[q[a : a + step]], candidates[c[a : a + step]]) for a in range(0, len(q), step)]).astype(np.int64)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(queries[i], candidates[j], strict=True)), LONG[0]), LONG[1]) for i, j in zip(q, c, strict=True)], np.int64)
