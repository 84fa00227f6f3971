"""Bootstrap intervals, label permutation and permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import draws
from tidemark.functions import values as v
from tidemark.operators import metrics
from tidemark.operators.ordering import positions
from tidemark.session import cut_lineage, spread

#: Rows whose weights are drawn at once, and rows of a chunk of scores.
ROWS, CHUNK_ROWS = 1_024, 200_000


def replicate_keys(replicates: int, seed: int) -> np.ndarray:
    return np.array(draws.keys(seed, replicates), np.int64)


def interval(values: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    low = (1 - confidence) / 2
    q = F.percentile(F.col(value), F.array(F.lit(low), F.lit(1 - low)))
    return values.filter(F.col(value).isNotNull()).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), q.alias("q"),
        F.count(value).alias("n_valid"),
    ).select("mean", "std", F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"), "n_valid")


#: Sums a metric is made of, per replicate; errors relative to the truth leave out truths of zero.
SUMS = ("sw", "se2", "sae", "sbias", "spe", "swnz", "sy", "sy2")


def sum_metric(name: str) -> Column:
    def mean(c: str) -> Column:
        return F.col(c) / F.nullif(F.col("sw"), F.lit(0.0))

    spread_of_truth = F.nullif(F.col("sy2") - F.col("sy") * F.col("sy") / F.col("sw"), F.lit(0.0))
    return {
        "rmse": F.sqrt(mean("se2")), "mse": mean("se2"), "mae": mean("sae"), "bias": mean("sbias"),
        "mape": F.col("spe") / F.nullif(F.col("swnz"), F.lit(0.0)), "r2": 1 - F.col("se2") / spread_of_truth,
    }[name]


def bootstrap_sums(df: DataFrame, row_id: str, terms: Sequence[Column], names: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """(rep, names): sums of the terms under Poisson resampling of rows, for all replicates in one pass.

    Weights are drawn per batch from the digest of the row id, and a task sends one array of
    sums per term, whatever its rows; the arrays are added up by replicate.
    """
    drawn, count = replicate_keys(replicates, seed), len(terms)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, count))
        for batch in batches:
            values = batch.iloc[:, 2:].to_numpy(float)
            first, second = batch["first"].to_numpy(), batch["second"].to_numpy()
            for at in range(0, len(batch), ROWS):
                some = slice(at, at + ROWS)
                total += draws.poisson(first[some], second[some], drawn).T.astype(float) @ values[some]
        yield pd.DataFrame({"rep": np.arange(replicates, dtype=np.int32), **dict(zip(names, total.T, strict=True))})

    first, second = draws.halves(F.col(row_id))
    rows = spread(df).select(first.alias("first"), second.alias("second"), *[F.coalesce(t.cast("double"), F.lit(0.0)).alias(n) for t, n in zip(terms, names, strict=True)])
    parts = rows.mapInPandas(work, "rep int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_regression(
    df: DataFrame, row_id: str, truth: str, predicted: str, metric: str = "rmse",
    replicates: int = 1000, seed: int = 42,
) -> DataFrame:
    """(rep, value): the metric under Poisson resampling of rows; rows without truth or prediction take no part."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    e, nonzero = p - y, F.abs(y) > 1e-9
    terms = [F.lit(1.0), e * e, F.abs(e), e, F.when(nonzero, F.abs(e / y)), nonzero.cast("double"), y, y * y]
    sums = bootstrap_sums(df.where(y.isNotNull() & p.isNotNull()), row_id, terms, SUMS, replicates, seed)
    return sums.select("rep", sum_metric(metric).alias("value")).where("value is not null")


def score_chunks(df: DataFrame, score: str, rows_per_chunk: int) -> DataFrame:
    """``chunk`` of every row: odd between two cuts, even on a cut. Numbers ascend with the score."""
    pieces = -(-df.count() // rows_per_chunk)
    if pieces <= 1:
        return df.withColumn("chunk", F.lit(1).cast("long"))
    shares = [i / pieces for i in range(1, pieces)]
    cuts = sorted(set(df.agg(F.percentile_approx(score, F.array(*map(F.lit, shares)), max(10_000, 4 * pieces))).first()[0]))
    at = F.array(*map(F.lit, cuts))
    below = F.size(F.filter(at, lambda c: c < F.col(score)))
    return df.withColumn("chunk", (2 * below + F.when(F.array_contains(at, F.col(score)), 2).otherwise(1)).cast("long"))


def bootstrap_auc(
    df: DataFrame, row_id: str, truth: str, score: str, replicates: int = 1000, seed: int = 42, rows_per_chunk: int = CHUNK_ROWS, single_class: bool = False
) -> DataFrame:
    """(rep, value) under Poisson resampling of rows; single-class replicates are skipped, or not a number with ``single_class``.

    Rows are exchanged once, by chunk of the score. A chunk leaves three arrays: its own area
    and the weights of both classes; a cut that many rows share is a chunk without an order, dealt
    to as many tasks as it needs. Chunks are then put in order by replicate.
    """
    drawn = replicate_keys(replicates, seed)
    first, second = draws.halves(F.col(row_id))
    rows = df.select(first.alias("first"), second.alias("second"), F.col(score).cast("double").alias("score"), (F.col(truth) == 1).alias("y"))
    chunked = score_chunks(rows.where("score is not null and y is not null"), "score", rows_per_chunk)
    own = F.when(F.col("chunk") % 2 == 0, F.pmod(F.xxhash64("first", "second"), F.lit(64))).otherwise(0)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", kind="stable")
        value, y = pdf["score"].to_numpy(), pdf["y"].to_numpy()
        ends = np.append(np.flatnonzero(value[1:] != value[:-1]) + 1, len(value))
        area, pos, neg = (np.zeros(replicates) for _ in range(3))
        tie_pos, tie_neg, closed = np.zeros(replicates), np.zeros(replicates), 0
        for at in range(0, len(pdf), ROWS):
            upto = min(at + ROWS, len(pdf))
            w = draws.poisson(pdf["first"].to_numpy()[at:upto], pdf["second"].to_numpy()[at:upto], drawn).astype(float)
            inner = [at, *ends[(ends > at) & (ends < upto)].tolist()]
            ups = np.add.reduceat(w * y[at:upto, None], np.array(inner) - at)
            downs = np.add.reduceat(w * ~y[at:upto, None], np.array(inner) - at)
            for k, end in enumerate([*inner[1:], upto]):
                tie_pos += ups[k]
                tie_neg += downs[k]
                if closed < len(ends) and end == ends[closed]:
                    area += tie_pos * (neg + tie_neg / 2)
                    pos += tie_pos
                    neg += tie_neg
                    tie_pos, tie_neg, closed = np.zeros(replicates), np.zeros(replicates), closed + 1
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "rep": np.arange(replicates, dtype=np.int32), "area": area, "pos": pos, "neg": neg})

    parts = chunked.withColumn("part", own).groupBy("chunk", "part").applyInPandas(work, "chunk long, rep int, area double, pos double, neg double")
    sums = parts.groupBy("rep", "chunk").agg(F.sum("area").alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    tied = F.when(F.col("chunk") % 2 == 0, F.col("pos") * F.col("neg") / 2).otherwise(F.col("area"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("rep").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = sums.withColumn("area", tied + F.col("pos") * below).groupBy("rep").agg(F.sum("area").alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    value = F.when(F.expr("p > 0 and n > 0"), F.col("area") / (F.col("p") * F.col("n"))).otherwise(float("nan"))
    return whole.where("p + n > 0" if single_class else "p > 0 and n > 0").select("rep", value.alias("value"))


MAX_CELLS = 100_000


def bootstrap_classification(
    df: DataFrame, truth: str, predicted: str, metric: str = "balanced_accuracy",
    replicates: int = 1000, seed: int = 42,
) -> DataFrame:
    """(rep, value) for any confusion-based metric.

    Drawing n rows with replacement is a multinomial draw over the confusion cells, so
    the table is read once and each replicate costs one draw over its few cells.
    """
    cells = metrics.confusion(df, truth, predicted).orderBy("y", "p").limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError("too many label pairs for a confusion table")
    counts = np.array([c["n"] for c in cells], dtype=np.int64)
    labels = pd.DataFrame({"y": [c["y"] for c in cells], "p": [c["p"] for c in cells]})
    total, share = int(counts.sum()), counts / counts.sum()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rep in batch["id"]:
                n = np.random.default_rng([seed, int(rep)]).multinomial(total, share)
                yield labels.assign(rep=rep, n=n)[n > 0]

    kinds = {f.name: f.dataType.simpleString() for f in df.select(F.col(truth).alias("y"), F.col(predicted).alias("p")).schema}
    drawn = df.sparkSession.range(replicates).mapInPandas(draw, f"y {kinds['y']}, p {kinds['p']}, rep long, n long")
    scored = metrics.classification(drawn, "y", "p", ["rep"], weight="n")
    return scored.select("rep", F.col(metric).alias("value"))


# ---------------------------------------------------------------- permutation
def permuted(
    df: DataFrame, row_id: str, column: str, seed: int, out: str | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Replace a column by itself in another hash order.

    Rows and donors are numbered along two hash orders and joined on the number, which is
    unique on both sides.
    """
    narrow = df.select(F.col(row_id), F.col(column).alias("_donor"))
    keyed = df.withColumn("_h", v.hash_order(0, F.col(row_id)))
    placed = positions(keyed, [], ["_h", row_id], "_pos", rows_per_chunk=rows_per_chunk).drop("_h")
    other = narrow.withColumn("_h", v.hash_order(seed, F.col(row_id)))
    donors = positions(other, [], ["_h", row_id], "_pos", rows_per_chunk=rows_per_chunk).select("_pos", "_donor")
    return placed.join(donors, "_pos").withColumn(out or column, F.col("_donor")).drop("_pos", "_donor")


def shuffles(df: DataFrame, row_id: str, columns: Sequence[str], repeats: int, seed: int = 42) -> DataFrame:
    """Every row once as it is (``shuffle`` -1) and once per column and repeat with that column shuffled.

    Shuffle ``j * repeats + r`` replaces column ``j``. Rows are numbered once; the row that a value goes
    to is found by arithmetic, so all shuffles are one exchange of narrow rows by position.
    """
    numbered = positions(df.withColumn("_h", v.hash_order(0, F.col(row_id))), [], ["_h", row_id], "_pos").drop("_h")
    placed = cut_lineage(numbered.withColumn("_pos", F.col("_pos") - 1))
    n = placed.count()
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    kind = kinds[columns[0]] if len({kinds[c] for c in columns}) == 1 else "string"
    turns = draws.keys(seed, 4 * repeats * len(columns))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            for j in range(len(columns)):
                for k in range(j * repeats, (j + 1) * repeats):
                    to = draws.moved(at, n, turns[4 * k : 4 * k + 4])
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(to), k, np.int32)), batch.column(j + 1)], ["_pos", "shuffle", "_value"])

    given = placed.select("_pos", *[F.col(c).cast(kind) for c in columns]).mapInArrow(work, f"_pos long, shuffle int, _value {kind}")
    given = given.groupBy("_pos").agg(F.collect_list(F.struct("shuffle", "_value")).alias("_given"))
    itself = F.array(F.struct(F.lit(-1).alias("shuffle"), F.lit(None).cast(kind).alias("_value")))
    each = placed.join(given, "_pos").select(*df.columns, F.inline(F.concat(itself, "_given")))
    own = F.floor(F.col("shuffle") / repeats)
    return each.withColumns({c: F.when(own == j, F.col("_value").cast(kinds[c])).otherwise(F.col(c)) for j, c in enumerate(columns)}).drop("_value")


#: Value of a scored table for every value of the grouping columns.
Score = Callable[[DataFrame, list[str]], DataFrame]


def permutation_test(
    df: DataFrame, row_id: str, target: str, score: Score, permutations: int = 20, seed: int = 42, higher_is_better: bool = True,
) -> DataFrame:
    """Score on shuffled labels; p = (extreme + 1) / (runs + 1).

    ``score`` gives one ``value`` per ``shuffle``; all permutations and the labels as they are
    are scored in one job.
    """
    scored = score(shuffles(df, row_id, [target], permutations, seed), ["shuffle"])
    observed, shuffled = F.max(F.when(F.col("shuffle") < 0, F.col("value"))), F.when(F.col("shuffle") >= 0, F.col("value"))
    facts = scored.agg(
        observed.alias("observed"), F.avg(shuffled).alias("permuted_mean"), F.coalesce(F.stddev_samp(shuffled), F.lit(0.0)).alias("permuted_std"),
        F.min(shuffled).alias("permuted_min"), F.max(shuffled).alias("permuted_max"), F.collect_list(shuffled).alias("_all"), F.count(shuffled).cast("int").alias("permutations"),
    )
    extreme = F.size(F.filter("_all", lambda x: (x >= F.col("observed")) if higher_is_better else (x <= F.col("observed"))))
    return facts.withColumn("p_value", (extreme + 1) / (F.col("permutations") + 1)).select("observed", "permuted_mean", "permuted_std", "permuted_min", "permuted_max", "p_value", "permutations")


def permutation_importance(
    df: DataFrame, row_id: str, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], score: Score,
    repeats: int = 15, seed: int = 42, higher_is_better: bool = True,
) -> DataFrame:
    """Drop in score when one column of held-out rows is shuffled, best first.

    All features and repeats are predicted and scored in one job, by ``shuffle``.
    """
    scored = score(predict(shuffles(df, row_id, features, repeats, seed)), ["shuffle"])
    base = F.max(F.when(F.col("shuffle") < 0, F.col("value"))).over(Window.partitionBy())
    drop = F.col("base") - F.col("value") if higher_is_better else F.col("value") - F.col("base")
    drops = scored.withColumn("base", base).where("shuffle >= 0").withColumn("drop", drop).withColumn("ordinal", F.floor(F.col("shuffle") / repeats).cast("int"))
    names = F.array(*map(F.lit, features))
    out = drops.groupBy("ordinal").agg(F.avg("drop").alias("importance_mean"), F.coalesce(F.stddev_samp("drop"), F.lit(0.0)).alias("importance_std"), F.count("*").cast("int").alias("repeats"))
    return out.select(F.get(names, F.col("ordinal")).alias("feature"), "ordinal", "importance_mean", "importance_std", "repeats").orderBy(F.desc("importance_mean"), "ordinal")


def selection_stability(masks: DataFrame) -> DataFrame:
    """Frequency per feature from a long (mask, feature, selected) table."""
    return masks.groupBy("feature").agg(
        F.avg(F.col("selected").cast("double")).alias("frequency"),
        F.bool_and("selected").alias("always"), (~F.bool_or("selected")).alias("never"),
    )


def overlapping_jaccard(masks: DataFrame) -> DataFrame:
    """Jaccard of mask pairs that share a feature, by a self join on the feature.

    Masks are search results: as many as there were seeds or folds.
    """
    on = masks.filter("selected").select("mask", "feature")
    sizes = on.groupBy("mask").agg(F.count(F.lit(1)).alias("size"))
    sized = on.join(sizes, "mask")
    a, b = sized.toDF("a", "feature", "size_a"), sized.toDF("b", "feature", "size_b")
    shared = a.join(b, "feature").filter("a < b").groupBy("a", "b", "size_a", "size_b").agg(
        F.count(F.lit(1)).alias("both")
    )
    return shared.withColumn("jaccard", F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both")))


def jaccard_summary(masks: DataFrame) -> DataFrame:
    """Mean and sd over all pairs; pairs without a shared feature count as zero."""
    sizes = masks.groupBy("mask").agg(F.sum(F.col("selected").cast("double")).alias("size"))
    s = overlapping_jaccard(masks).agg(F.sum("jaccard"), F.sum(F.col("jaccard") * F.col("jaccard"))).first()
    total, squares = s[0] or 0.0, s[1] or 0.0
    # Two empty masks have no union; such pairs are left out, so only masks
    # with a feature make pairs with each other, and an empty mask still pairs with those.
    return sizes.agg(
        F.count(F.lit(1)).alias("n_masks"), F.avg("size").alias("mean_selected"),
        F.count_if(F.col("size") == 0).alias("_empty"),
    ).withColumn(
        "_pairs",
        F.col("n_masks") * (F.col("n_masks") - 1) / 2 - F.col("_empty") * (F.col("_empty") - 1) / 2,
    ).select(
        "n_masks", "mean_selected", F.coalesce(F.lit(total) / F.nullif(F.col("_pairs"), F.lit(0.0)), F.lit(0.0)).alias("mean_jaccard"),
        F.when(
            F.col("_pairs") > 1,
            F.sqrt(F.greatest(F.lit(0.0), (F.lit(squares) - F.lit(total) * F.lit(total) / F.col("_pairs")) / (F.col("_pairs") - 1))),
        ).otherwise(F.lit(0.0)).alias("std_jaccard"),
    )
