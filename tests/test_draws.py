"""Bijections of positions, shuffles found by arithmetic, Poisson weights and the resampling built on them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import draws
from tidemark.operators import resample


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1_000, 40_001])
def test_every_position_is_reached_once(n):
    for seed in range(5):
        to = draws.moved(np.arange(n), n, draws.keys(seed, 4))
        assert (np.sort(to) == np.arange(n)).all()


def test_shuffles_are_unlike_each_other_and_the_order():
    n, keys = 10_000, draws.keys(1, 40)
    to = np.array([draws.moved(np.arange(n), n, keys[4 * i : 4 * i + 4]) for i in range(10)])
    near = np.corrcoef(np.vstack([np.arange(n), to]))
    assert np.abs(near - np.eye(11)).max() < 0.05
    assert (to[0][1:] == to[0][:-1] + 1).mean() < 0.01


def test_weights_are_poisson_and_uncorrelated():
    rng = np.random.default_rng(0)
    w = draws.poisson(rng.integers(0, 1 << 28, 4_000), rng.integers(0, 1 << 28, 4_000), np.array(draws.keys(3, 200)))
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert [(w == k).mean() for k in range(4)] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.004)
    assert np.abs(np.corrcoef(w.T.astype(float)) - np.eye(200)).max() < 0.1


def test_a_shuffled_column_keeps_its_values_and_leaves_the_others(spark):
    df = spark.range(300).select("id", (F.col("id") * 2).alias("x"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("t"))
    rows = resample.shuffles(df, "id", ["x", "t"], 3).toPandas()
    assert rows.groupby("shuffle").size().to_dict() == {k: 300 for k in range(-1, 6)}
    for k, part in rows.groupby("shuffle"):
        part = part.sort_values("id")
        moved, kept = ("x", "t") if 0 <= k < 3 else ("t", "x")
        plain = {"x": [2 * i for i in range(300)], "t": [f"s{i}" for i in range(300)]}
        assert part[kept].tolist() == plain[kept]
        assert sorted(part[moved]) == sorted(plain[moved]) and (k < 0) == (part[moved].tolist() == plain[moved])


def test_importance_finds_what_the_model_uses_in_few_jobs(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"id": range(500), "a": rng.normal(size=500), "b": rng.normal(size=500)})).withColumn("y", 3 * F.col("a"))
    score = lambda d, by: d.groupBy(*by).agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("value"))

    def jobs(repeats):
        spark.sparkContext.setJobGroup(f"importance {repeats}", "")
        out = resample.permutation_importance(df, "id", ["b", "a"], lambda d: d.withColumn("p", 3 * F.col("a")), score, repeats, higher_is_better=False).collect()
        count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"importance {repeats}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, count

    few, some = jobs(1)
    out, count = jobs(15)
    assert [(r.feature, r.repeats) for r in out] == [("a", 15), ("b", 15)] and out[0].importance_mean > 2 and out[1].importance_mean == 0
    assert count == some


def test_label_permutation(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "a": np.arange(200.0), "y": np.arange(200.0) % 150}))
    row = resample.permutation_test(df, "id", "y", lambda d, by: d.groupBy(*by).agg(F.corr("a", "y").alias("value")), 19).first()
    assert row.permutations == 19 and row.p_value == pytest.approx(0.05) and row.observed > row.permuted_max > row.permuted_mean > row.permuted_min


@pytest.mark.parametrize("rows_per_chunk", [10_000, 60])
def test_auc_replicates_equal_weighted_areas(spark, monkeypatch, rows_per_chunk):
    monkeypatch.setattr(resample, "ROWS", 50)
    rng = np.random.default_rng(3)
    score = np.round(rng.random(600), 2)
    score[rng.random(600) < 0.35] = 0.5
    pdf = pd.DataFrame({"id": range(600), "y": (rng.random(600) < score).astype(int), "s": score})
    got = {r.rep: r.value for r in resample.bootstrap_auc(spark.createDataFrame(pdf), "id", "y", "s", 40, rows_per_chunk=rows_per_chunk).collect()}
    halves = spark.createDataFrame(pdf).select("id", *[h.alias(f"h{i}") for i, h in enumerate(draws.halves(F.col("id")))]).toPandas().sort_values("id")
    w = draws.poisson(halves.h0.to_numpy(), halves.h1.to_numpy(), resample.replicate_keys(40, 42)).astype(float)
    for rep in range(40):
        pos, neg = w[:, rep] * pdf.y, w[:, rep] * (1 - pdf.y)
        wins = (score[:, None] > score[None]) + 0.5 * (score[:, None] == score[None])
        assert got[rep] == pytest.approx(pos @ wins @ neg / (pos.sum() * neg.sum()))


def test_auc_replicates_of_one_class_are_skipped_or_not_a_number(spark):
    pdf = pd.DataFrame({"id": range(4), "y": [1, 0, 0, 0], "s": [0.9, 0.2, 0.4, 0.6]})
    df = spark.createDataFrame(pdf)
    halves = df.select("id", *[h.alias(f"h{i}") for i, h in enumerate(draws.halves(F.col("id")))]).toPandas().sort_values("id")
    w = draws.poisson(halves.h0.to_numpy(), halves.h1.to_numpy(), resample.replicate_keys(60, 42))
    some = {r for r in range(60) if w[:, r].any()}
    both = {r for r in some if w[0, r] and w[1:, r].any()}
    got = {r.rep: r.value for r in resample.bootstrap_auc(df, "id", "y", "s", 60, single_class=True).collect()}
    assert both < some < set(range(60)) and set(got) == some and {r for r in got if not np.isnan(got[r])} == both
    assert {r.rep for r in resample.bootstrap_auc(df, "id", "y", "s", 60).collect()} == both


def test_metrics_of_replicates(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(300), "y": rng.normal(5, 1, 300), "p": rng.normal(5, 1, 300)})
    pdf.loc[0, "y"], pdf.loc[1, "p"] = np.nan, np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    for metric, exact in (("rmse", lambda d: (d.e**2).mean() ** 0.5), ("mape", lambda d: (d.e / d.y).abs().mean()), ("r2", lambda d: 1 - (d.e**2).mean() / d.y.var(ddof=0)), ("bias", lambda d: d.e.mean())):
        row = resample.interval(resample.bootstrap_regression(df, "id", "y", "p", metric, 300), "value").first()
        assert row.n_valid == 300 and row.ci_lower < exact(pdf.dropna().assign(e=lambda d: d.p - d.y)) < row.ci_upper
