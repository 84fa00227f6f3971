"""Chunked computations equal the plain ones, also when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators import ordering as o


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 20, n))
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "t": rng.integers(0, 900, n), "x": np.round(rng.normal(0, 10, n), 1)})
    return spark.createDataFrame(pdf).repartition(6).cache(), pdf


def sorted_rows(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def test_running_sum_and_max(skewed):
    df, pdf = skewed
    specs = {"s": o.Running("sum", F.col("id")), "m": o.Running("max", F.col("x"), inclusive=False), "r": o.Running("min", F.col("x"), reverse=True)}
    plain = sorted_rows(o.running(df, ["key"], ["t", "id"], specs), "id")
    chunked = sorted_rows(o.running(df, ["key"], ["t", "id"], specs, rows_per_chunk=100), "id")
    assert len(o.chunk_edges(df, "t", 100)) > 20
    pd.testing.assert_frame_equal(plain[["id", "s", "m", "r"]], chunked[["id", "s", "m", "r"]])
    want = pdf.sort_values(["t", "id"])
    want["s"] = want.groupby("key")["id"].cumsum()
    assert (want.sort_values("id")["s"].to_numpy() == chunked["s"].to_numpy()).all()


def test_previous_and_positions(skewed):
    df, pdf = skewed
    for size in (None, 100):
        got = sorted_rows(o.previous(df, ["key"], ["t", "id"], ["x"], rows_per_chunk=size), "id")
        want = pdf.sort_values(["t", "id"])
        want["p"] = want.groupby("key")["x"].shift(1)
        np.testing.assert_array_equal(want.sort_values("id")["p"].to_numpy(), got["prev_x"].to_numpy())
        pos = sorted_rows(o.positions(df, ["key"], ["t", "id"], rows_per_chunk=size), "id")
        want["pos"] = want.groupby("key").cumcount() + 1
        assert (want.sort_values("id")["pos"].to_numpy() == pos["pos"].to_numpy()).all()


def test_following(skewed):
    df, pdf = skewed
    got = sorted_rows(o.previous(df, ["key"], ["t", "id"], ["x"], "next_", rows_per_chunk=100, following=True), "id")
    want = pdf.sort_values(["t", "id"])
    want["p"] = want.groupby("key")["x"].shift(-1)
    np.testing.assert_array_equal(want.sort_values("id")["p"].to_numpy(), got["next_x"].to_numpy())


def test_average_ranks(skewed):
    df, pdf = skewed
    for size in (None, 50):
        table = o.value_ranks(df, "x", rows_per_chunk=size).toPandas().set_index("x")["rank"]
        want = pdf.assign(r=pdf["x"].rank())[["x", "r"]].drop_duplicates().set_index("x")["r"]
        pd.testing.assert_series_equal(table.sort_index(), want.sort_index(), check_names=False)


def test_order_statistics_and_quantiles(skewed):
    df, pdf = skewed
    probs = [0.1, 0.25, 0.5, 0.9]
    for limit in (None, 40):
        got = o.exact_quantiles(df, ["x", "id"], probs, limit)
        np.testing.assert_allclose(got["x"], np.quantile(pdf["x"], probs))
        np.testing.assert_allclose(got["id"], np.quantile(pdf["id"], probs))


def test_order_statistics_with_heavy_ties(spark):
    x = np.array([1.0] * 400 + [2.0] * 500 + list(range(3, 103)))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    ranks = [0, 399, 400, 899, 900, 999]
    got = o.order_statistics(df, {"x": ranks}, limit=10)
    assert [got["x", k] for k in ranks] == list(np.sort(x)[ranks])


def test_grouped_quantiles(skewed):
    df, pdf = skewed
    for size in (None, 100):
        got = sorted_rows(o.grouped_quantiles(df, ["key"], "x", {"a": 0.25, "b": 0.5}, size), "key")
        want = pdf.groupby("key")["x"].quantile([0.25, 0.5]).unstack()
        np.testing.assert_allclose(got["a"], want[0.25])
        np.testing.assert_allclose(got["b"], want[0.5])


def test_hash_cutoffs_select_exact_counts(skewed):
    df, pdf = skewed
    keyed = df.withColumn("h", v.hash_text(3, F.col("id"))).cache()
    for limit in (200_000, 3):
        cut = o.hash_cutoffs(keyed, "h", {"all": [0, 1, 777, 2999, 3000, 9999]}, limit=limit)["all"]
        counts = keyed.select(*[F.count_if(F.col("h") < c) for c in cut]).first()
        assert list(counts) == [0, 1, 777, 2999, 3000, 3000]
    per_key = pdf["key"].value_counts().to_dict()
    wanted = {k: [n // 3, n // 3, n] for k, n in per_key.items()}
    cuts = o.hash_cutoffs(keyed, "h", wanted, by="key")
    for k in (7, 3):
        got = keyed.filter(F.col("key") == k).select(*[F.count_if(F.col("h") < c) for c in cuts[k]]).first()
        assert list(got) == wanted[k]


def test_one_timestamp_holding_most_rows_is_cut_by_the_tie(spark):
    n = 2000
    pdf = pd.DataFrame({"id": np.arange(n), "k": 1, "t": np.where(np.arange(n) % 10 < 7, 500, np.arange(n))})
    df = spark.createDataFrame(pdf)
    cuts = o.chunk_edges(df, "t", 100, "id")
    assert cuts.ties
    chunks = o.with_chunk(df, "t", cuts).groupBy(o.CHUNK).count().toPandas()
    assert chunks["count"].max() < 200
    got = o.positions(df, ["k"], ["t", "id"], rows_per_chunk=100).toPandas().sort_values(["t", "id"])
    assert (got["pos"].to_numpy() == np.arange(1, n + 1)).all()


@pytest.mark.parametrize("late", [0.5, 0.02])
def test_infinite_times_are_cut_like_others(spark, late):
    n = 2000
    at = np.arange(n)
    t = np.where(at < late * n, np.inf, np.where(at > 1900, -np.inf, at * 1.0))
    df = spark.createDataFrame(pd.DataFrame({"id": at, "k": 1, "t": t}))
    cuts = o.chunk_edges(df, "t", 100, "id")
    chunks = o.with_chunk(df, "t", cuts).groupBy(o.CHUNK).count().toPandas()
    assert len(cuts) and chunks["count"].max() < 200
    got = o.positions(df, ["k"], ["t", "id"], rows_per_chunk=100).toPandas().sort_values(["t", "id"])
    assert (got["pos"].to_numpy() == np.arange(1, n + 1)).all()
