"""Registered searches take in all embedding components at the standard budget."""

import os

import numpy as np
import pytest

from tidemark.operators import models, splits
from tidemark.plans import catalog_models

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_searches_are_over_all_components(spark):
    df, columns = catalog_models.wide_embeddings(spark, SMALL)
    assert len(columns) == 64 and set(columns) <= set(df.columns)
    assert catalog_models.mask_search_regression(spark, SMALL).count() == 64
    assert (catalog_models.STANDARD.population, catalog_models.STANDARD.generations) == (30, 40)


def test_the_split_is_held_before_the_random_search_filters_it(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist(), i % 4) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    folds = splits.random_folds

    def of_held(df, *args):
        # Unless the split is held, its filter multiplies in the optimizer with every one of the 64 columns.
        plan = df._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and "Filter" in plan.split("InMemoryRelation")[0]
        return folds(df, *args)

    monkeypatch.setattr(splits, "random_folds", of_held)
    monkeypatch.setattr(models, "tune", lambda *args: (None, None, args[0].train))
    train = catalog_models.random_search(spark, str(tmp_path))
    assert train.count() == 96 and {r.fold for r in train.select("fold").distinct().collect()} == set(range(5))
