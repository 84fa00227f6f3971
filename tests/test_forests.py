"""Forests fitted in parts, and baselines side by side."""

from threading import Barrier

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=x[:, 0] - x[:, 1], cls=(x[:, 0] > 0).astype(int), three=np.digitize(x[:, 1], [-0.5, 0.5]))
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize(("label", "classes"), [("y", 0), ("cls", 2), ("three", 3)])
def test_parts_of_a_forest_vote_together(points, monkeypatch, label, classes):
    monkeypatch.setattr(models, "TREES", 2)
    sizes, plain = [], models._fit
    monkeypatch.setattr(models, "_fit", lambda m, e, weighted: sizes.append(e.getNumTrees()) or plain(m, e, weighted))
    m = models.ModelInput(points, ("a", "b", "c"), label, classes, trees=5, depth=4)
    one = models.forest(m)
    assert sorted(sizes) == [1, 2, 2]
    value = "proba" if classes else "prediction"
    alone = one(points)
    assert set(alone.columns) == {*points.columns, "prediction", *(["proba"] if classes else [])}
    both = models.ensemble({"p": one, "q": one}, classes)(points)
    # An ensemble of the same forest twice is that forest.
    a, b = (np.array(df.orderBy("a", "b").select(value).toPandas()[value].tolist()) for df in (alone, both))
    assert a == pytest.approx(b)
    if classes:
        assert alone.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] > 0.8


def test_baselines_are_fitted_side_by_side(points, monkeypatch):
    meet = Barrier(2, timeout=60)

    def waits(m):
        meet.wait()
        return models.mean(m)

    monkeypatch.setattr(models, "REGRESSORS", {"first": waits, "second": waits})
    rows = models.run_baselines(models.ModelInput(points, ("a",), "y", 0), points, ["second", "first", "unknown"]).collect()
    assert [r.model for r in rows if r.metric in ("rmse", None)] == ["second", "first", "unknown"]
    assert rows[-1].error and not any(r.error for r in rows[:-1])
