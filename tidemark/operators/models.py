"""Baselines, tuning, calibration, ensembles and block fusion on Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.prep import class_weights, train_rows, with_class_weight
from tidemark.operators.search import fold_moments

Predictor = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ModelInput:
    """Training rows with assembled features; ``label`` is 0..k-1 or a real target."""

    train: DataFrame
    features: tuple[str, ...]
    label: str
    classes: int  # 0 for regression
    seed: int = 42
    trees: int = 300
    boost_rounds: int = 100
    depth: int = 30

    def assembled(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(self.features), outputCol="_x", handleInvalid="error").transform(df)


def _with_scores(df: DataFrame, model, classes: int) -> DataFrame:
    scored = model.transform(df).drop("rawPrediction")
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        scored = scored.withColumn("proba", p[1] if classes == 2 else p).drop("probability")
    return scored.drop("_x")


def _fit(m: ModelInput, estimator, weighted: bool) -> Predictor:
    train = m.train
    if weighted and m.classes:
        train = with_class_weight(train, m.label, class_weights(train, m.label, threshold=1.0))
        estimator = estimator.copy({estimator.weightCol: "weight"})
    model = estimator.fit(m.assembled(train))
    return lambda df: _with_scores(m.assembled(df), model, m.classes)


def majority(m: ModelInput) -> Predictor:
    counts = m.train.groupBy(m.label).count()
    top = counts.agg(F.min(F.struct((-F.col("count")).alias("neg"), m.label)).alias("b")).first()["b"]
    return lambda df: df.withColumn("prediction", F.lit(float(top[m.label])))


def mean(m: ModelInput) -> Predictor:
    value = m.train.agg(F.avg(m.label)).first()[0]
    return lambda df: df.withColumn("prediction", F.lit(value))


def logistic(m: ModelInput, c: float = 1.0) -> Predictor:
    """``c`` weighs the summed loss against the penalty; Spark averages the loss, hence the row count."""
    penalty = 1 / (c * max(1, m.train.count()))
    return _fit(m, LogisticRegression(featuresCol="_x", labelCol=m.label, maxIter=200, regParam=penalty, standardization=False), True)


def ridge_weights(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> tuple[float, np.ndarray]:
    """Exact ridge (intercept not penalised) from one pass of centred second moments."""
    centre = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate([*features, target])]).first()
    shifted = df.select(F.lit(0).alias("fold"), *[(F.col(c) - F.lit(centre[i])).alias(f"c{i}") for i, c in enumerate([*features, target])])
    p = len(features)
    m = fold_moments(shifted, [f"c{i}" for i in range(p + 1)])[0]
    n = m[0, 0]
    first = m[0, 1:] / n
    scatter = m[1:, 1:] - n * np.outer(first, first)
    w = np.linalg.solve(scatter[:p, :p] + alpha * np.eye(p), scatter[:p, p])
    means = np.array(list(centre)) + first
    return float(means[p] - means[:p] @ w), w


def ridge_scores(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float], fold: str) -> list[float]:
    """Negative mean fold RMSE of every penalty, from one pass of second moments.

    A fold's training scatter is decomposed once; every penalty then only divides by shifted
    eigenvalues, and its held-out error is a quadratic form in the fold's own moments.
    """
    names = [*features, target]
    centre = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
    shifted = df.select(F.col(fold).alias("fold"), *[(F.col(c) - F.lit(centre[i])).alias(f"c{i}") for i, c in enumerate(names)])
    moments, p = fold_moments(shifted, [f"c{i}" for i in range(len(names))]), len(features)
    total, errors = sum(moments.values()), np.zeros((len(moments), len(alphas)))
    for k, held in enumerate(moments.values()):
        m = total - held
        first = m[0, 1:] / m[0, 0]
        scatter = m[1:, 1:] - m[0, 0] * np.outer(first, first)
        values, vectors = np.linalg.eigh(scatter[:p, :p])
        turned = vectors.T @ scatter[:p, p]
        for j, alpha in enumerate(alphas):
            w = vectors @ (turned / (np.maximum(values, 0) + alpha))
            u = np.concatenate([[first[:p] @ w - first[p]], -w, [1.0]])
            errors[k, j] = np.sqrt(max(0.0, u @ held @ u) / held[0, 0])
    return [float(-x) for x in errors.mean(axis=0)]


def linear_prediction(intercept: float, weights: Sequence[float], features: Sequence[str]):
    out = F.lit(float(intercept))
    for c, w in zip(features, weights):
        out = out + F.col(c) * F.lit(float(w))
    return out


def ridge(m: ModelInput, alpha: float = 1.0) -> Predictor:
    b, w = ridge_weights(m.train, m.features, m.label, alpha)
    return lambda df: df.withColumn("prediction", linear_prediction(b, w, m.features))


def _fourier(m: ModelInput, gamma: float | str = "scale", size: int = 256) -> Predictor:
    """Random cosine features whose inner products approximate the Gaussian kernel."""
    spread = m.train.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(m.features)], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(m.features)]).first()
    p = len(m.features)
    centre = np.array([spread[f"m{i}"] for i in range(p)])
    pooled = float(np.mean([spread[f"v{i}"] for i in range(p)]) + np.var(centre)) or 1.0
    rng = np.random.default_rng(m.seed)
    width = {"scale": 1 / (p * pooled), "auto": 1 / p}.get(gamma, gamma)
    w = rng.normal(0, np.sqrt(2 * width), (p, size))
    b = rng.uniform(0, 2 * np.pi, size)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        a = np.stack(x.to_numpy())
        return pd.Series(list(np.sqrt(2 / size) * np.cos(a @ w + b)))

    return lambda df: df.withColumn("_z", project(F.array(*[F.col(c).cast("double") for c in m.features])))


def kernel_svm(m: ModelInput, c: float = 1.0, gamma: float | str = "scale") -> Predictor:
    lift = _fourier(m, gamma)
    if not m.classes:
        names = [f"_z{i}" for i in range(256)]

        def wide(df):
            return lift(df).select("*", *[F.col("_z")[i].alias(n) for i, n in enumerate(names)]).drop("_z")

        b, w = ridge_weights(wide(m.train), names, m.label, 1.0 / c)
        weights = F.array(*[F.lit(float(x)) for x in w])
        total = F.aggregate(F.zip_with("_z", weights, lambda a, c: a * c), F.lit(float(b)), lambda a, x: a + x)
        return lambda df: lift(df).withColumn("prediction", total).drop("_z")
    svc = LinearSVC(featuresCol="_x", labelCol=m.label, maxIter=100, regParam=1.0 / (c * max(1, m.train.count())))
    train = lift(m.train).withColumn("_x", array_to_vector("_z")).drop("_z")
    if m.classes == 2:
        train = with_class_weight(train, m.label, class_weights(train, m.label, threshold=1.0))
        model = svc.copy({svc.weightCol: "weight"}).fit(train)
    else:
        model = OneVsRest(classifier=svc, featuresCol="_x", labelCol=m.label).fit(train)

    def predict(df):
        scored = model.transform(lift(df).withColumn("_x", array_to_vector("_z")).drop("_z"))
        if "rawPrediction" in scored.columns and m.classes == 2:
            scored = scored.withColumn("proba", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))
        return scored.drop("rawPrediction", "_x")

    return predict


#: Trees of one fit of a forest, fits at once, training rows of a partition there.
TREES, FITS, PART_ROWS = 30, 8, 25_000


def forest(m: ModelInput, **settings) -> Predictor:
    """Trees of ``m.depth`` levels at most, unless ``settings`` say otherwise.

    Trees do not depend on each other, so those of a large forest are fitted in several parts at
    once, each with its own seed, and their votes are averaged by number of trees. Every partition sends
    its statistics of every node, so the rows are held in as few as their number asks for.
    """
    kind = RandomForestClassifier if m.classes else RandomForestRegressor
    stated = {"featuresCol": "_x", "labelCol": m.label, "numTrees": m.trees, "maxDepth": m.depth, "seed": m.seed} | settings
    parts = -(-stated["numTrees"] // TREES)
    if parts == 1:
        return _fit(m, kind(**stated), True)
    train = m.train.coalesce(max(1, -(-m.train.count() // PART_ROWS))).cache()
    sizes = [stated["numTrees"] * (i + 1) // parts - stated["numTrees"] * i // parts for i in range(parts)]
    draws = np.random.default_rng(stated["seed"]).integers(0, 2**31, parts).tolist()
    held = replace(m, train=train)
    with ThreadPoolExecutor(FITS) as pool:
        fits = list(pool.map(lambda size, seed: _fit(held, kind(**stated | {"numTrees": size, "seed": seed}), True), sizes, draws))
    train.unpersist()
    names = [str(i) for i in range(parts)]
    votes = ensemble(dict(zip(names, fits)), m.classes, dict(zip(names, map(float, sizes))), "_t")
    # Of two classes with equal votes a forest calls the first.
    return (lambda df: votes(df).withColumn("prediction", (F.col("proba") > 0.5).cast("double"))) if m.classes == 2 else votes


def boosting(m: ModelInput, **settings) -> Predictor:
    """More than two classes are boosted one against the rest."""
    stated = {"featuresCol": "_x", "labelCol": m.label, "maxIter": m.boost_rounds, "seed": m.seed} | settings
    if not m.classes:
        return _fit(m, GBTRegressor(**stated), False)
    one = GBTClassifier(**stated)
    return _fit(m, one, True) if m.classes == 2 else _fit(m, OneVsRest(classifier=one, featuresCol="_x", labelCol=m.label), False)


CLASSIFIERS = {
    "dummy_majority": majority, "logistic_regression": logistic, "svm": kernel_svm,
    "random_forest": forest, "hist_gradient_boosting": boosting,
}
REGRESSORS = {
    "dummy_mean": mean, "ridge": ridge, "svm": kernel_svm, "random_forest": forest,
    "hist_gradient_boosting": boosting,
}


def evaluate(scored: DataFrame, label: str, classes: int) -> DataFrame:
    """Metrics of one prediction table as (metric, value) rows."""
    if not classes:
        wide = metrics.regression(scored, label, "prediction")
    else:
        wide = metrics.classification(scored.withColumn(label, F.col(label).cast("double")), label, "prediction")
        if "proba" in scored.columns:
            if classes == 2:
                extra = metrics.ranking(scored, label, "proba").first()
                wide = wide.withColumns({c: F.lit(extra[c]) for c in ("roc_auc", "pr_auc", "brier")})
            else:
                spread = scored.select(label, *[F.col("proba")[i].alias(f"s{i}") for i in range(classes)])
                auc = metrics.one_vs_rest_auc(spread, label, [f"s{i}" for i in range(classes)], range(classes)).first()[0]
                wide = wide.withColumn("roc_auc", F.lit(auc))
    doubles = [F.col(c).cast("double").alias(c) for c in wide.columns]
    return wide.select(*doubles).unpivot([], wide.columns, "metric", "value")


#: What estimators raise about their input.
ESTIMATOR_ERRORS = (KeyError, ValueError, np.linalg.LinAlgError, IllegalArgumentException)


def run_baselines(m: ModelInput, test: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(model, metric, value, error): a model that cannot be fitted is a row; a failed Spark job is an exception.

    The models are fitted side by side.
    """
    registry = CLASSIFIERS if m.classes else REGRESSORS
    spark = m.train.sparkSession

    def measured(name: str) -> DataFrame:
        try:
            if name not in registry:
                raise KeyError(f"no model '{name}' for this task")
            return evaluate(registry[name](m)(test), m.label, m.classes).select(
                F.lit(name).alias("model"), "metric", "value", F.lit(None).cast("string").alias("error")
            )
        except ESTIMATOR_ERRORS as problem:
            error = str(problem).splitlines()[0][:200]
            return spark.createDataFrame([(name, None, None, error)], "model string, metric string, value double, error string")

    names = list(names or registry)
    with ThreadPoolExecutor(len(names)) as pool:
        parts = list(pool.map(measured, names))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- tuning
# Search spaces, under the names of the Spark parameters where there is one.
SPACES: dict[str, dict[str, list]] = {
    "random_forest": {
        "numTrees": [200, 400, 800], "maxDepth": [6, 12, 20], "minInstancesPerNode": [1, 2, 4, 8],
        "featureSubsetStrategy": ["sqrt", "log2", "0.3", "0.6"],
    },
    "hist_gradient_boosting": {
        "stepSize": [0.01, 0.03, 0.06, 0.1, 0.2], "maxDepth": [4, 5, 6],
        "minInstancesPerNode": [5, 10, 20, 40], "maxIter": [200, 400],
    },
    "logistic_regression": {"c": [0.01, 0.1, 0.5, 1.0, 5.0, 20.0]},
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "svm": {"c": [0.1, 0.5, 1.0, 5.0, 10.0, 50.0], "gamma": ["scale", "auto", 0.001, 0.01, 0.1]},
}
TUNED: dict[str, Callable[..., Predictor]] = {
    "random_forest": forest, "hist_gradient_boosting": boosting, "logistic_regression": logistic, "ridge": ridge, "svm": kernel_svm,
}


def sample_space(space: Mapping[str, Sequence], count: int, seed: int) -> list[dict]:
    """Distinct random combinations, all of them when there are fewer."""
    sizes = [len(v) for v in space.values()]
    total = int(np.prod(sizes))
    picks = random.Random(seed).sample(range(total), min(count, total))
    out = []
    for pick in picks:
        chosen = {}
        for name, options in space.items():
            pick, at = divmod(pick, len(options))
            chosen[name] = options[at]
        out.append(chosen)
    return out


def _fold_score(held: DataFrame, m: ModelInput, fold: str) -> float:
    """Mean over folds: AUC for two classes, accuracy for more, negative RMSE otherwise."""
    if m.classes == 2:
        return float(metrics.ranking(held, m.label, "proba", [fold]).agg(F.avg("roc_auc")).first()[0])
    if m.classes:
        value = F.avg((F.col("prediction") == F.col(m.label)).cast("double"))
    else:
        e = F.col("prediction") - F.col(m.label)
        value = -F.sqrt(F.avg(e * e))
    return float(held.groupBy(fold).agg(value.alias("v")).agg(F.avg("v")).first()[0])


def tune(
    m: ModelInput, name: str, fold: str = "fold", count: int = 25, space: Mapping | None = None,
    parallelism: int = 4,
) -> tuple[Predictor, dict, DataFrame]:
    """Random search with the given fold column (so groups stay together).

    Returns the refitted predictor, its parameters and the table of tried settings. Penalties of
    a ridge are all scored from one data pass.
    """
    settings = sample_space(space or SPACES[name], count, m.seed)
    spark, build = m.train.sparkSession, TUNED[name]

    def cv_score(chosen: dict) -> float:
        return _fold_score(out_of_fold(m, lambda part: build(part, **chosen), fold), m, fold)

    if name == "ridge":
        scores = ridge_scores(m.train, m.features, m.label, [s["alpha"] for s in settings], fold)
    else:
        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(cv_score, settings))
    best = int(np.argmax(scores))
    predictor = build(m, **settings[best])
    tried = spark.createDataFrame(
        [(name, i, str(s), float(x)) for i, (s, x) in enumerate(zip(settings, scores))],
        "model string, candidate int, settings string, cv_score double",
    )
    return predictor, settings[best], tried


def out_of_fold(m: ModelInput, fit: Callable[[ModelInput], Predictor], fold: str = "fold") -> DataFrame:
    """Each training row scored by the model that did not see its fold."""
    out = None
    for f in sorted(r[0] for r in m.train.select(fold).distinct().collect()):
        rest = replace(m, train=m.train.filter(F.col(fold) != f))
        part = fit(rest)(m.train.filter(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(m: ModelInput, fit: Callable[[ModelInput], Predictor], method: str = "isotonic", fold: str = "fold") -> Predictor:
    """Map scores to probabilities learnt from out-of-fold scores (two classes)."""
    held = out_of_fold(m, fit, fold).select(F.col(m.label).cast("double").alias("y"), F.col("proba").alias("s"))
    base = fit(m)
    vector = VectorAssembler(inputCols=["s"], outputCol="_s")
    train = vector.transform(held)
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="_s", labelCol="y", predictionCol="_c").fit(train)

        def read(df):
            return model.transform(df).withColumn("proba", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_c"))).drop("_c")
    else:
        model = LogisticRegression(featuresCol="_s", labelCol="y", predictionCol="_c").fit(train)

        def read(df):
            return model.transform(df).withColumn("proba", vector_to_array("probability")[1]).drop("_c", "probability", "rawPrediction")

    def predict(df):
        scored = vector.transform(base(df).withColumn("s", F.col("proba")))
        return read(scored).withColumn("prediction", (F.col("proba") >= 0.5).cast("double")).drop("s", "_s")

    return predict


def ensemble(models: Mapping[str, Predictor], classes: int, weights: Mapping[str, float] | None = None, mark: str = "_m") -> Predictor:
    """Weighted mean of probabilities or predictions.

    Every model adds its column, named by ``mark``, to the same row in turn, so no join is needed.
    An ensemble within another has a mark of its own.
    """
    if len(models) < 2:
        raise ValueError("an ensemble needs at least two models")
    names = list(models)
    w = {n: (weights or {}).get(n, 1.0) for n in names}
    total = sum(w.values())

    def predict(df):
        for i, n in enumerate(names):
            df = models[n](df)
            df = df.withColumn(f"{mark}{i}", F.col("proba" if classes else "prediction")).drop("prediction", "proba")
        if classes > 2:
            mix = [sum([F.col(f"{mark}{i}")[k] * (w[n] / total) for i, n in enumerate(names)], F.lit(0.0)) for k in range(classes)]
            df = df.withColumn("proba", F.array(*mix))
            pick = F.array_position("proba", F.array_max("proba")) - 1
            return df.withColumn("prediction", pick.cast("double")).drop(*[f"{mark}{i}" for i in range(len(names))])
        mixed = sum([F.col(f"{mark}{i}") * (w[n] / total) for i, n in enumerate(names)], F.lit(0.0))
        df = df.withColumn("proba" if classes else "prediction", mixed)
        if classes:
            df = df.withColumn("prediction", (F.col("proba") >= 0.5).cast("double"))
        return df.drop(*[f"{mark}{i}" for i in range(len(names))])

    return predict


# ---------------------------------------------------------------- fusion of blocks
def early_fusion(m: ModelInput, blocks: Mapping[str, Sequence[str]], fit: Callable[[ModelInput], Predictor]) -> Predictor:
    """All blocks side by side plus their presence flags, one model."""
    flags = [f"has_{b}" for b in blocks if f"has_{b}" in m.train.columns]
    columns = [c for cs in blocks.values() for c in cs] + flags

    def numeric(df):
        return df.withColumns({f: F.col(f).cast("double") for f in flags}) if flags else df

    wide = replace(m, train=numeric(m.train), features=tuple(columns))
    inner = fit(wide)
    return lambda df: inner(numeric(df))


def simplex_weights(gram: np.ndarray, cross: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Nonnegative weights summing to one that minimise w'Gw - 2c'w."""
    k = cross.size
    w = np.full(k, 1.0 / k)
    rate = 1.0 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    for _ in range(steps):
        z = np.sort(w - rate * (gram @ w - cross))[::-1]
        excess = (np.cumsum(z) - 1) / np.arange(1, k + 1)
        at = np.flatnonzero(z > excess)[-1]
        w = np.maximum(0, w - rate * (gram @ w - cross) - excess[at])
    return w


def late_fusion(
    m: ModelInput, blocks: Mapping[str, Sequence[str]], validation: DataFrame,
    fit: Callable[[ModelInput], Predictor],
) -> tuple[Predictor, dict[str, float]]:
    """One model per block, mixed with readable weights learnt on validation rows."""
    names = list(blocks)
    models = {
        b: fit(replace(m, features=tuple(blocks[b])))
        for b in names
    }
    scored = validation
    for i, b in enumerate(names):
        scored = models[b](scored).withColumn(f"_b{i}", F.col("proba" if m.classes else "prediction")).drop("prediction", "proba")
    k = len(names)

    def product(i: int, j: int):
        if m.classes > 2:
            both = F.zip_with(f"_b{i}", f"_b{j}", lambda a, c: a * c)
            return F.avg(F.aggregate(both, F.lit(0.0), lambda a, x: a + x))
        return F.avg(F.col(f"_b{i}") * F.col(f"_b{j}"))

    def with_truth(i: int):
        if m.classes > 2:
            return F.avg(F.get(F.col(f"_b{i}"), F.col(m.label).cast("int")))
        return F.avg(F.col(f"_b{i}") * F.col(m.label).cast("double"))

    row = scored.agg(
        *[product(i, j) for i in range(k) for j in range(k)], *[with_truth(i) for i in range(k)]
    ).first()
    w = simplex_weights(np.array(row[: k * k]).reshape(k, k), np.array(row[k * k :]))
    weights = {b: float(x) for b, x in zip(names, w)}
    return ensemble(models, m.classes, weights), weights


def block_ablation(
    m: ModelInput, blocks: Mapping[str, Sequence[str]], test: DataFrame,
    fit: Callable[[ModelInput], Predictor], fused: Predictor,
) -> DataFrame:
    """Metrics of every single block and of the fused model."""
    out = evaluate(fused(test), m.label, m.classes).withColumn("model", F.lit("fused"))
    for b, columns in blocks.items():
        one = fit(replace(m, features=tuple(columns)))
        out = out.unionByName(evaluate(one(test), m.label, m.classes).withColumn("model", F.lit(f"{b}_only")))
    return out.select("model", "metric", "value")


def fusion_verdict(table: DataFrame, task: str) -> DataFrame:
    metric = metrics.primary_metric(task)
    sign = 1 if task == "classification" else -1
    rows = table.filter((F.col("metric") == metric) & F.col("value").isNotNull())
    single = F.max(F.when(F.col("model") != "fused", F.struct((F.col("value") * sign).alias("k"), "model", "value")))
    fused = F.max(F.when(F.col("model") == "fused", F.col("value")))
    return rows.agg(fused.alias("fused"), single.alias("best")).select(
        F.lit(metric).alias("metric"), "fused", F.col("best.model").alias("best_single"),
        F.col("best.value").alias("best_single_value"),
        (F.col("fused") * sign > F.col("best.value") * sign).alias("fusion_helped"),
    )


def split_input(df: DataFrame, features: Sequence[str], label: str, classes: int, **options) -> tuple[ModelInput, DataFrame]:
    """Model input from the training side and the test rows."""
    return ModelInput(train_rows(df), tuple(features), label, classes, **options), df.filter("split = 'test'")
