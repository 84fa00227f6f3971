"""Metrics, statistics, resampling, subset search, models and whole flows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.operators import metrics, models, resample, search, splits, stats
from tidemark.plans import experiments


# ---------------------------------------------------------------- metrics and statistics
def test_metric_floor(spark):
    df = spark.createDataFrame([(0, 0)] * 80 + [(1, 0)] * 20, "y int, p int")
    m = metrics.classification(df, "y", "p").first()
    assert m["accuracy"] == 0.8 == m["majority_class_accuracy"] and m["balanced_accuracy"] == 0.5
    assert m["f1"] == m["precision"] == m["recall"] == m["mcc"] == 0 and m["cohen_kappa"] == pytest.approx(0)


def test_mean_prediction(spark):
    y = np.random.default_rng(0).normal(size=100)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": y.mean()}))
    m = metrics.regression(df, "y", "p").first()
    assert m["rmse_vs_mean_baseline"] == pytest.approx(1) and m["r2"] == pytest.approx(0)
    assert m["medae"] == pytest.approx(np.median(np.abs(y - y.mean())))


def test_auc_in_chunks(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 800), "s": np.round(rng.random(800), 2)})
    df = spark.createDataFrame(pdf)
    a, b = (metrics.ranking(df, "y", "s", rows_per_chunk=k).first() for k in (None, 60))
    pos, neg = pdf[pdf.y == 1].s.to_numpy(), pdf[pdf.y == 0].s.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (pos.size * neg.size)
    assert a["roc_auc"] == pytest.approx(want) and tuple(a) == pytest.approx(tuple(b))


def test_tails():
    assert tails.t_quantile(0.975, 4) == pytest.approx(2.7764451)
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.0733880)
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05)
    assert tails.f_upper(4.964602744, 1, 10) == pytest.approx(0.05)
    assert tails.format_p(0.0001) == "<0.001" and tails.stars(0.02) == "*" and tails.format_p(None) == "-"


def test_small_sample_tests():
    # Published critical values and textbook cases.
    assert stats._exact_mann_whitney(0, 3, 3) == pytest.approx(0.1)
    assert stats._exact_mann_whitney(2, 4, 5) == pytest.approx(2 * 4 / 126)
    assert stats._exact_signed_rank(0, 5) == pytest.approx(0.0625)


def test_group_comparison(spark):
    rng = np.random.default_rng(2)
    g = np.repeat([0, 1], 200)
    pdf = pd.DataFrame({"value": rng.normal(g * 1.0, 1), "category": np.where(rng.random(400) < 0.3 + 0.4 * g, "a", "b"), "g": g})
    df = spark.createDataFrame(pdf)
    out = {r["variable"]: r for r in stats.compare_groups(df, "g", ["value", "category"]).collect()}
    assert abs(out["value"]["effect_value"]) > 0.5 and out["value"]["stars"] == "***"
    assert out["category"]["test"] == "Chi-square"
    normal = spark.createDataFrame(pd.DataFrame({"normal": rng.normal(size=200), "skewed": rng.exponential(size=200)}))
    table = {r["variable"]: r["distribution"] for r in stats.normality(normal, ["normal", "skewed"]).collect()}
    assert table == {"normal": "Normal", "skewed": "Non-normal"}
    wide = spark.createDataFrame(pd.DataFrame({"g": np.arange(24_000) % 3, "even": rng.normal(size=24_000), "skewed": rng.exponential(size=24_000)}))
    chosen = {r["variable"]: r["test"] for r in stats.compare_groups(wide, "g", ["even", "skewed"], alpha=1e-6).collect()}
    assert chosen == {"even": "One-way ANOVA", "skewed": "Kruskal-Wallis"}
    assert stats.compare_groups(wide, "g", ["skewed"], test="parametric").first()["test"] == "One-way ANOVA"
    barred = wide.select(F.col("even").alias("a|b"), F.col("skewed").alias("c"))
    assert stats.correlation_matrix(barred, ["a|b", "c"], "pearson").filter("a = 'a|b' and b = 'c'").count() == 1
    x = rng.normal(size=200)
    pair = spark.createDataFrame(pd.DataFrame({"x": x, "noise": rng.normal(size=200), "y": 2 * x + rng.normal(0, 0.1, 200)}))
    assert stats.correlate_with(pair, "y", ["noise", "x"]).first()["variable"] == "x"


def test_spearman_with_gaps(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": np.round(rng.normal(size=300), 1), "y": np.round(rng.normal(size=300), 1)})
    pdf["b"] = np.where(rng.random(300) < 0.2, np.nan, pdf.a + pdf.y)
    got = stats.spearman_many(spark.createDataFrame(pdf), "y", ["a", "b"])
    for c in "ab":
        pair = pdf[[c, "y"]].dropna()
        assert got[c] == (len(pair), pytest.approx(np.corrcoef(pair[c].rank(), pair["y"].rank())[0, 1]))


def test_rank_products_of_millions_of_rows_do_not_overflow(spark):
    rows = spark.range(4_000_000).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2 * 3.0 + 1).alias("_ry"))
    got = stats.rank_products(rows, "x", [], "_ry").first()
    assert got["n"] == 4_000_000


def test_ranks_of_frequent_and_rare_values(spark, monkeypatch):
    monkeypatch.setattr(stats, "SHARE", 10)
    x = np.array([1.0] * 500 + [2.0] * 300 + list(range(3, 203)))
    got = stats.with_ranks(spark.createDataFrame(pd.DataFrame({"k": 1, "x": x})), "x", ["k"], "rank").toPandas()
    assert len(got) == len(x) and (got.sort_values("x")["rank"].to_numpy() == pd.Series(x).rank().to_numpy()).all()
    plan = stats.with_ranks(spark.createDataFrame(pd.DataFrame({"x": x})), "x", [], "rank")
    assert plan.count() == len(x)


def test_rank_correlations_take_the_same_jobs_for_any_columns(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({c: np.round(rng.normal(size=300), 1) for c in "abcdefy"}).assign(k=1.0)
    pdf.loc[::7, ["b", "d"]] = np.nan
    pdf.loc[::5, "d"] = np.inf
    df = spark.createDataFrame(pdf)
    want = pdf.replace(np.inf, np.nan).corr(method="spearman")

    def jobs(name, work):
        spark.sparkContext.setJobGroup(name, "")
        out = work()
        count = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, count

    few, some = jobs("two ranks", lambda: stats.spearman_many(df, "y", ["a", "b"]))
    many, count = jobs("seven ranks", lambda: stats.spearman_many(df, "y", ["a", "b", "c", "d", "e", "f", "k"]))
    assert count == some and few["a"] == many["a"] and many["k"] == (300, None)
    assert {c: many[c][1] for c in "abcdef"} == pytest.approx({c: want.loc[c, "y"] for c in "abcdef"})
    rows = stats.correlation_matrix(df, list("abcdef")).collect()
    assert {(r.a, r.b): r.r for r in rows} == pytest.approx({(a, b): want.loc[a, b] for a in "abcdef" for b in "abcdef" if a <= b})


def test_bootstrap_intervals_cover(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(400), "y": rng.normal(size=400), "p": 0.0, "k": rng.integers(0, 2, 400), "c": 1})
    df = spark.createDataFrame(pdf)
    values = resample.bootstrap_regression(df, "id", "y", "p", "mse", 200)
    row = resample.interval(values, "value").first()
    assert row["ci_lower"] < (pdf.y**2).mean() < row["ci_upper"]
    assert row["std"] == pytest.approx((pdf.y**2).std() / 20, rel=0.25)
    again = resample.bootstrap_regression(df.repartition(7), "id", "y", "p", "mse", 200)
    assert resample.interval(again, "value").first()["mean"] == pytest.approx(row["mean"], rel=1e-12)
    acc = resample.interval(resample.bootstrap_classification(df, "k", "c", "accuracy", 200), "value").first()
    assert acc["ci_lower"] < pdf.k.mean() < acc["ci_upper"]


def test_permutation_in_chunks_keeps_values(spark):
    df = spark.range(300).withColumn("x", F.col("id") * 2)
    a = {r["id"]: r["x"] for r in resample.permuted(df, "id", "x", 5).collect()}
    b = {r["id"]: r["x"] for r in resample.permuted(df, "id", "x", 5, rows_per_chunk=40).collect()}
    assert a == b and sorted(a.values()) == list(range(0, 600, 2)) and any(a[i] != 2 * i for i in a)


# ---------------------------------------------------------------- search
@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 10))
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(10)])
    pdf["y"] = 3 * x[:, 2] - 2 * x[:, 5] + rng.normal(0, 0.5, 400)
    pdf["cls"] = (pdf["y"] > 0).astype(int)
    pdf["id"] = range(400)
    df = splits.random_folds(spark.createDataFrame(pdf), "id").cache()
    return df, [f"x{i}" for i in range(10)], df.toPandas()


def test_moment_scores_equal_refits(planted):
    df, names, pdf = planted
    score = search.linear_regression_scorer(df, names, "y")
    mask = np.array([0, 1, 1, 0, 0, 1, 0, 0, 0, 1], dtype=bool)
    columns = [n for n, on in zip(names, mask) if on]
    errors = []
    for f in range(5):
        train, held = pdf[pdf.fold != f], pdf[pdf.fold == f]
        a = np.column_stack([np.ones(len(train)), train[columns]])
        w = np.linalg.lstsq(a, train["y"], rcond=None)[0]
        errors.append(np.sqrt(((np.column_stack([np.ones(len(held)), held[columns]]) @ w - held["y"]) ** 2).mean()))
    assert score([mask])[0] == pytest.approx(1 - np.mean(errors) / pdf["y"].std(ddof=0), abs=1e-6)


def test_search_finds_planted_features(planted):
    df, names, _ = planted
    quick = search.SearchSettings(population=12, generations=15)
    a = search.search(names, search.linear_regression_scorer(df, names, "y"), quick)
    b = search.search(names, search.linear_regression_scorer(df.repartition(3), names, "y"), quick)
    assert {"x2", "x5"} <= set(a.selected) and a.selected == b.selected
    assert 1 <= len(a.selected) <= 5 and np.isfinite(a.fitness)
    best = [h[1] for h in a.history]
    assert best == sorted(best)
    c = search.search(names, search.linear_class_scorer(df, names, "cls", 2), quick)
    assert {"x2", "x5"} <= set(c.selected) and c.score > 0.85


def test_masks_solved_on_executors_and_runs_side_by_side_change_nothing(spark, planted, monkeypatch):
    df, names, _ = planted
    masks = [np.random.default_rng(i).random(len(names)) < 0.4 for i in range(20)]
    here = search.linear_regression_scorer(df, names, "y")(masks)
    quick = search.SearchSettings(population=6, generations=4)
    scorer = search.linear_regression_scorer(df, names, "y")
    alone = [search.search(names, scorer, search.replace(quick, seed=seed, **search.VARIANTS[v])) for v in ("full", "random_search") for seed in (1, 2)]
    monkeypatch.setattr(search, "WORK", 0)
    assert search.linear_regression_scorer(df, names, "y")(masks) == pytest.approx(here, rel=1e-12)
    calls = []
    counted = lambda asked: calls.append(len(asked)) or scorer(asked)
    runs = search.ablation_runs(spark, names, counted, quick, (1, 2), ("full", "random_search")).toPandas()
    assert runs.groupby(["variant", "seed"], sort=False)["fitness"].first().tolist() == pytest.approx([r.fitness for r in alone])
    assert runs["selected"].tolist() == [bool(x) for r in alone for x in r.mask]
    assert len(calls) <= 2 * (quick.generations + 1) and max(calls) > 6
    with pytest.raises(ZeroDivisionError):
        search.side_by_side([lambda ask: ask([1]), lambda ask: 0], lambda masks: 1 / 0)


# ---------------------------------------------------------------- models
def test_ridge_equals_closed_form(planted):
    df, names, pdf = planted
    b, w = models.ridge_weights(df, names, "y", 1.0)
    x = pdf[names].to_numpy()
    xc, yc = x - x.mean(0), pdf["y"] - pdf["y"].mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(10), xc.T @ yc)
    np.testing.assert_allclose(w, want, atol=1e-9)
    assert b == pytest.approx(pdf["y"].mean() - x.mean(0) @ want)


def test_baselines_beat_the_trivial_ones(planted):
    df, names, _ = planted
    parted = splits.random_split(df, "id").cache()
    m, test = models.split_input(parted, names, "cls", 2, trees=10, boost_rounds=5)
    out = models.run_baselines(m, test, ["dummy_majority", "logistic_regression", "svm", "nope"]).toPandas()
    acc = out[out.metric == "balanced_accuracy"].set_index("model")["value"]
    assert acc["dummy_majority"] == 0.5 and acc["logistic_regression"] > 0.9 and acc["svm"] > 0.8
    assert out[out.model == "nope"]["error"].notna().all()


def test_weights_fall_on_the_informative_block(planted):
    df, names, _ = planted
    parted = splits.nested_split(df, "id").cache()
    m = models.ModelInput(parted.filter("split = 'train'"), tuple(names), "y", 0)
    _, weights = models.late_fusion(m, {"good": ["x2", "x5"], "bad": ["x0", "x1"]}, parted.filter("split = 'validation'"), models.ridge)
    assert weights["good"] > 0.9 and sum(weights.values()) == pytest.approx(1)


def test_tuning_and_many_classes(planted):
    df, names, _ = planted
    halves = df.withColumn("fold", F.col("fold") % 2)
    three = halves.withColumn("third", (F.when(F.col("y") < -1.5, 0).when(F.col("y") < 1.5, 1).otherwise(2)))
    parted = splits.nested_split(three, "id").cache()
    m = models.ModelInput(parted.filter("split = 'train'"), tuple(names), "third", 3)
    fused, weights = models.late_fusion(m, {"good": ["x2", "x5"], "bad": ["x0", "x1"]}, parted.filter("split = 'validation'"), models.logistic)
    assert weights["good"] > 0.8
    out = models.evaluate(fused(parted.filter("split = 'test'")), "third", 3).toPandas().set_index("metric")["value"]
    assert out["accuracy"] > 0.8 and out["roc_auc"] > 0.9
    real = models.ModelInput(parted.filter("split = 'train'"), tuple(names), "y", 0)
    _, best, tried = models.tune(real, "ridge", count=2)
    assert tried.count() == 2 and best["alpha"] in models.SPACES["ridge"]["alpha"]
    scores = tried.toPandas()["cv_score"]
    assert (scores < 0).all()
    two = models.ModelInput(parted.filter("split = 'train'"), tuple(names), "cls", 2)
    _, _, tried = models.tune(two, "svm", count=1, space={"c": [1.0], "gamma": ["scale"]})
    assert (tried.toPandas()["cv_score"] > 0.8).all()


def test_ridge_penalties_from_one_pass_equal_refits(planted):
    df, names, pdf = planted
    alphas = [0.01, 5.0, 500.0]
    want = []
    for alpha in alphas:
        errors = []
        for f in range(5):
            train, held = pdf[pdf.fold != f], pdf[pdf.fold == f]
            x, y = train[names] - train[names].mean(), train["y"] - train["y"].mean()
            w = np.linalg.solve(x.T @ x + alpha * np.eye(len(names)), x.T @ y)
            guess = train["y"].mean() + (held[names] - train[names].mean()) @ w
            errors.append(np.sqrt(((guess - held["y"]) ** 2).mean()))
        want.append(-np.mean(errors))
    assert models.ridge_scores(df, names, "y", alphas, "fold") == pytest.approx(want, rel=1e-9)


# ---------------------------------------------------------------- flows
QUICK = experiments.TableSettings(
    search=search.SearchSettings(population=8, generations=3), bootstrap=20, repeats=1, trees=5, boost_rounds=3
)


def test_table_flow(spark, planted):
    df, names, _ = planted
    data = df.drop("fold", "cls").withColumn("site", F.concat(F.lit("s"), (F.col("id") % 4).cast("string")))
    settings = experiments.TableSettings(**{**QUICK.__dict__, "baselines": ["dummy_mean", "ridge"]})
    out = experiments.table_experiment(data, "id", "y", settings=settings)
    table = out["baselines"].filter("metric = 'rmse'").toPandas().set_index("model")["value"]
    assert table["ridge"] < table["dummy_mean"]
    assert out["selected"].filter("selected").count() >= 1 and out["interval"].first()["n_valid"] == 20
    assert out["importance"].count() == out["selected"].filter("selected").count()


def test_class_flow_with_groups(spark, planted):
    df, names, _ = planted
    data = df.drop("fold", "y").withColumn("who", F.col("id") % 20)
    settings = experiments.TableSettings(**{**QUICK.__dict__, "baselines": ["dummy_majority", "logistic_regression"]})
    out = experiments.table_experiment(data, "id", "cls", group="who", settings=settings)
    assert out["group_overlap"].isEmpty() and out["thresholds"].count() == 91


def test_manifest_flow(spark):
    rng = np.random.default_rng(6)
    n = 120
    y = rng.integers(0, 2, n)
    pdf = pd.DataFrame({
        "id": range(n), "age": rng.normal(50 + 15 * y, 5), "sex": np.where(rng.random(n) < 0.5, "f", "m"),
        "note_text": [("calm and rested after sleep " if k else "tired with pain and fever ") * 4 for k in y],
        "gene_a": rng.normal(size=n), "gene_b": rng.normal(size=n), "outcome": y,
    })
    out = experiments.manifest_experiment(spark.createDataFrame(pdf), "id", "outcome")
    verdict = out["verdict"].first()
    assert verdict["fused"] > 0.8 and out["ablation"].select("model").distinct().count() == 4
    assert out["weights"].agg(F.sum("value") if "value" in out["weights"].columns else F.sum("weight")).first()[0] == pytest.approx(1)


def test_segment_flow(spark):
    from tidemark.sources import segments

    rng = np.random.default_rng(7)
    rows = []
    for subject in ("c1s01", "c1s02"):
        for i in range(14):
            t0 = 1_700_000_000_000_000 + i * 300_000_000

            def node(rate, **channels):
                n = int(60 * rate)
                return {"Time": [t0 + int(k * 1e6 / rate) for k in range(n)]} | {c: f(n).tolist() for c, f in channels.items()}

            noise = lambda n: rng.normal(size=n)
            wave = lambda n: np.sin(2 * np.pi * 0.25 * np.arange(n) / 25)
            rows.append((subject, i, t0, 100.0 + i, node(10, Vertical=noise, Lateral=noise, Sagittal=noise), node(25, BreathingWaveform=wave), node(4, EDA=noise)))
    kind = "array<long>"
    flat = spark.createDataFrame(
        rows, f"subject_id string, segment_no long, t long, glucose double, a struct<Time:{kind},Vertical:array<double>,Lateral:array<double>,Sagittal:array<double>>, "
        f"b struct<Time:{kind},BreathingWaveform:array<double>>, e struct<Time:{kind},EDA:array<double>>",
    )

    def timed(node, *channels):
        return F.struct(F.transform(F.col(f"{node}.Time"), lambda t: F.timestamp_micros(t)).alias("Time"), *[F.col(f"{node}.{c}") for c in channels])

    df = flat.select(
        "subject_id", "segment_no", F.timestamp_micros("t").alias("Timestamp"), "glucose",
        F.struct(timed("a", "Vertical", "Lateral", "Sagittal").alias("Accel"), timed("b", "BreathingWaveform").alias("Breathing")).alias("zephyr"),
        F.struct(timed("e", "EDA").alias("EDA")).alias("e4"),
    )
    pairs = experiments.segment_pairs(df, 6).toPandas()
    assert len(pairs) == 16 and (pairs["target"] - pairs["glucose_now"] == 6).all()
    assert pairs["resp_rate_bpm"].between(14, 16).all() and pairs["eda_tonic_mean"].notna().all()
    report = experiments.segment_report(df, experiments.segment_pairs(df, 6)).toPandas()
    assert (report["pairs"] == 8).all() and (report["dropped"] == 6).all()
    assert segments.inventory(df).filter("subject_id = 'total'").first()["segments"] == 28
