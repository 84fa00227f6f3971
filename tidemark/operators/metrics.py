"""Model metrics from (truth, prediction, score) columns.

Everything reduces to small tables first: a confusion table, sums, or the counts per
distinct score, over which running totals are taken in chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators.clean import MAX_CLASSES
from tidemark.operators.ordering import Running, chunk_edges, exact_quantiles, running


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def confusion(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*keys, F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(n.alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and shares of each true class."""
    total = F.sum("n").over(Window.partitionBy("y"))
    return confusion(df, truth, predicted).withColumn("share", F.col("n") / total)


def _class_table(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per label: support, predicted count and hits, from a confusion table."""
    rows = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).alias("called"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("called"), F.lit(0).alias("hits")),
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    return rows.groupBy(*keys, "label").agg(
        F.sum("support").cast("double").alias("support"), F.sum("called").cast("double").alias("called"),
        F.sum("hits").cast("double").alias("hits"),
    )


def classification(
    df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Accuracy, balanced accuracy, F1, precision, recall, MCC, kappa and, for two
    labels, the confusion cells with specificity and NPV.

    Binary precision, recall and F1 describe the larger label; otherwise macro means.
    """
    keys = list(keys)
    cells = confusion(df, truth, predicted, keys, weight)
    labels = _class_table(cells, keys)
    t, c, h = F.col("support"), F.col("called"), F.col("hits")
    precision, recall = ratio(h, c), ratio(h, t)
    f1 = ratio(2 * h, t + c)
    top = F.max(F.struct("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), t.alias("support"), c.alias("called"), h.alias("hits")))
    low = F.min(F.struct("label", t.alias("support"), c.alias("called"), h.alias("hits")))
    n, hits = F.sum(t), F.sum(h)
    squares_t, squares_c, cross = F.sum(t * t), F.sum(c * c), F.sum(t * c)
    agg = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_labels"), n.alias("n"), hits.alias("hits"),
        F.avg(F.when(t > 0, recall)).alias("balanced_accuracy"), F.count_if(t > 0).alias("n_true"),
        F.avg(precision).alias("mp"), F.avg(recall).alias("mr"), F.avg(f1).alias("mf"),
        (hits * n - cross).alias("cov"), (n * n - squares_c).alias("vc"), (n * n - squares_t).alias("vt"),
        cross.alias("cross"), F.max(t).alias("largest"), top.alias("top"), low.alias("low"),
    )
    binary = F.col("n_labels") <= 2
    cells2 = (F.col("n_labels") == 2) & (F.col("n_true") == 2)
    tn, tp = F.col("low.hits"), F.col("top.hits")
    fp, fn = F.col("top.called") - tp, F.col("low.called") - tn
    expected = F.col("cross") / (F.col("n") * F.col("n"))
    accuracy = F.col("hits") / F.col("n")
    spread = F.sqrt(F.col("vc")) * F.sqrt(F.col("vt"))
    return agg.select(
        *keys,
        accuracy.alias("accuracy"), "balanced_accuracy",
        F.when(binary, F.col("top.f1")).otherwise(F.col("mf")).alias("f1"),
        F.when(binary, F.col("top.precision")).otherwise(F.col("mp")).alias("precision"),
        F.when(binary, F.col("top.recall")).otherwise(F.col("mr")).alias("recall"),
        ratio(F.col("cov"), spread).alias("mcc"),
        F.when(expected < 1, (accuracy - expected) / (1 - expected)).alias("cohen_kappa"),
        F.when(cells2, tn).alias("tn"), F.when(cells2, fp).alias("fp"),
        F.when(cells2, fn).alias("fn"), F.when(cells2, tp).alias("tp"),
        F.when(cells2, ratio(tn, tn + fp)).alias("specificity"),
        F.when(cells2, ratio(tn, tn + fn)).alias("npv"),
        (F.col("largest") / F.col("n")).alias("majority_class_accuracy"),
        F.col("n").cast("long").alias("n_test"),
    )


def regression_sums(truth: str, predicted: str, weight: Column | None = None) -> list[Column]:
    """Combinable sums from which every mean-type regression metric follows."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    e, w = p - y, weight if weight is not None else F.lit(1.0)
    nonzero = F.abs(y) > 1e-9
    return [
        F.sum(w).alias("sw"), F.sum(w * e * e).alias("se2"), F.sum(w * F.abs(e)).alias("sae"),
        F.sum(w * e).alias("sbias"),
        F.sum(F.when(nonzero, w * F.abs(e / y))).alias("spe"), F.sum(F.when(nonzero, w)).alias("swnz"),
    ]


def regression(df: DataFrame, truth: str, predicted: str, medae: bool = True) -> DataFrame:
    """One row of error metrics next to the mean-prediction baseline."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    pairs = df.select(y.alias("y"), (p - y).alias("e")).withColumn("ae", F.abs("e"))
    nonzero = F.abs("y") > 1e-9
    base = pairs.agg(
        F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg("ae").alias("mae"), F.avg("e").alias("bias"),
        F.avg(F.when(nonzero, F.abs(F.col("e") / F.col("y")))).alias("pe"),
        F.avg("y").alias("target_mean"), F.stddev_pop("y").alias("target_std"),
        F.count(F.lit(1)).alias("n_test"),
    )
    rmse, sd = F.sqrt("mse"), F.col("target_std")
    # scikit-learn convention: a constant target scores 1 when exact, otherwise 0.
    r2 = F.when(sd > 0, 1 - F.col("mse") / (sd * sd)).when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    out = base.select(
        rmse.alias("rmse"), "mse", "mae", r2.alias("r2"),
        (100 * F.col("pe")).alias("mape_percent"), F.when(sd > 1e-12, rmse / sd).alias("nrmse_std"),
        sd.alias("mean_baseline_rmse"), F.when(sd > 1e-12, rmse / sd).alias("rmse_vs_mean_baseline"),
        "bias", "n_test", "target_mean", "target_std",
    )
    if not medae:
        return out
    return out.withColumn("medae", F.lit(exact_quantiles(pairs, ["ae"], [0.5])["ae"][0]))


# ---------------------------------------------------------------- ranking metrics
def score_table(
    df: DataFrame, truth: str, score: str, keys: Sequence[str] = (), rows_per_chunk: int | None = None
) -> DataFrame:
    """Per distinct score: positives, negatives and both totals at or above it."""
    y = F.col(truth)
    counts = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(y == 1, 0).otherwise(1)).alias("neg")
    )
    specs = {
        "tp": Running("sum", F.col("pos"), reverse=True), "fp": Running("sum", F.col("neg"), reverse=True),
    }
    return running(counts, keys, ["score"], specs, chunk_edges(df, score, rows_per_chunk))


def ranking(
    df: DataFrame, truth: str, score: str, keys: Sequence[str] = (), rows_per_chunk: int | None = None
) -> DataFrame:
    """ROC-AUC (ties count half), average precision (step sum) and Brier score."""
    table = score_table(df, truth, score, keys, rows_per_chunk)
    pos, neg, s = F.col("pos"), F.col("neg"), F.col("score")
    above = F.col("tp") - pos
    area = F.sum(neg.cast("double") * above + neg * pos / 2.0)
    p, n = F.sum(pos), F.sum(neg)
    both = (p > 0) & (n > 0)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    brier = F.sum(pos * (1 - s) * (1 - s) + neg * s * s) / (p + n)
    return table.groupBy(*keys).agg(
        F.when(both, area / (p.cast("double") * n)).alias("roc_auc"),
        F.when(p > 0, F.sum(precision * pos) / p).alias("pr_auc"),
        brier.alias("brier"),
    )


def one_vs_rest_auc(df: DataFrame, truth: str, scores: Sequence[str], labels: Sequence) -> DataFrame:
    """Macro mean of the AUC of each class's score against the rest."""
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("cls"), (F.col(truth) == F.lit(label)).cast("int").alias("y"), F.col(s).cast("double").alias("score"))
                    for i, (s, label) in enumerate(zip(scores, labels))
                ]
            )
        ).alias("r")
    ).select("r.*")
    return ranking(long, "y", "score", ["cls"]).agg(F.avg("roc_auc").alias("roc_auc"))


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One ROC and precision-recall point per distinct score, plus the prevalence."""
    table = score_table(df, truth, score)
    totals = table.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = F.lit(totals["p"]), F.lit(totals["n"])
    return table.select(
        F.col("score").alias("threshold"), (F.col("fp") / n).alias("fpr"), (F.col("tp") / p).alias("tpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / p).alias("recall"),
        (p / (p + n)).alias("prevalence"),
    )


def threshold_sweep(df: DataFrame, truth: str, score: str) -> DataFrame:
    """F1, balanced accuracy, MCC, precision and recall at 0.05, 0.06 ... 0.95.

    Rows are first reduced to counts per threshold interval (91 cut points, so 92 groups),
    and the confusion cells of every threshold are running sums over those.
    """
    s = F.col(score).cast("double")
    grid = [round(0.05 + 0.01 * i, 2) for i in range(91)]
    cuts = F.array(*[F.lit(t) for t in grid])
    # Number of thresholds at or below the score: arithmetic guess, then exact compare.
    guess = F.greatest(F.lit(0), F.least(F.lit(91), F.floor((s - 0.05) * 100).cast("int")))
    down = F.when((guess > 0) & (F.get(cuts, guess - 1) > s), guess - 1).otherwise(guess)
    up1 = F.when((down < 91) & (F.get(cuts, down) <= s), down + 1).otherwise(down)
    passed = F.when((up1 < 91) & (F.get(cuts, up1) <= s), up1 + 1).otherwise(up1)
    y = F.col(truth) == 1
    counts = df.groupBy(passed.alias("passed")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    # 92 fixed groups, so ordering them in one window is constant work.
    frame = df.sparkSession.range(92).select(F.col("id").cast("int").alias("passed"))
    filled = frame.join(counts, "passed", "left").fillna(0, ["pos", "neg"])
    after = Window.partitionBy(F.lit(0)).orderBy("passed").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy(F.lit(0)).orderBy("passed").rowsBetween(Window.unboundedPreceding, 0)
    cells = filled.select(
        F.get(cuts, F.col("passed")).alias("threshold"),
        F.sum("pos").over(after).cast("double").alias("tp"), F.sum("neg").over(after).cast("double").alias("fp"),
        F.sum("pos").over(upto).cast("double").alias("fn"), F.sum("neg").over(upto).cast("double").alias("tn"),
    ).filter("threshold is not null")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, other = ratio(tp, tp + fn), ratio(tn, tn + fp)
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return cells.select(
        "threshold", ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + other) / 2).alias("balanced_accuracy"),
        ratio(tp * tn - fp * fn, spread).alias("mcc"), ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
    )


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """First threshold with the highest score, and the gain over 0.5."""
    best = F.min(F.struct((-F.col(metric)).alias("neg"), "threshold"))
    half = F.max(F.when(F.col("threshold") == 0.5, F.col(metric)))
    return sweep.agg(best.alias("b"), half.alias("score_at_half")).select(
        F.col("b.threshold").alias("best_threshold"), (-F.col("b.neg")).alias("best_score"),
        "score_at_half", (-F.col("b.neg") - F.col("score_at_half")).alias("improvement"),
    )


# ---------------------------------------------------------------- run tables and figures' data
def primary_metric(task: str) -> str:
    return "roc_auc" if task == "classification" else "rmse"


def aggregate_runs(runs: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Mean, sd, extremes and values per metric over runs (run count is small)."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return runs.groupBy(*keys).agg(
        F.count(value).alias("n_runs"), F.avg(value).alias("mean"), sd.alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.array_sort(F.collect_list(value)).alias("values"),
    )


def spread_by_model(folds: DataFrame, model: str, value: str) -> DataFrame:
    """Quartiles of a metric across folds, for models with at least two values."""
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return folds.groupBy(model).agg(
        F.count(value).alias("n"), F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi")
    ).filter("n >= 2").select(
        model, "n", "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "hi"
    )


def comparison_table(metrics: DataFrame, task: str, names: Sequence[str]) -> DataFrame:
    """Long (model, metric, value) to one row per model, best primary metric first."""
    wide = metrics.groupBy("model").pivot("metric", list(names)).agg(F.first("value"))
    key = F.col(primary_metric(task))
    return wide.orderBy(key.desc_nulls_last() if task == "classification" else key.asc_nulls_last(), "model")


def residual_summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Fit line of predictions on truth, R², bias and 1.96 sd limits of agreement."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    d = p - y
    return df.agg(
        F.regr_slope(p, y).alias("slope"), F.regr_intercept(p, y).alias("intercept"),
        F.avg(d).alias("bias"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"),
        (1 - F.avg(d * d) / F.var_pop(y)).alias("r2"), F.count(F.lit(1)).alias("n"),
    ).withColumns(
        {"lower": F.col("bias") - 1.96 * F.col("sd"), "upper": F.col("bias") + 1.96 * F.col("sd")}
    )


def safe_bins(n: int, low: float, high: float, cap: int = 50) -> int:
    if n < 2 or high - low < 1e-12:
        return 1
    return min(cap, max(5, min(n // 10, int(n**0.5) + 1)))


def histogram(df: DataFrame, column: str, cap: int = 50) -> DataFrame:
    """Counts per equal-width bin, empty bins included; the last bin is closed."""
    x = v.finite(F.col(column))
    row = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    low, high = row["lo"], row["hi"]
    bins = safe_bins(row["n"], low, high, cap)
    width = (high - low) / bins if bins > 1 else 1.0
    slot = F.least(F.lit(bins - 1), F.floor((x - F.lit(low)) / F.lit(width)).cast("int"))
    counts = df.filter(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("start"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def class_share(df: DataFrame, column: str) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.filter(F.col(column).isNotNull()).count()
    return counts.withColumn("share", F.col("n") / F.lit(max(1, total)))


def check_classes(df: DataFrame, column: str) -> None:
    if df.select(column).distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"'{column}' has too many labels for class metrics")
