"""Queries for metrics, statistics, resampling, subset search, models and blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import draws
from tidemark.functions import text as tx
from tidemark.operators import metrics, modality, models, neighbours, resample, search, splits, stats
from tidemark.plans import experiments
from tidemark.plans.registry import query, table
from tidemark.sources import sinks

SCORED_SQL = """s AS (SELECT l.doc_id, l.quality AS y, d.n_chars / (d.n_chars + 1000.0) AS score,
    CASE WHEN d.n_chars / (d.n_chars + 1000.0) >= 0.5 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d USING (doc_id))"""


def scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    score = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), score.alias("score"), (score >= 0.5).cast("int").alias("p")
    )


def rnd(df, digits=6, skip=()):
    """Round every double column."""
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in skip else F.col(f.name) for f in df.schema]
    )


# ---------------------------------------------------------------- metrics
@query(
    "confusion_metrics",
    f"""WITH {SCORED_SQL}, c AS (SELECT sum(CASE WHEN y = 1 AND p = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p = 1 THEN 1.0 ELSE 0 END) AS fp,
          sum(CASE WHEN y = 1 AND p = 0 THEN 1.0 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND p = 0 THEN 1.0 ELSE 0 END) AS tn FROM s),
        n AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM c)
        SELECT round((tp + tn) / n, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
               round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
               round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
               round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)), 6) AS cohen_kappa,
               tn, fp, fn, tp, round(tn / (tn + fp), 6) AS specificity, round(tn / (tn + fn), 6) AS npv, round(greatest(tp + fn, tn + fp) / n, 6) AS majority_class_accuracy, CAST(n AS BIGINT) AS n_test FROM n""",
)
def confusion_metrics(spark, sf):
    return rnd(metrics.classification(scored(spark, sf), "y", "p"))


@query(
    "multiclass_metrics",
    """WITH o AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS y, CAST(1 + (o_custkey % 5) AS INTEGER) AS p FROM orders),
            k AS (SELECT i AS label, (SELECT count(*) FROM o WHERE y = i)::DOUBLE AS t, (SELECT count(*) FROM o WHERE p = i)::DOUBLE AS c, (SELECT count(*) FROM o WHERE p = i AND y = i)::DOUBLE AS h FROM range(1, 6) r(i))
       SELECT round(sum(h) / sum(t), 6) AS accuracy, round(avg(h / t), 6) AS balanced_accuracy, round(avg(2 * h / (t + c)), 6) AS f1, round(avg(h / c), 6) AS precision, round(avg(h / t), 6) AS recall,
              round((sum(h) * sum(t) - sum(t * c)) / (sqrt(sum(t) * sum(t) - sum(c * c)) * sqrt(sum(t) * sum(t) - sum(t * t))), 6) AS mcc, CAST(sum(t) AS BIGINT) AS n_test FROM k""",
)
def multiclass_metrics(spark, sf):
    df = table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("y"), (1 + F.col("o_custkey") % 5).cast("int").alias("p")
    )
    return rnd(metrics.classification(df, "y", "p")).select("accuracy", "balanced_accuracy", "f1", "precision", "recall", "mcc", "n_test")


REG = "l_extendedprice AS y, l_quantity * 1500 AS p"


@query(
    "regression_metrics",
    f"""WITH r AS (SELECT {REG} FROM lineitem)
        SELECT round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg((p - y) * (p - y)) / 1e6, 4) AS mse_m, round(avg(abs(p - y)), 4) AS mae, round(quantile_cont(abs(p - y), 0.5), 4) AS medae,
               round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) AS r2, round(100 * avg(abs((p - y) / y)), 5) AS mape_percent, round(sqrt(avg((p - y) * (p - y))) / stddev_pop(y), 6) AS nrmse_std,
               round(stddev_pop(y), 4) AS mean_baseline_rmse, round(avg(p - y), 4) AS bias, count(*) AS n_test FROM r""",
)
def regression_metrics(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    m = metrics.regression(df, "y", "p")
    return m.select(
        F.round("rmse", 4).alias("rmse"), F.round(F.col("mse") / 1e6, 4).alias("mse_m"), F.round("mae", 4).alias("mae"),
        F.round("medae", 4).alias("medae"), F.round("r2", 6).alias("r2"), F.round("mape_percent", 5).alias("mape_percent"),
        F.round("nrmse_std", 6).alias("nrmse_std"), F.round("mean_baseline_rmse", 4).alias("mean_baseline_rmse"),
        F.round("bias", 4).alias("bias"), "n_test",
    )


@query(
    "ranking_metrics",
    f"""WITH {SCORED_SQL}, c AS (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE - sum(y) AS neg FROM s GROUP BY 1),
        r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM c)
        SELECT round(sum(neg * (tp - pos) + neg * pos / 2) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(tp / (tp + fp) * pos) / sum(pos), 6) AS pr_auc,
               round((SELECT avg((score - y) * (score - y)) FROM s), 6) AS brier FROM r""",
)
def ranking_metrics(spark, sf):
    return rnd(metrics.ranking(scored(spark, sf), "y", "score"))


@query(
    "auc_one_vs_rest",
    """WITH l AS (SELECT k, CASE WHEN label = k THEN 1 ELSE 0 END AS y, CAST(embedding[k + 1] AS DOUBLE) AS s FROM embeddings, range(10) r(k)),
            q AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM l),
            a AS (SELECT k, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM q GROUP BY k)
       SELECT round(avg(auc), 6) AS roc_auc FROM a""",
)
def auc_one_vs_rest(spark, sf):
    df = table(spark, sf, "embeddings").select("label", *[F.col("embedding")[k].alias(f"s{k}") for k in range(10)])
    return rnd(metrics.one_vs_rest_auc(df, "label", [f"s{k}" for k in range(10)], list(range(10))))


@query(
    "roc_points",
    f"""WITH {SCORED_SQL}, c AS (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE - sum(y) AS neg FROM s GROUP BY 1),
        r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)
        SELECT round(score, 9) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, round(p / (p + n), 6) AS prevalence FROM r""",
)
def roc_points(spark, sf):
    out = metrics.roc_points(scored(spark, sf), "y", "score")
    return rnd(out.withColumn("threshold", F.round("threshold", 9)), 6, skip=("threshold",))


@query(
    "threshold_sweep",
    f"""WITH {SCORED_SQL}, t AS (SELECT CAST(5 + i AS DOUBLE) / 100 AS threshold FROM range(91) r(i)),
        c AS (SELECT threshold, sum(CASE WHEN y = 1 AND score >= threshold THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y = 0 AND score >= threshold THEN 1 ELSE 0 END)::DOUBLE AS fp,
                     sum(CASE WHEN y = 1 AND score < threshold THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN y = 0 AND score < threshold THEN 1 ELSE 0 END)::DOUBLE AS tn FROM s, t GROUP BY 1)
        SELECT threshold, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
               round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) + 0.0 AS mcc,
               round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""",
)
def threshold_sweep(spark, sf):
    out = rnd(metrics.threshold_sweep(scored(spark, sf), "y", "score"), 6, skip=("threshold",))
    return out.withColumn("mcc", F.col("mcc") + 0.0)


@query(
    "best_threshold",
    f"""WITH {SCORED_SQL}, t AS (SELECT CAST(5 + i AS DOUBLE) / 100 AS threshold FROM range(91) r(i)),
        c AS (SELECT threshold, 2.0 * sum(CASE WHEN y = 1 AND score >= threshold THEN 1 ELSE 0 END) / (sum(y) + sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END)) AS f1 FROM s, t GROUP BY 1),
        h AS (SELECT f1 FROM c WHERE threshold = 0.5)
        SELECT threshold AS best_threshold, round(c.f1, 6) AS best_score, round(h.f1, 6) AS score_at_half, round(c.f1 - h.f1, 6) AS improvement FROM c, h ORDER BY c.f1 DESC, threshold LIMIT 1""",
)
def best_threshold(spark, sf):
    sweep = metrics.threshold_sweep(scored(spark, sf), "y", "score")
    return rnd(metrics.best_threshold(sweep), 6, skip=("best_threshold",))


RUNS_SQL = "SELECT l_linenumber, l_returnflag AS metric, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL"


def run_table(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber", F.col("l_returnflag").alias("metric")).agg(
        F.avg("l_extendedprice").alias("value")
    )


@query(
    "aggregate_runs",
    f"""WITH r AS ({RUNS_SQL}) SELECT metric, count(*) AS n_runs, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
        array_to_string(list_sort(list(CAST(round(value, 2) AS DECIMAL(18, 2)))), ',') AS all_values FROM r GROUP BY 1""",
)
def aggregate_runs(spark, sf):
    out = rnd(metrics.aggregate_runs(run_table(spark, sf)), 4)
    shown = F.transform("values", lambda x: F.round(x, 2).cast("decimal(18,2)").cast("string"))
    return out.withColumn("all_values", F.array_join(shown, ",")).drop("values")


@query(
    "fold_spread",
    f"""WITH r AS ({RUNS_SQL}) SELECT metric, count(*) AS n, round(min(value), 4) AS lo, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, round(max(value), 4) AS hi FROM r GROUP BY 1""",
)
def fold_spread(spark, sf):
    return rnd(metrics.spread_by_model(run_table(spark, sf), "metric", "value"), 4)


@query(
    "cv_summary",
    f"""WITH r AS ({RUNS_SQL}), b AS (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max FROM r GROUP BY 1)
        SELECT metric, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(min, 4) AS min, round(max, 4) AS max, round(mean - 2.4469118511449692 * sd / sqrt(n), 3) AS ci_low, round(mean + 2.4469118511449692 * sd / sqrt(n), 3) AS ci_high FROM b""",
)
def cv_summary(spark, sf):
    out = stats.cv_summary(run_table(spark, sf), "metric", "value")
    return rnd(out.withColumns({c: F.round(c, 3) for c in ("ci_low", "ci_high")}), 4)


@query(
    "model_comparison",
    """SELECT model, round(max(value) FILTER (metric = 'rmse'), 4) AS rmse, round(max(value) FILTER (metric = 'mae'), 4) AS mae FROM (
         SELECT l_returnflag AS model, 'rmse' AS metric, stddev_pop(l_extendedprice) AS value FROM lineitem GROUP BY 1 UNION ALL
         SELECT l_returnflag, 'mae', avg(abs(l_extendedprice - 38000)) FROM lineitem GROUP BY 1) GROUP BY 1""",
)
def model_comparison(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.stddev_pop("l_extendedprice").alias("rmse"), F.avg(F.abs(F.col("l_extendedprice") - 38000)).alias("mae")
    )
    long = wide.unpivot(["model"], ["rmse", "mae"], "metric", "value")
    return rnd(metrics.comparison_table(long, "regression", ["rmse", "mae"]), 4)


@query(
    "model_ranking",
    """SELECT model, CAST(row_number() OVER (ORDER BY rmse, model) AS INTEGER) AS place FROM (SELECT o_orderpriority AS model, stddev_pop(o_totalprice) AS rmse FROM orders GROUP BY 1)""",
)
def model_ranking(spark, sf):
    from pyspark.sql import Window

    runs = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.stddev_pop("o_totalprice").alias("value"))
    ranked = metrics.comparison_table(runs.withColumn("metric", F.lit("rmse")), "regression", ["rmse"])
    return ranked.select("model", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rmse", "model")).alias("place"))


@query(
    "bland_altman",
    f"""WITH r AS (SELECT {REG} FROM lineitem), a AS (SELECT regr_slope(p, y) AS slope, regr_intercept(p, y) AS intercept, avg(p - y) AS bias, stddev_samp(p - y) AS sd, 1 - avg((p - y) * (p - y)) / var_pop(y) AS r2, count(*) AS n FROM r)
        SELECT round(slope, 5) AS slope, round(intercept, 3) AS intercept, round(bias, 3) AS bias, round(sd, 3) AS sd, round(r2, 5) AS r2, n, round(bias - 1.96 * sd, 3) AS lower, round(bias + 1.96 * sd, 3) AS upper FROM a""",
)
def bland_altman(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    out = metrics.residual_summary(df, "y", "p")
    return out.select(
        F.round("slope", 5).alias("slope"), F.round("r2", 5).alias("r2"), "n",
        *[F.round(c, 3).alias(c) for c in ("intercept", "bias", "sd", "lower", "upper")],
    )


@query(
    "histogram",
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(50, greatest(5, least(count(*) // 10, CAST(floor(sqrt(count(*))) AS BIGINT) + 1))) AS k FROM orders),
            h AS (SELECT least(k - 1, CAST(floor((o_totalprice - lo) / ((hi - lo) / k)) AS BIGINT)) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
       SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / k, 4) AS start, coalesce(n, 0) AS n FROM b, range(50) r(i) LEFT JOIN h ON h.bin = i WHERE i < k""",
)
def histogram(spark, sf):
    return rnd(metrics.histogram(table(spark, sf, "orders"), "o_totalprice"), 4)


@query(
    "class_share",
    """SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1""",
)
def class_share(spark, sf):
    return rnd(metrics.class_share(table(spark, sf, "orders"), "o_orderpriority"))


@query(
    "confusion_matrix",
    f"""WITH {SCORED_SQL}, c AS (SELECT y, p, count(*) AS n FROM s GROUP BY ALL) SELECT y, p, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM c""",
)
def confusion_matrix(spark, sf):
    return rnd(metrics.confusion_matrix(scored(spark, sf), "y", "p"))


@query(
    "prediction_export",
    f"""WITH {SCORED_SQL} SELECT y AS y_true, p AS y_pred, round(score, 9) AS y_proba, doc_id FROM s""",
)
def prediction_export(spark, sf):
    out = sinks.prediction_table(scored(spark, sf), "y", "p", "score", extra=["doc_id"])
    read = spark.read.parquet(sinks.write_table(out, "predictions"))
    return read.withColumn("y_proba", F.round("y_proba", 9))


# ---------------------------------------------------------------- statistics
DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(quantile_cont({c}, 0.5), 4) AS median,
            round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
            round(avg(power({c} - (SELECT avg({c}) FROM lineitem), 3)) / power(stddev_pop({c}), 3), 3) + 0.0 AS skewness, round(kurtosis_pop({c}), 3) + 0.0 AS kurtosis FROM lineitem"""
        for c in DESCRIBED
    ),
)
def describe(spark, sf):
    out = stats.describe(table(spark, sf, "lineitem"), DESCRIBED)
    return rnd(out.withColumns({c: F.round(c, 3) + 0.0 for c in ("skewness", "kurtosis")}), 4)


@query(
    "describe_categorical",
    " UNION ALL ".join(
        f"""(SELECT '{c}' AS variable, (SELECT count({c}) FROM lineitem) AS n, (SELECT count(*) - count({c}) FROM lineitem) AS missing, (SELECT count(DISTINCT {c}) FROM lineitem) AS levels,
             {c} AS mode, round(100 * count(*) / (SELECT count({c}) FROM lineitem), 4) AS mode_pct FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in ("l_returnflag", "l_linestatus")
    ),
)
def describe_categorical(spark, sf):
    return rnd(stats.describe_categorical(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]), 4)


WELCH_SQL = """m AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS s2 FROM lineitem GROUP BY 1),
  t AS (SELECT (arg_min(m, g) - arg_max(m, g)) / sqrt(sum(s2 / n)) AS t, (arg_min(m, g) - arg_max(m, g)) / sqrt(sum((n - 1) * s2) / (sum(n) - 2)) AS d FROM m),
  r AS (SELECT l_linestatus AS g, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r FROM lineitem),
  u AS (SELECT sum(r) - count(*) * (count(*) + 1) / 2.0 AS u FROM r WHERE g = (SELECT min(g) FROM m))"""


@query(
    "group_compare",
    f"""WITH {WELCH_SQL} SELECT 'l_extendedprice' AS variable, CAST(2 AS BIGINT) AS groups, 'Welch t-test' AS test, round(t, 4) AS statistic, round(d, 5) AS effect_value FROM t""",
)
def group_compare(spark, sf):
    out = stats.compare_groups(table(spark, sf, "lineitem"), "l_linestatus", ["l_extendedprice"], test="parametric")
    return out.select("variable", "groups", "test", F.round("statistic", 4).alias("statistic"), F.round("effect_value", 5).alias("effect_value"))


@query("mann_whitney", f"""WITH {WELCH_SQL} SELECT round(u, 1) AS u FROM u""")
def mann_whitney(spark, sf):
    sums = sorted(stats.rank_sums(table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice").collect(), key=lambda r: r["grp"])
    return spark.createDataFrame([(round(float(stats.mann_whitney(sums)[0]), 1),)], "u double")


@query(
    "anova",
    """WITH m AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS s2 FROM orders GROUP BY 1),
            t AS (SELECT avg(o_totalprice) AS mu FROM orders),
            s AS (SELECT sum(n * (m - mu) * (m - mu)) AS b, sum((n - 1) * s2) AS w, count(*) AS k, sum(n) AS n FROM m, t)
       SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS f, round(b / (b + w), 8) AS eta_squared FROM s""",
)
def anova(spark, sf):
    f, _, eta = stats.anova(list(stats.group_moments(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").values()))
    return spark.createDataFrame([(round(f, 6), round(eta, 8))], "f double, eta_squared double")


@query(
    "chi_square_2x2",
    """WITH c AS (SELECT sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS b,
              sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS c, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS d FROM labels)
       SELECT 'toxic' AS variable, round((a + b + c + d) * power(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2), 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) AS statistic,
              round(sqrt(power(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d))), 6) AS effect_value FROM c""",
)
def chi_square_2x2(spark, sf):
    df = table(spark, sf, "labels").withColumn("toxic", F.col("toxic").cast("string"))
    out = stats.compare_groups(df, "quality", ["toxic"])
    return out.select("variable", F.round("statistic", 6).alias("statistic"), F.round("effect_value", 6).alias("effect_value"))


@query(
    "group_compare_many",
    """WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS x, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY o_totalprice) AS t FROM orders),
            s AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS rs, avg(x) AS m, sum(t * t - 1)::DOUBLE AS ties, sum(x) AS sx FROM r GROUP BY 1),
            k AS (SELECT sum(n) AS n, 12 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1) AS h, 1 - sum(ties) / (sum(n) * sum(n) * sum(n) - sum(n)) AS c FROM s),
            e AS (SELECT (SELECT sum(n * (m - (SELECT avg(o_totalprice) FROM orders)) * (m - (SELECT avg(o_totalprice) FROM orders))) FROM s) / (SELECT var_pop(o_totalprice) * count(*) FROM orders) AS eta)
       SELECT 'o_totalprice' AS variable, 'Kruskal-Wallis' AS test, round(h / c, 3) AS statistic, round(eta, 8) AS effect_value FROM k, e""",
)
def group_compare_many(spark, sf):
    out = stats.compare_groups(table(spark, sf, "orders"), "o_orderpriority", ["o_totalprice"], test="rank")
    return out.select("variable", "test", F.round("statistic", 3).alias("statistic"), F.round("effect_value", 8).alias("effect_value"))


@query(
    "chi_square",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
            e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e, sum(n) OVER () AS t FROM c)
       SELECT 'l_returnflag' AS variable, 'Chi-square' AS test, round(sum(n * n / e) - max(t), 3) AS statistic, CAST(2 AS DOUBLE) AS df, round(sqrt((sum(n * n / e) - max(t)) / max(t)), 6) AS effect_value FROM e""",
)
def chi_square(spark, sf):
    out = stats.compare_groups(table(spark, sf, "lineitem"), "l_linestatus", ["l_returnflag"])
    return out.select("variable", "test", F.round("statistic", 3).alias("statistic"), "df", F.round("effect_value", 6).alias("effect_value"))


def spearman_sql(pairs, source):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS r FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
            rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {source})"""
        for a, b in pairs
    )


@query(
    "spearman_target",
    f"""SELECT a AS variable, r FROM ({spearman_sql([(c, 'l_extendedprice') for c in ('l_quantity', 'l_discount', 'l_tax')], 'lineitem')})""",
)
def spearman_target(spark, sf):
    out = stats.correlate_with(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return out.select("variable", F.round("r", 6).alias("r"))


@query(
    "pearson_interval",
    """SELECT 'l_quantity' AS variable, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r,
          round(tanh(atanh(corr(l_quantity, l_extendedprice)) - 1.96 / sqrt(count(*) - 3)), 6) AS ci_low, round(tanh(atanh(corr(l_quantity, l_extendedprice)) + 1.96 / sqrt(count(*) - 3)), 6) AS ci_high FROM lineitem""",
)
def pearson_interval(spark, sf):
    out = stats.correlate_with(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], "pearson")
    return rnd(out.select("variable", "n", "r", "ci_low", "ci_high"))


@query(
    "correlation_matrix",
    spearman_sql([("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")], "lineitem")
    + "".join(f" UNION ALL SELECT '{c}', '{c}', 1.0 FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0" for c in DESCRIBED),
)
def correlation_matrix(spark, sf):
    return rnd(stats.correlation_matrix(table(spark, sf, "lineitem"), DESCRIBED))


@query(
    "paired_tests",
    """WITH d AS (SELECT l_tax * 100 - l_discount * 100 AS d FROM lineitem), z AS (SELECT round(d, 6) AS d FROM d),
            r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM z WHERE d <> 0),
            w AS (SELECT least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS s FROM r),
            t AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd, quantile_cont(d, 0.5) AS med FROM z)
       SELECT 'wilcoxon_signed_rank' AS test, round(s, 1) AS statistic, n AS n_pairs, round(m, 6) AS mean_difference FROM w, t
       UNION ALL SELECT 'paired_t', round(m / (sd / sqrt(n)), 4), n, round(m, 6) FROM t""",
)
def paired_tests(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.round(F.col("l_tax") * 100 - F.col("l_discount") * 100, 6).alias("a"), F.lit(0.0).alias("b")
    )
    out = stats.paired_tests(df, "a", "b")
    digits = F.when(F.col("test") == "paired_t", F.round("statistic", 4)).otherwise(F.round("statistic", 1))
    return out.select("test", digits.alias("statistic"), "n_pairs", F.round("mean_difference", 6).alias("mean_difference"))


@query(
    "holm_correction",
    """WITH p AS (SELECT p_brand, 0.5 * count(*) / (SELECT count(*) FROM part) AS p FROM part GROUP BY 1),
            r AS (SELECT p_brand, p, (count(*) OVER () - row_number() OVER (ORDER BY p, p_brand) + 1) * p AS s, row_number() OVER (ORDER BY p, p_brand) AS k FROM p)
       SELECT p_brand, round(p, 9) AS p_raw, round(least(1.0, max(s) OVER (ORDER BY k)), 9) AS p_adjusted, least(1.0, max(s) OVER (ORDER BY k)) < 0.05 AS significant FROM r""",
)
def holm_correction(spark, sf):
    part = table(spark, sf, "part")
    rows = part.count()
    p = part.groupBy("p_brand").agg((0.5 * F.count(F.lit(1)) / F.lit(rows)).alias("p"))
    return rnd(stats.holm(p, "p_brand", "p"), 9)


@query(
    "p_format",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE power(p_size / 50.0, 3) END AS p FROM part)
       SELECT p_partkey, CASE WHEN p IS NULL THEN '-' WHEN p < 0.001 THEN '<0.001' ELSE format('{:.3f}', p) END AS shown,
              CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM p""",
)
def p_format(spark, sf):
    p = F.when(F.col("p_size") % 5 != 0, F.pow(F.col("p_size") / 50.0, F.lit(3.0)))
    df = table(spark, sf, "part").select("p_partkey", p.alias("p"))
    return df.select("p_partkey", stats.p_text(F.col("p")).alias("shown"), stats.p_stars(F.col("p")).alias("stars"))


@query(
    "normality",
    """WITH m AS (SELECT CAST(c_nationkey AS VARCHAR) AS variable, c_acctbal AS x, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS mu FROM customer),
            s AS (SELECT variable, count(*) AS n, avg((x - mu) ** 2) AS m2, avg((x - mu) ** 3) AS m3, avg((x - mu) ** 4) AS m4 FROM m GROUP BY 1),
            j AS (SELECT variable, n / 6 * (m3 * m3 / m2 ** 3 + (m4 / (m2 * m2) - 3) ** 2 / 4) AS jb FROM s WHERE n >= 3 AND m2 > 1e-24)
       SELECT variable, round(jb, 8) AS jb, round(exp(-jb / 2), 8) AS normal_p FROM j""",
)
def normality(spark, sf):
    """Customer balances by nation."""
    df = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("variable"), F.col("c_acctbal").alias("value"))
    out = stats.moment_normality(df, ["variable"], "value")
    return out.select("variable", F.round("jb", 8).alias("jb"), F.round("normal_p", 8).alias("normal_p"))


# ---------------------------------------------------------------- resampling
def poisson_sql(source: str, row_id: str, reps: int = 1000, seed: int = 42) -> str:
    """Rows of ``source`` by replicate with the same weight ``w`` as the operator draws."""
    first, second = draws.halves_sql(row_id)
    keys = ", ".join(map(str, draws.keys(seed, reps)))
    return f"""h AS (SELECT *, {first} AS h1, {second} AS h2 FROM {source}), i AS (SELECT rep, key FROM (SELECT unnest(range({reps})) AS rep, unnest([{keys}]) AS key)),
        w AS (SELECT h.*, rep, {draws.poisson_sql('h1', 'h2', 'key')} AS w FROM h, i)"""


@query(
    "bootstrap_regression",
    f"""WITH b AS (SELECT o_orderkey, o_totalprice AS y, 200000.0 AS p FROM orders), {poisson_sql('b', 'o_orderkey')}
        SELECT CAST(rep AS INTEGER) AS rep, round(sqrt(sum(w * (p - y) * (p - y)) / sum(w)), 3) AS value FROM w GROUP BY 1""",
)
def bootstrap_regression(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.lit(200000.0).alias("p"))
    return resample.bootstrap_regression(df, "o_orderkey", "y", "p", "rmse").withColumn("value", F.round("value", 3))


@query(
    "bootstrap_interval",
    f"""WITH b AS (SELECT o_orderkey, o_totalprice AS y, 200000.0 AS p FROM orders), {poisson_sql('b', 'o_orderkey')},
        v AS (SELECT rep, sum(w * abs(p - y)) / sum(w) AS value FROM w GROUP BY 1)
        SELECT round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, round(quantile_cont(value, 0.025), 3) AS ci_lower, round(quantile_cont(value, 0.975), 3) AS ci_upper, count(*) AS n_valid FROM v""",
)
def bootstrap_interval(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.lit(200000.0).alias("p"))
    return rnd(resample.interval(resample.bootstrap_regression(df, "o_orderkey", "y", "p", "mae"), "value"), 3)


@query(
    "bootstrap_fit",
    f"""WITH b AS (SELECT p_partkey, p_retailprice AS y, 900 + (p_partkey % 200) * 0.1 AS p FROM part), {poisson_sql('b', 'p_partkey')}
        SELECT CAST(rep AS INTEGER) AS rep, round(sum(w * abs((p - y) / y)) / sum(w), 6) AS mape, round(1 - sum(w * (p - y) * (p - y)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)), 4) AS r2 FROM w GROUP BY 1""",
)
def bootstrap_fit(spark, sf):
    """Relative error and share of variance explained, replicate by replicate."""
    df = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("y"), (900 + (F.col("p_partkey") % 200) * 0.1).alias("p"))
    mape, r2 = (resample.bootstrap_regression(df, "p_partkey", "y", "p", m).withColumnRenamed("value", m) for m in ("mape", "r2"))
    return mape.join(r2, "rep").select("rep", F.round("mape", 6).alias("mape"), F.round("r2", 4).alias("r2"))


@query(
    "bootstrap_auc",
    f"""WITH {SCORED_SQL}, {poisson_sql('s', 'doc_id')}, c AS (SELECT rep, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END)::DOUBLE AS neg FROM w WHERE w > 0 GROUP BY ALL),
        r AS (SELECT *, sum(neg) OVER (PARTITION BY rep ORDER BY score) AS below FROM c)
        SELECT CAST(rep AS INTEGER) AS rep, round(sum(pos * (below - neg) + pos * neg / 2) / (sum(pos) * sum(neg)), 6) AS value FROM r GROUP BY rep""",
)
def bootstrap_auc(spark, sf):
    return resample.bootstrap_auc(scored(spark, sf), "doc_id", "y", "score", single_class=True).withColumn("value", F.round("value", 6))


@query("bootstrap_classification")
def bootstrap_classification(spark, sf):
    values = resample.bootstrap_classification(scored(spark, sf), "y", "p", "balanced_accuracy", 1000)
    return resample.interval(values, "value")


@query(
    "permuted_column",
    """WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY substr(md5('0|' || o_orderkey), 1, 15)) AS k, row_number() OVER (ORDER BY substr(md5('7|' || o_orderkey), 1, 15)) AS j FROM orders)
       SELECT a.o_orderkey, b.o_totalprice FROM a JOIN a b ON a.k = b.j""",
)
def permuted_column(spark, sf):
    return resample.permuted(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 7)


def moved_sql(source: str, shuffles: int, seed: int = 42) -> str:
    """Where every row of ``source`` (``k`` from 0) goes in every shuffle, turned until it is inside."""
    keys = draws.keys(seed, 4 * shuffles)
    rows = ", ".join(f"({j}, {', '.join(map(str, keys[4 * j : 4 * j + 4]))})" for j in range(shuffles))
    key = ["k0", "k1", "k2", "k3"]
    return f"""turns AS (SELECT * FROM (VALUES {rows}) t(shuffle, k0, k1, k2, k3)), size AS (SELECT count(*) AS n FROM {source}),
        walk AS (SELECT k, shuffle, k0, k1, k2, k3, n, {draws.turned_sql('k', 'n', key)} AS at_ FROM {source}, turns, size
                 UNION ALL SELECT k, shuffle, k0, k1, k2, k3, n, {draws.turned_sql('at_', 'n', key)} FROM walk WHERE at_ >= n),
        gone AS (SELECT shuffle, k, at_ FROM walk WHERE at_ < n)"""


def _rmse(df, by):
    e = F.col("prediction") - F.col("y")
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("value"))


@query(
    "permutation_importance",
    f"""WITH RECURSIVE d AS (SELECT p_partkey AS id, p_retailprice AS y, p_partkey % 200 AS a, p_size AS b, row_number() OVER (ORDER BY substr(md5('0|' || p_partkey), 1, 15)) - 1 AS k FROM part),
            g AS (SELECT sqrt(avg((900 + a * 0.1 + b * 0.5 - y) * (900 + a * 0.1 + b * 0.5 - y))) AS base FROM d), {moved_sql('d', 30)},
            x AS (SELECT shuffle, CASE WHEN shuffle < 15 THEN o.a ELSE r.a END AS a, CASE WHEN shuffle < 15 THEN r.b ELSE o.b END AS b, r.y FROM gone JOIN d o ON o.k = gone.k JOIN d r ON r.k = gone.at_),
            s AS (SELECT shuffle, sqrt(avg((900 + a * 0.1 + b * 0.5 - y) * (900 + a * 0.1 + b * 0.5 - y))) - (SELECT base FROM g) AS drop FROM x GROUP BY 1)
       SELECT CASE WHEN shuffle < 15 THEN 'a' ELSE 'b' END AS feature, round(avg(drop), 5) + 0.0 AS importance_mean, round(stddev_samp(drop), 5) + 0.0 AS importance_std, CAST(count(*) AS INTEGER) AS repeats FROM s GROUP BY 1""",
)
def permutation_importance(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 200).alias("a"), F.col("p_size").alias("b")
    )
    out = resample.permutation_importance(
        df, "id", ["a", "b"], lambda d: d.withColumn("prediction", 900 + F.col("a") * 0.1 + F.col("b") * 0.5), _rmse, higher_is_better=False
    )
    return out.select("feature", *[(F.round(c, 5) + 0.0).alias(c) for c in ("importance_mean", "importance_std")], "repeats")


@query(
    "permutation_test",
    f"""WITH RECURSIVE d AS (SELECT p_partkey AS id, p_retailprice AS y, p_partkey % 1000 AS a, row_number() OVER (ORDER BY substr(md5('0|' || p_partkey), 1, 15)) - 1 AS k FROM part),
            {moved_sql('d', 20)},
            c AS (SELECT shuffle, abs(corr(r.a, o.y)) AS c FROM gone JOIN d o ON o.k = gone.k JOIN d r ON r.k = gone.at_ GROUP BY 1),
            o AS (SELECT abs(corr(a, y)) AS observed FROM d)
       SELECT round(max(observed), 6) AS observed, round(avg(c), 6) AS permuted_mean, round(stddev_samp(c), 6) AS permuted_std, round(min(c), 6) AS permuted_min, round(max(c), 6) AS permuted_max,
              round((sum(CASE WHEN c >= observed THEN 1 ELSE 0 END) + 1) / 21.0, 6) AS p_value, CAST(count(*) AS INTEGER) AS permutations FROM c, o""",
)
def permutation_test(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 1000).alias("a"))
    return rnd(resample.permutation_test(df, "id", "y", lambda d, by: d.groupBy(*by).agg(F.abs(F.corr("a", "y")).alias("value"))))


MASKS_SQL = """m AS (SELECT label AS mask, i AS feature, avg(CAST(embedding[i + 1] AS DOUBLE)) > 0 AS selected FROM embeddings, range(64) r(i) GROUP BY ALL)"""


def masks(spark, sf):
    return table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("feature", "x")).groupBy(
        F.col("label").alias("mask"), "feature"
    ).agg((F.avg(F.col("x").cast("double")) > 0).alias("selected"))


@query(
    "selection_stability",
    f"""WITH {MASKS_SQL} SELECT CAST(feature AS INTEGER) AS feature, round(avg(CASE WHEN selected THEN 1.0 ELSE 0.0 END), 6) AS frequency, bool_and(selected) AS always, NOT bool_or(selected) AS never FROM m GROUP BY 1""",
)
def selection_stability(spark, sf):
    return rnd(resample.selection_stability(masks(spark, sf)))


@query(
    "selection_jaccard",
    f"""WITH {MASKS_SQL}, z AS (SELECT mask, sum(CASE WHEN selected THEN 1.0 ELSE 0 END) AS size FROM m GROUP BY 1),
        j AS (SELECT a.mask AS a, b.mask AS b, sum(CASE WHEN a.selected AND b.selected THEN 1.0 ELSE 0 END) / sum(CASE WHEN a.selected OR b.selected THEN 1.0 ELSE 0 END) AS j FROM m a JOIN m b ON a.feature = b.feature AND a.mask < b.mask GROUP BY ALL)
        SELECT (SELECT count(*) FROM z) AS n_masks, round((SELECT avg(size) FROM z), 6) AS mean_selected, round(avg(j), 6) AS mean_jaccard, round(stddev_samp(j), 6) AS std_jaccard FROM j""",
)
def selection_jaccard(spark, sf):
    return rnd(resample.jaccard_summary(masks(spark, sf)))


# ---------------------------------------------------------------- subset search
def wide_embeddings(spark, sf, width: int = 64):
    """The first ``width`` embedding components (all, if not said) as columns, with two targets."""
    columns = [f"x{i}" for i in range(width)]
    df = table(spark, sf, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)],
        F.transform("embedding", lambda e: e.cast("double")).alias("all"),
    )
    target = 2 * F.col("x0") - F.col("x3") + 0.5 * F.col("x7") + 0.3 * F.col("all")[40]
    return df.withColumns({"y": target, "cls": (F.col("label") % 2).cast("int")}).drop("all"), columns


@query(
    "fold_moments",
    """WITH f AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[4] AS DOUBLE) AS b, CAST(vec_id % 3 AS INTEGER) AS fold FROM embeddings)
       SELECT fold, count(*)::DOUBLE AS n, round(sum(a), 6) + 0.0 AS sa, round(sum(a * a), 6) AS saa, round(sum(a * b), 6) AS sab FROM f GROUP BY 1""",
)
def fold_moments(spark, sf):
    df, _ = wide_embeddings(spark, sf)
    m = search.fold_moments(df.withColumn("fold", (F.col("vec_id") % 3).cast("int")), ["x0", "x3"])
    rows = [(f, float(x[0, 0]), round(float(x[0, 1]), 6) + 0.0, round(float(x[1, 1]), 6), round(float(x[1, 2]), 6)) for f, x in m.items()]
    return spark.createDataFrame(rows, "fold int, n double, sa double, saa double, sab double")


#: 30 masks, 40 generations; folds are five by default.
STANDARD = search.SearchSettings()


@query("mask_search_regression")
def mask_search_regression(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    folded = splits.random_folds(df, "vec_id").cache()
    result = search.search(columns, search.linear_regression_scorer(folded, columns, "y"), STANDARD)
    return sinks.selected_features(spark, columns, result.mask).withColumns(
        {"fitness": F.lit(result.fitness), "score": F.lit(result.score)}
    )


@query("mask_search_classes")
def mask_search_classes(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    folded = splits.stratified_folds(df, "vec_id", "cls").cache()
    result = search.search(columns, search.linear_class_scorer(folded, columns, "cls", 2), STANDARD)
    return search.history_table(spark, result)


@query("mask_search_neighbours")
def mask_search_neighbours(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    folded = splits.random_folds(df, "vec_id").cache()
    result = search.search(columns, search.neighbour_scorer(folded, columns, "y"), STANDARD)
    return search.history_table(spark, result)


#: Columns of the masks whose fitness is also worked out in SQL.
FIXED_MASKS = ((0, 3, 7), (40,), tuple(range(64)))


@query(
    "neighbour_fitness",
    f"""WITH e AS (SELECT vec_id, vec_id % 5 AS fold, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
            d AS (SELECT vec_id, fold, x, 2 * x[1] - x[4] + 0.5 * x[8] + 0.3 * x[41] AS y FROM e),
            m AS (SELECT * FROM (VALUES {", ".join(f"({i}, {[c + 1 for c in m]})" for i, m in enumerate(FIXED_MASKS))}) t(mask, cols)),
            p AS (SELECT mask, q.vec_id, q.fold, q.y, t.y AS v, sqrt(list_sum(list_transform(cols, lambda i: (q.x[i] - t.x[i]) * (q.x[i] - t.x[i])))) AS d FROM d q JOIN d t ON q.fold <> t.fold, m),
            k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY mask, vec_id ORDER BY d, v) <= 5),
            w AS (SELECT *, CASE WHEN min(d) OVER (PARTITION BY mask, vec_id) <= 1e-7 THEN CASE WHEN d <= 1e-7 THEN 1.0 ELSE 0 END ELSE 1 / d END AS w FROM k),
            g AS (SELECT mask, fold, vec_id, any_value(y) AS y, sum(w * v) / sum(w) AS g FROM w GROUP BY 1, 2, 3),
            r AS (SELECT mask, fold, sqrt(avg((g - y) * (g - y))) AS r FROM g GROUP BY 1, 2)
       SELECT CAST(mask AS INTEGER) AS mask, round(avg(r), 6) AS rmse, round(greatest(0, least(1, 1 - avg(r) / (SELECT stddev_pop(y) FROM d))), 6) AS fitness FROM r GROUP BY 1""",
)
def neighbour_fitness(spark, sf):
    """Error and fitness of three fixed masks, from the same join as the search."""
    df, columns = wide_embeddings(spark, sf)
    folded = df.withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    masks = [np.isin(np.arange(len(columns)), m) for m in FIXED_MASKS]
    found = neighbours.predicted(neighbours.Join(folded, columns, "y").nearest(masks))
    error = F.col("p") - F.col("y")
    by_fold = found.groupBy("mask", "fold").agg(F.sqrt(F.sum(F.col("copies") * error * error) / F.sum("copies")).alias("rmse"))
    sd = folded.agg(F.stddev_pop("y")).first()[0]
    fitness = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("rmse") / sd))
    return rnd(by_fold.groupBy("mask").agg(F.avg("rmse").alias("rmse")).select("mask", "rmse", fitness.alias("fitness")))


@query(
    "mask_fitness",
    """WITH d AS (SELECT vec_id % 5 AS fold, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[4] AS DOUBLE) AS b, 2 * CAST(embedding[1] AS DOUBLE) - CAST(embedding[4] AS DOUBLE) + 0.5 * CAST(embedding[8] AS DOUBLE) + 0.3 * CAST(embedding[41] AS DOUBLE) AS y FROM embeddings),
            f AS (SELECT DISTINCT fold FROM d), t AS (SELECT f.fold AS held, d.* FROM d JOIN f ON d.fold <> f.fold),
            s AS (SELECT held, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM t GROUP BY 1),
            w AS (SELECT held, 'x0' AS mask, ay / aa AS wa, 0.0 AS wb, ma, mb, my FROM s UNION ALL SELECT held, 'x3', 0.0, byy / bb, ma, mb, my FROM s
                  UNION ALL SELECT held, 'x0 x3', (ay * bb - byy * ab) / (aa * bb - ab * ab), (byy * aa - ay * ab) / (aa * bb - ab * ab), ma, mb, my FROM s),
            r AS (SELECT mask, held, sqrt(avg((my + wa * (a - ma) + wb * (b - mb) - y) * (my + wa * (a - ma) + wb * (b - mb) - y))) AS r FROM w JOIN d ON d.fold = held GROUP BY 1, 2)
       SELECT mask, round(greatest(0, least(1, 1 - avg(r) / (SELECT stddev_pop(y) FROM d))), 6) AS fitness FROM r GROUP BY 1""",
)
def mask_fitness(spark, sf):
    """Linear fitness of three masks from fold moments, against refitted lines and planes."""
    df, columns = wide_embeddings(spark, sf)
    folded = df.withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    masks = [np.isin(np.arange(len(columns)), m) for m in ((0,), (3,), (0, 3))]
    scores = search.linear_regression_scorer(folded, columns, "y")(masks)
    return spark.createDataFrame([(name, round(x, 6)) for name, x in zip(("x0", "x3", "x0 x3"), scores)], "mask string, fitness double")


@query("mask_search_forest")
def mask_search_forest(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    folded = splits.random_folds(df, "vec_id", 2).cache()
    scorer = search.forest_scorer(folded, columns, "y", trees=5)
    quick = search.SearchSettings(population=4, generations=1)
    return search.history_table(spark, search.search(columns, scorer, quick))


@query("search_ablation")
def search_ablation(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    folded = splits.random_folds(df, "vec_id").cache()
    scorer = search.linear_regression_scorer(folded, columns, "y")
    runs = search.ablation_runs(spark, columns, scorer, STANDARD)
    return search.ablation_table(runs)


# ---------------------------------------------------------------- models
@query(
    "ridge_normal_equations",
    """WITH d AS (SELECT l_quantity AS a, l_tax * 100 AS b, l_extendedprice AS y FROM lineitem),
            s AS (SELECT var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM d),
            w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM s)
       SELECT 'intercept' AS term, round(my - wa * ma - wb * mb, 3) AS weight FROM w UNION ALL SELECT 'l_quantity', round(wa, 4) FROM w UNION ALL SELECT 'tax', round(wb, 4) FROM w""",
)
def ridge_normal_equations(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 100).alias("tax"), F.col("l_extendedprice").alias("y"))
    b, w = models.ridge_weights(df, ["l_quantity", "tax"], "y", 1.0)
    rows = [("intercept", round(b, 3)), ("l_quantity", round(float(w[0]), 4)), ("tax", round(float(w[1]), 4))]
    return spark.createDataFrame(rows, "term string, weight double")


@query(
    "trivial_predictors",
    """WITH s AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY substr(md5('42|' || o_orderkey), 1, 15)) <= ceil(0.2 * count(*) OVER ()) AS test FROM orders)
       SELECT 'dummy_mean' AS model, round(sqrt(avg((o_totalprice - m) * (o_totalprice - m))), 3) AS rmse, count(*) AS n_test FROM s, (SELECT avg(o_totalprice) AS m FROM s WHERE NOT test) WHERE test""",
)
def trivial_predictors(spark, sf):
    parted = splits.random_split(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    m, test = models.split_input(parted, ["o_orderkey"], "o_totalprice", 0)
    out = metrics.regression(models.mean(m)(test), "o_totalprice", "prediction", medae=False)
    return out.select(F.lit("dummy_mean").alias("model"), F.round("rmse", 3).alias("rmse"), "n_test")


def regression_input(spark, sf, **options):
    df, columns = wide_embeddings(spark, sf)
    parted = splits.random_split(df, "vec_id").cache()
    return models.split_input(parted, columns, "y", 0, **options)


def class_input(spark, sf, **options):
    df, columns = wide_embeddings(spark, sf)
    parted = splits.stratified_split(df, "vec_id", "cls").cache()
    return models.split_input(parted, columns, "cls", 2, **options)


@query("baselines_regression")
def baselines_regression(spark, sf):
    m, test = regression_input(spark, sf)
    return models.run_baselines(m, test)


@query("baselines_classification")
def baselines_classification(spark, sf):
    m, test = class_input(spark, sf)
    return models.run_baselines(m, test)


@query("random_search")
def random_search(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    # Held before rows are filtered: from a filter by a hash of all columns the optimizer derives one by every subset of their names.
    parted = splits.random_split(df, "vec_id").cache()
    folded = splits.random_folds(parted.filter("split = 'train'"), "vec_id").cache()
    m = models.ModelInput(folded, tuple(columns), "y", 0)
    _, _, tried = models.tune(m, "ridge")
    return tried


@query(
    "ridge_tuning",
    """WITH d AS (SELECT vec_id % 5 AS fold, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[4] AS DOUBLE) AS b, 2 * CAST(embedding[1] AS DOUBLE) - CAST(embedding[4] AS DOUBLE) + 0.5 * CAST(embedding[8] AS DOUBLE) + 0.3 * CAST(embedding[41] AS DOUBLE) AS y FROM embeddings),
            f AS (SELECT DISTINCT fold FROM d), t AS (SELECT f.fold AS held, d.* FROM d JOIN f ON d.fold <> f.fold), p AS (SELECT unnest([0.1, 10.0, 100.0]) AS alpha),
            s AS (SELECT held, alpha, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + alpha AS aa, var_pop(b) * count(*) + alpha AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS byy FROM t, p GROUP BY 1, 2),
            w AS (SELECT held, alpha, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM s),
            r AS (SELECT alpha, held, sqrt(avg((my + wa * (a - ma) + wb * (b - mb) - y) * (my + wa * (a - ma) + wb * (b - mb) - y))) AS r FROM w JOIN d ON d.fold = held GROUP BY 1, 2)
       SELECT '{''alpha'': ' || CAST(alpha AS DOUBLE) || '}' AS settings, round(-avg(r), 7) AS cv_score FROM r GROUP BY alpha""",
)
def ridge_tuning(spark, sf):
    """Three penalties on two columns, scored from fold moments."""
    df, _ = wide_embeddings(spark, sf)
    m = models.ModelInput(df.withColumn("fold", (F.col("vec_id") % 5).cast("int")), ("x0", "x3"), "y", 0)
    _, _, tried = models.tune(m, "ridge", space={"alpha": [0.1, 10.0, 100.0]})
    return tried.select("settings", F.round("cv_score", 7).alias("cv_score"))


@query("random_search_forest")
def random_search_forest(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    folded = splits.stratified_folds(df, "vec_id", "cls", 2).cache()
    m = models.ModelInput(folded, tuple(columns), "cls", 2)
    space = {"numTrees": [5, 10], "maxDepth": [3, 5]}
    _, _, tried = models.tune(m, "random_forest", count=2, space=space)
    return tried


@query("calibration")
def calibration(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    parted = splits.stratified_folds(splits.stratified_split(df, "vec_id", "cls"), "vec_id", "cls", 3).cache()
    m, test = models.split_input(parted, columns, "cls", 2)
    out = None
    for method in ("isotonic", "sigmoid"):
        scored_rows = models.calibrate(m, models.logistic, method)(test)
        part = metrics.ranking(scored_rows, "cls", "proba").withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


@query("soft_vote")
def soft_vote(spark, sf):
    m, test = class_input(spark, sf, trees=10)
    voted = models.ensemble({"lr": models.logistic(m), "rf": models.forest(m)}, 2, {"lr": 2.0, "rf": 1.0})
    return models.evaluate(voted(test), "cls", 2)


@query("fusion_ablation")
def fusion_ablation(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    parted = splits.random_split(df.withColumn("has_a", F.lit(True)), "vec_id").cache()
    m, test = models.split_input(parted, columns, "y", 0)
    blocks = {"a": columns[:4], "b": columns[4:]}
    fused = models.early_fusion(m, blocks, models.ridge)
    return models.block_ablation(m, blocks, test, models.ridge, fused)


@query("late_fusion")
def late_fusion(spark, sf):
    df, columns = wide_embeddings(spark, sf)
    parted = splits.nested_split(df, "vec_id").cache()
    m = models.ModelInput(parted.filter("split = 'train'"), tuple(columns), "y", 0)
    blocks = {"a": columns[:4], "b": columns[4:]}
    fused, weights = models.late_fusion(m, blocks, parted.filter("split = 'validation'"), models.ridge)
    test = fused(parted.filter("split = 'test'"))
    table_ = models.evaluate(test, "y", 0)
    shown = spark.createDataFrame([(f"weight_{k}", w) for k, w in weights.items()], "metric string, value double")
    return table_.unionByName(shown)


@query("fusion_verdict")
def fusion_verdict(spark, sf):
    return models.fusion_verdict(fusion_ablation(spark, sf), "regression")


@query("tabular_reference")
def tabular_reference(spark, sf):
    m, test = regression_input(spark, sf)
    return models.run_baselines(m, test, ["dummy_mean", "ridge"])


# ---------------------------------------------------------------- blocks and text
@query(
    "modality_inference",
    """WITH c AS (SELECT 'scan_path' AS "column", 'scans/' || doc_id || '.png' AS s FROM documents UNION ALL SELECT 'text', text FROM documents
              UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents)
       SELECT "column", CASE WHEN avg(CASE WHEN regexp_matches(lower(s), '\\.(png|jpe?g|bmp|tiff?|dcm|nii|nii\\.gz)$') THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'image' WHEN avg(len(s)) > 60 THEN 'text' ELSE 'tabular' END AS modality
       FROM c GROUP BY 1 UNION ALL SELECT 'gene_a', 'genomic' UNION ALL SELECT 'n_chars', 'tabular'""",
)
def modality_inference(spark, sf):
    df = table(spark, sf, "documents").withColumns(
        {"scan_path": F.concat(F.lit("scans/"), F.col("doc_id").cast("string"), F.lit(".png")), "gene_a": F.col("n_chars") % 7}
    )
    return modality.modality_table(spark, modality.infer_modalities(df, "doc_id"))


@query(
    "block_schema",
    """SELECT * FROM (VALUES ('genomic', 'genomic', 'snp', 1), ('text', 'text', NULL, 1), ('tabular', 'tabular', NULL, 1), ('size', 'tabular', NULL, 1)) t(block, type, encoding, inputs)
       WHERE (SELECT max(doc_id % 3) FROM documents) <= 2""",
)
def block_schema(spark, sf):
    df = table(spark, sf, "documents").withColumn("snp_a", F.col("doc_id") % 3)
    blocks = {"genomic": ["snp_a"], "text": ["text"], "tabular": ["n_chars", "lang"], "size": ["n_chars"]}
    return modality.block_schema(df, blocks, "auto")


@query(
    "text_join",
    """SELECT c.conv_id, c.turn, CASE WHEN c.role = 'user' THEN c.text ELSE c.role || ' ' || c.text END AS text_block, true AS has_text FROM conversations c""",
)
def text_join(spark, sf):
    df = table(spark, sf, "conversations").withColumn("speaker", F.when(F.col("role") != "user", F.col("role")))
    return modality.with_text(df, ["speaker", "text"]).select("conv_id", "turn", "text_block", "has_text")


@query(
    "block_presence",
    """SELECT d.lang, count(*) AS n, count(l.doc_id) AS with_label FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def block_presence(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    joined = modality.join_block(docs, table(spark, sf, "labels"), "doc_id", "label")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_label").alias("with_label"))


@query(
    "hashed_words",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS token FROM documents),
            h AS (SELECT doc_id, md5(token) AS m FROM w),
            b AS (SELECT doc_id, CAST(('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2)) AS BIGINT) % 4096 AS bucket FROM h)
       SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(ln(1 + count(*)), 8) AS weight FROM b GROUP BY ALL""",
)
def hashed_words(spark, sf):
    out = tx.hashed_words(table(spark, sf, "documents"), "doc_id", "text")
    return out.withColumn("weight", F.round("weight", 8))


@query("sequence_kmers", "SELECT p_partkey, 30.0 AS kmers FROM part")
def sequence_kmers(spark, sf):
    """Hash digests of part names stand in for sequences over a small alphabet."""
    df = table(spark, sf, "part").select("p_partkey", F.translate(F.md5("p_name"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("dna"))
    from pyspark.ml.functions import vector_to_array

    counts = F.aggregate(vector_to_array("kmers"), F.lit(0.0), lambda a, x: a + x)
    return tx.kmers(df, "dna").select("p_partkey", counts.alias("kmers"))


# ---------------------------------------------------------------- whole flows
QUICK = experiments.TableSettings(
    search=search.SearchSettings(population=8, generations=3), baselines=("dummy_mean", "ridge"),
    bootstrap=20, repeats=1,
)


@query("table_flow")
def table_flow(spark, sf):
    """Parts: price from the other columns, every step from validation to intervals."""
    df = table(spark, sf, "part").drop("p_name")
    out = experiments.table_experiment(df, "p_partkey", "p_retailprice", settings=QUICK)
    return out["baselines"]


@query(
    "segment_flow",
    """WITH g AS (SELECT label, vec_id FROM embeddings WHERE vec_id % 11 <> 0),
            l AS (SELECT label, vec_id, lead(vec_id, 2) OVER (PARTITION BY label ORDER BY vec_id) AS v2 FROM g),
            p AS (SELECT label, count(*) FILTER ((v2 - vec_id) * 5 <= 2 * 5 + 100) AS pairs FROM l GROUP BY 1),
            r AS (SELECT label, count(*) AS read FROM embeddings WHERE vec_id % 11 <> 0 GROUP BY 1)
       SELECT 's' || label AS subject_id, read, pairs, read - pairs AS dropped FROM r JOIN p USING (label)""",
)
def segment_flow(spark, sf):
    """Segments to features to horizon pairs, with the report per subject."""
    from tidemark.plans.catalog_windows import segment_table
    from tidemark.sources import segments

    usable = segments.usable_segments(segment_table(spark, sf))
    return experiments.segment_report(usable, experiments.segment_pairs(usable, 2, gap_minutes=100.0))


@query("manifest_flow")
def manifest_flow(spark, sf):
    """Documents with a label: text and size blocks, fused and alone."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    out = experiments.manifest_experiment(docs, "doc_id", "quality", {"text": ["text"]})
    return out["ablation"]
