"""Table profiling, task inference, validation and naive baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as v
from tidemark.operators.clean import duplicate_rows

REPORT = "level string, column string, check string, message string"


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for every non-missing value, as text.

    One branch per column: each scans only its column and groups by the typed value; text
    is made from distinct values only.
    """
    out = None
    for c in columns:
        part = (
            df.filter(~v.missing(df, c)).groupBy(F.col(f"`{c}`").alias("_v"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(c).alias("column"), F.col("_v").cast("string").alias("value"), "n")
        )
        out = part if out is None else out.unionByName(part)
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct) without turning values into text."""
    out = None
    for c in columns:
        values = df.filter(~v.missing(df, c)).select(F.col(f"`{c}`").alias("_v")).distinct()
        part = values.agg(F.count(F.lit(1)).alias("distinct")).select(F.lit(c).alias("column"), "distinct")
        out = part if out is None else out.unionByName(part)
    return out


def summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, rows, missing, missing share, exact distinct values."""
    columns = list(columns or df.columns)
    kinds = df.sparkSession.createDataFrame(
        [(i, c, df.schema[c].dataType.simpleString()) for i, c in enumerate(columns)],
        "ordinal int, column string, dtype string",
    )
    counts = df.agg(
        *[F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(v.missing(df, c)).alias("missing")).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    missing = counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}.rows"), F.col(f"c{i}.missing")) for i, c in enumerate(columns)])
        ).alias("m")
    ).select("m.*")
    distinct = distinct_counts(df, columns)
    return (
        kinds.join(missing, "column")
        .join(distinct, "column", "left")
        .select(
            "ordinal", "column", "dtype", "rows", "missing",
            (100.0 * F.col("missing") / F.greatest(F.col("rows"), F.lit(1))).alias("missing_pct"),
            F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"),
        )
    )


def table_bytes(spark, path: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def distinct_up_to(df: DataFrame, column: str, bound: int) -> int:
    """Exact distinct count, or ``bound + 1`` as soon as it is exceeded.

    ``limit`` over ``distinct`` stops reading once enough values are seen.
    """
    kept = df.filter(~v.missing(df, column)).select(column).distinct().limit(bound + 1)
    return kept.count()


def infer_task(df: DataFrame, target: str) -> str:
    """Classification for text, booleans, at most two values, or few integral values."""
    kind = df.schema[target].dataType
    seen = distinct_up_to(df, target, 20)
    if seen == 0:
        raise ValueError(f"'{target}' is entirely missing")
    if not isinstance(kind, T.NumericType) or seen <= 2:
        return "classification"
    if seen > 20:
        return "regression"
    x = F.col(target)
    integral = df.filter(~v.missing(df, target)).agg(F.bool_and(x == F.rint(x.cast("double")))).first()[0]
    return "classification" if integral else "regression"


def infer_tasks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same decision for many columns, as a table."""
    numeric = set(v.numeric_columns(df, booleans=False))
    whole = df.agg(
        *[
            F.bool_and(F.when(~v.missing(df, c), F.col(c) == F.rint(F.col(c).cast("double")))).alias(c)
            if c in numeric
            else F.lit(False).alias(c)
            for c in columns
        ]
    ).unpivot([], list(columns), "column", "integral")
    kinds = df.sparkSession.createDataFrame([(c, c in numeric) for c in columns], "column string, is_numeric boolean")
    distinct = distinct_counts(df, columns)
    few = (F.col("distinct") <= 2) | (F.col("integral") & (F.col("distinct") <= 20))
    task = F.when(~F.col("is_numeric") | few, "classification").otherwise("regression")
    return distinct.join(whole, "column").join(kinds, "column").select("column", "distinct", task.alias("task"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.filter(~v.missing(df, target)).groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def naive_class(df: DataFrame, target: str) -> DataFrame:
    """Majority class (smallest label on ties) and its accuracy."""
    counts = class_counts(df, target)
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(target).alias("label")))
    return counts.agg(best.alias("best"), F.sum("n").alias("rows")).select(
        F.col("best.label").alias("majority_class"),
        (-F.col("best.neg") / F.col("rows")).alias("accuracy"),
    )


def naive_regression(df: DataFrame, target: str) -> DataFrame:
    """Mean prediction with its RMSE and MAE; the mean is one scalar, so two scans."""
    y = v.finite(F.col(target))
    mean = df.agg(F.avg(y)).first()[0]
    return df.agg(
        F.avg(y).alias("mean"),
        F.sqrt(F.var_pop(y)).alias("rmse"),
        F.avg(F.abs(y - F.lit(mean))).alias("mae"),
    )


def validate(
    df: DataFrame, target: str, near_constant: float = 0.99, exact_near: float = 0.1
) -> DataFrame:
    """Issue report. Two narrow whole-table passes, no row shuffle except for duplicates.

    A value holding over half of a column is the median of the values' hashes, so the
    first pass finds the only candidate for near-constant columns and the second counts
    it. Distinct counts are approximate and made exact when close to a bound.
    """
    spark = df.sparkSession
    issues: list[tuple[str, str, str, str]] = []

    def add(level, column, check, message):
        issues.append((level, column, check, message))

    if df.isEmpty():
        return spark.createDataFrame([("CRITICAL", "", "empty", "table is empty")], REPORT)
    if target not in df.columns:
        message = f"target '{target}' not found"
        return spark.createDataFrame([("CRITICAL", target, "target", message)], REPORT)

    columns = [c for c in df.columns if c != target]
    numeric = set(v.numeric_columns(df, booleans=False))
    text = set(v.categorical_columns(df))

    def key(c):
        # Low 52 bits: approximate percentiles work on doubles, which hold these exactly.
        return F.when(~v.missing(df, c), F.xxhash64(F.col(f"`{c}`")).bitwiseAND((1 << 52) - 1))

    first = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(v.missing(df, target)).alias("target_missing"),
        *[F.count_if(v.missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(key(c), 0.02).alias(f"d{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(key(c), 0.5, 1000).alias(f"h{i}") for i, c in enumerate(columns)],
        *[
            (F.count_if(v.is_infinite(F.col(f"`{c}`"))) if c in numeric else F.lit(0)).alias(f"i{i}")
            for i, c in enumerate(columns)
        ],
    ).first()
    rows = first["rows"]
    second = df.agg(
        F.lit(0).alias("none"),
        *[
            F.count_if(key(c) == F.lit(first[f"h{i}"])).alias(f"t{i}")
            for i, c in enumerate(columns)
            if first[f"h{i}"] is not None
        ],
    ).first().asDict()

    repeated = duplicate_rows(df).first()
    if repeated["duplicates"]:
        share = repeated["duplicates"] / rows
        add("WARNING", "", "duplicates", f"{repeated['duplicates']} duplicated rows ({share:.1%})")
    if first["target_missing"]:
        add("WARNING", target, "target_missing", f"{first['target_missing']} rows have no target")

    for i, c in enumerate(columns):
        present = rows - first[f"m{i}"]
        distinct = first[f"d{i}"]
        if distinct <= 4:
            distinct = distinct_up_to(df, c, 4)
        elif c in text and (abs(distinct - 50) <= 10 or abs(distinct / rows - 0.5) <= exact_near):
            distinct = df.select(F.count_distinct(f"`{c}`")).first()[0]
        if distinct <= 1:
            add("WARNING", c, "constant", f"'{c}' is constant")
            continue
        ratio = second.get(f"t{i}", 0) / max(1, present)
        if ratio > near_constant:
            add("NOTE", c, "near_constant", f"'{c}' is near-constant ({ratio:.1%} one value)")
        if first[f"m{i}"] / rows > 0.5:
            add("WARNING", c, "missing", f"'{c}' is {first[f'm{i}'] / rows:.1%} missing")
        if first[f"i{i}"]:
            add("WARNING", c, "infinite", f"'{c}' has {first[f'i{i}']} infinite values")
        if c in text and distinct > 50 and distinct > 0.5 * rows:
            add("NOTE", c, "cardinality", f"'{c}' is high-cardinality text ({distinct} distinct)")

    if distinct_up_to(df, target, 20) <= 20:
        sizes = [r["n"] for r in class_counts(df, target).collect()]
        if len(sizes) >= 2 and min(sizes) / max(sizes) < 0.1:
            add("WARNING", target, "imbalance", f"class imbalance {min(sizes)} vs {max(sizes)}")
        if len(sizes) == 1:
            add("CRITICAL", target, "one_class", "target has one class only")
    if rows < 50:
        add("WARNING", "", "small", f"only {rows} rows")
    if len(columns) > rows:
        add("WARNING", "", "wide", f"{len(columns)} features for {rows} rows")
    return spark.createDataFrame(issues, REPORT)


def mode_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column and its share of the present values."""
    counts = value_counts(df, columns)
    best = F.min(F.struct((-F.col("n")).alias("neg"), "value"))
    return counts.groupBy("column").agg(
        best.alias("best"), F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct")
    ).select(
        "column", F.col("best.value").alias("mode"), "present", "distinct",
        (-F.col("best.neg") / F.col("present")).alias("mode_share"),
    )


def dataset_facts(df: DataFrame, target: str, group: str | None = None) -> DataFrame:
    """Rows, features and groups recorded with a run."""
    groups = F.count_distinct(group) if group else F.lit(None).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), groups.alias("n_groups")).withColumn(
        "n_features", F.lit(len([c for c in df.columns if c not in (target, group)]))
    )


def imbalance(df: DataFrame, target: str) -> DataFrame:
    return class_counts(df, target).agg(
        F.count(F.lit(1)).alias("classes"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        (F.min("n") / F.max("n")).alias("ratio"),
    )
