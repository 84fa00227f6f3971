"""Imputation, scaling and encoding: parameters from training rows, applied everywhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators.clean import class_labels
from tidemark.operators.ordering import exact_quantiles
from tidemark.operators.profile import value_counts


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter("split = 'train'") if "split" in df.columns else df


@dataclass
class NumericFit:
    """Fill value, centre and scale per column."""

    params: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        changed = {}
        for c, (fill, centre, scale) in self.params.items():
            x = F.coalesce(v.finite(F.col(c)), F.lit(fill))
            changed[c] = F.coalesce(v.finite((x - F.lit(centre)) / F.lit(scale)), F.lit(0.0))
        return df.withColumns(changed)


def fit_numeric(
    df: DataFrame,
    columns: Sequence[str],
    impute: str = "median",
    scaler: str = "standard",
    constant: float = 0.0,
) -> NumericFit:
    """Imputation first, then scaling statistics of the imputed column.

    Filling ``m`` gaps with a known value changes sums and extremes in closed form, so
    the moments come from one pass over the raw column; only the robust scaler looks at
    the filled column again.
    """
    columns = list(columns)
    clean = train_rows(df).select(*[v.finite(F.col(f"`{c}`")).alias(c) for c in columns])
    stats = clean.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var"),
                F.min(c).alias("lo"), F.max(c).alias("hi"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ],
    ).first()
    fills: dict[str, float] = {}
    if impute == "median":
        fills = {c: q[0] for c, q in exact_quantiles(clean, columns, [0.5]).items()}
    elif impute == "most_frequent":
        pairs = clean.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in columns])).alias("p")
        )
        counts = pairs.filter("p.x is not null").groupBy("p.c", "p.x").count()
        best = counts.groupBy("c").agg(F.min(F.struct((-F.col("count")).alias("neg"), "x")).alias("b"))
        fills = {r["c"]: r["b"]["x"] for r in best.collect()}
    out = NumericFit()
    for i, c in enumerate(columns):
        s = stats[f"s{i}"]
        fill = {"mean": s["mean"], "constant": constant}.get(impute, fills.get(c))
        fill = 0.0 if fill is None else float(fill)
        rows, n = stats["rows"], s["n"]
        gaps = rows - n
        mean = ((s["mean"] or 0.0) * n + fill * gaps) / max(1, rows)
        spread = n * ((s["var"] or 0.0) + ((s["mean"] or 0.0) - mean) ** 2) + gaps * (fill - mean) ** 2
        sd = (spread / max(1, rows)) ** 0.5
        lo = min(x for x in (s["lo"], fill if gaps or not n else None) if x is not None)
        hi = max(x for x in (s["hi"], fill if gaps or not n else None) if x is not None)
        centre, scale = {
            "standard": (mean, sd), "minmax": (lo, hi - lo), "none": (0.0, 1.0), "robust": (0.0, 1.0),
        }[scaler]
        out.params[c] = (fill, centre, scale if abs(scale) > 10 * 2.2e-16 * max(1.0, abs(centre)) else 1.0)
    if scaler == "robust":
        filled = clean.select(*[F.coalesce(F.col(c), F.lit(out.params[c][0])).alias(c) for c in columns])
        for c, (q1, q2, q3) in exact_quantiles(filled, columns, [0.25, 0.5, 0.75]).items():
            out.params[c] = (out.params[c][0], q2, (q3 - q1) or 1.0)
    return out


@dataclass
class CategoricalFit:
    """Mode and kept levels per column; ``rare`` tells whether a rare bucket exists."""

    modes: dict[str, str]
    levels: dict[str, list[str]]
    rare: dict[str, bool]

    def filled(self, c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c)))

    def one_hot(self, df: DataFrame) -> DataFrame:
        """Indicator columns; an unknown level goes to the rare bucket, else to all zeros."""
        columns = {}
        for c, levels in self.levels.items():
            x = self.filled(c)
            for level in levels:
                columns[f"{c}_{level}"] = F.coalesce((x == level).cast("double"), F.lit(0.0))
            if self.rare[c]:
                known = x.isin(levels)
                columns[f"{c}_infrequent_sklearn"] = F.coalesce((~known).cast("double"), F.lit(0.0))
        return df.withColumns(columns).drop(*self.levels)

    def names(self) -> list[str]:
        out = []
        for c, levels in self.levels.items():
            out += [f"{c}_{level}" for level in levels]
            out += [f"{c}_infrequent_sklearn"] if self.rare[c] else []
        return out


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return value_counts(train_rows(df), columns)


def fit_categorical(
    df: DataFrame, columns: Sequence[str], max_levels: int | None = 30
) -> CategoricalFit:
    """Mode fill and the most frequent levels.

    The rank filter is pushed below the shuffle as a per-task limit, so a column with a
    billion levels still sends only ``max_levels + 1`` rows per task.
    """
    by = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    bound = (max_levels or 1_000) + 1
    gaps = train_rows(df).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    top = level_counts(df, columns).withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= bound)
    rows: dict[str, list] = {c: [] for c in columns}
    for r in top.collect():
        rows[r["column"]].append((r["value"], r["n"]))
    modes, levels, rare = {}, {}, {}
    for c in columns:
        ranked = sorted(rows[c], key=lambda p: (-p[1], p[0]))
        if not ranked:
            modes[c], levels[c], rare[c] = None, [], False
            continue
        modes[c] = ranked[0][0]
        # The fill makes the mode's count larger still, so the order is unchanged.
        many = max_levels is not None and len(ranked) > max_levels
        if max_levels is None and len(ranked) >= bound:
            raise ValueError(f"'{c}' has {bound} or more levels; give max_levels")
        kept = ranked[: max_levels - 1] if many else ranked
        levels[c], rare[c] = sorted(p[0] for p in kept), many
    return CategoricalFit(modes, levels, rare)


def ordinal_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): training levels in sorted order, as a table."""
    by = Window.partitionBy("column").orderBy("value")
    return level_counts(df, columns).select(
        "column", "value", (F.row_number().over(by) - 1).cast("int").alias("code")
    )


def ordinal_encode(df: DataFrame, columns: Sequence[str], fit: CategoricalFit) -> DataFrame:
    """Level index in sorted order, -1 for levels the training rows do not have."""
    changed = {}
    for c in columns:
        lookup = F.array(*[F.lit(level) for level in fit.levels[c]])
        position = F.array_position(lookup, fit.filled(c))
        changed[c] = F.coalesce(position.cast("int") - 1, F.lit(-1))
    return df.withColumns(changed)


@dataclass
class Preprocessor:
    numeric: NumericFit
    categorical: CategoricalFit
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.numeric.transform(df) if self.numeric.params else df
        return self.categorical.one_hot(out) if self.categorical.levels else out


def fit_preprocessor(
    df: DataFrame,
    exclude: Sequence[str] = (),
    impute: str = "median",
    scaler: str = "standard",
    max_levels: int | None = 30,
) -> Preprocessor:
    """Typed preprocessing of every feature column; timestamps are left out."""
    skip = {*exclude, "split", "fold"}
    numeric = [c for c in v.numeric_columns(df) if c not in skip]
    text = [c for c in v.categorical_columns(df) if c not in skip]
    if not numeric and not text:
        raise ValueError("no usable feature columns")
    first = fit_numeric(df, numeric, impute, scaler) if numeric else NumericFit()
    second = fit_categorical(df, text, max_levels) if text else CategoricalFit({}, {}, {})
    return Preprocessor(first, second, numeric + second.names())


# ---------------------------------------------------------------- target and blocks
def target_scale(df: DataFrame, target: str) -> tuple[float, float]:
    row = train_rows(df).agg(F.avg(target), F.stddev_pop(target)).first()
    return row[0], row[1] if row[1] and row[1] > 1e-12 else 1.0


def standardise_target(df: DataFrame, target: str, out: str = "y_scaled") -> DataFrame:
    mean, sd = target_scale(df, target)
    return df.withColumn(out, (F.col(target) - F.lit(mean)) / F.lit(sd))


def restore_target(df: DataFrame, column: str, mean: float, sd: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * F.lit(sd) + F.lit(mean))


def class_weights(df: DataFrame, label: str, threshold: float = 0.4) -> dict:
    """n / (k * n_c) when the classes are unbalanced, otherwise one."""
    class_labels(df, label)
    counts = {r[0]: r[1] for r in train_rows(df).groupBy(label).count().collect()}
    if min(counts.values()) / max(counts.values()) >= threshold:
        return {c: 1.0 for c in counts}
    total, k = sum(counts.values()), len(counts)
    return {c: total / (k * n) for c, n in counts.items()}


def with_class_weight(df: DataFrame, label: str, weights: Mapping, out: str = "weight") -> DataFrame:
    column = None
    for value, weight in weights.items():
        hit = F.col(label) == F.lit(value)
        column = F.when(hit, F.lit(weight)) if column is None else column.when(hit, F.lit(weight))
    return df.withColumn(out, column.otherwise(F.lit(1.0)))


def expression_block(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores by training mean and population sd; flat columns keep unit scale."""
    row = train_rows(df).agg(
        *[F.avg(v.finite(F.col(c))).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(v.finite(F.col(c))).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    changed = {}
    for i, c in enumerate(columns):
        sd = row[f"s{i}"]
        scale = sd if sd is not None and sd >= 1e-9 else 1.0
        z = (v.finite(F.col(c)) - F.lit(row[f"m{i}"])) / F.lit(scale)
        changed[c] = F.coalesce(z, F.lit(0.0))
    return df.withColumns(changed)


def snp_block(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing genotypes are 0 and values are clamped to 0..2."""
    return df.withColumns(
        {
            c: F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce(v.finite(F.col(c)), F.lit(0.0))))
            for c in columns
        }
    )
