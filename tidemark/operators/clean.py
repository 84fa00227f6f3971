"""Row and column cleaning: filters, encodings, deduplication, ranking, pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators.ordering import exact_quantiles, grouped_quantiles, join_on, positions

# Millimole-to-milligram factor and the median below which it applies.
UNIT_FACTOR = 18.018
UNIT_MEDIAN = 35.0


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(~v.missing(df, target))


def time_slice(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Half-open range; plain comparisons, so Parquet row groups are skipped."""
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def plausible(column: Column, low: float, high: float) -> Column:
    return (column > low) & (column < high)


def covered_columns(df: DataFrame, columns: Sequence[str], minimum: float = 0.5) -> list[str]:
    """Columns present in at least ``minimum`` of the rows, from one aggregate."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~v.missing(df, c)).alias(f"c{i}") for i, c in enumerate(columns)],
    ).first()
    total = max(1, row["n"])
    return [c for i, c in enumerate(columns) if row[f"c{i}"] / total >= minimum]


def coverage(df: DataFrame, columns: Sequence[str], minimum: float = 0.5) -> DataFrame:
    shares = df.agg(
        *[F.avg((~v.missing(df, c)).cast("double")).alias(c) for c in columns]
    )
    return shares.unpivot([], list(columns), "feature", "coverage").withColumn(
        "kept", F.col("coverage") >= minimum
    )


MAX_CLASSES = 10_000


def class_labels(df: DataFrame, target: str) -> list:
    """Sorted distinct labels; a label set too large to be classes is refused."""
    rows = df.select(target).dropna().distinct().orderBy(target).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"'{target}' has more than {MAX_CLASSES} distinct labels")
    return [r[0] for r in rows]


def encode_labels(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """Sorted distinct labels become 0..k-1."""
    labels = class_labels(df, target)
    mapping = df.sparkSession.createDataFrame(
        [(value, i) for i, value in enumerate(labels)], f"_value {df.schema[target].dataType.simpleString()}, {out} int"
    )
    return df.join(F.broadcast(mapping), F.col(target) == F.col("_value"), "left").drop("_value")


def normalise_units(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Series whose median is in the millimole range are rescaled, and labelled so."""
    medians = grouped_quantiles(df, keys, value, {"_median": 0.5})
    joined = join_on(df, medians, keys)
    small = F.col("_median") < UNIT_MEDIAN
    return (
        joined.withColumn(value, F.when(small, F.col(value) * UNIT_FACTOR).otherwise(F.col(value)))
        .withColumn("unit", F.when(small, F.lit("converted")).otherwise(F.lit("unchanged")))
        .drop("_median")
    )


def repair_intervals(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Beat intervals given in seconds (median magnitude under 10) become milliseconds."""
    magnitude = df.withColumn("_abs", F.abs(F.col(value)))
    medians = grouped_quantiles(magnitude, keys, "_abs", {"_median": 0.5})
    joined = join_on(magnitude, medians, keys)
    scale = F.when(F.col("_median") < 10, F.lit(1000.0)).otherwise(F.lit(1.0))
    return joined.withColumn(value, F.abs(F.col(value) * scale)).drop("_abs", "_median")


def magnitude(*axes: Column) -> Column:
    total = axes[0] * axes[0]
    for axis in axes[1:]:
        total = total + axis * axis
    return F.sqrt(total)


# Names under which accelerometer axes are recorded.
AXIS_NAMES = ("x", "y", "z", "accelx", "accely", "accelz", "vertical", "lateral", "sagittal")


def pick_channel(df: DataFrame, kind: str, limit: int = 12) -> list[str]:
    """Columns a signal kind is read from, by name first and by position otherwise."""
    numeric = v.numeric_columns(df, booleans=False)
    if kind == "rr":
        named = [c for c in numeric if "rr" in c.lower() or "interval" in c.lower()]
        return (named or numeric)[:1]
    if kind == "accel":
        axes = [c for c in numeric if c.strip().lower() in AXIS_NAMES]
        return axes[:3] if len(axes) >= 3 else numeric[:1]
    return numeric[:limit] if kind == "summary" else numeric[:1]


def dedupe_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """First row per key in ``order``. An aggregate, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min(row).alias("_row")).select(*keys, "_row.*")


def row_fingerprint(df: DataFrame) -> list[Column]:
    """128-bit hash of a row; NULLs are told apart by their positions."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return [F.xxhash64(*cells, gaps).alias("_h1"), F.xxhash64(gaps, F.lit("second"), *cells).alias("_h2")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Count and share of rows that repeat an earlier row in every column.

    Sixteen bytes per row are exchanged, not the row.
    """
    groups = df.select(*row_fingerprint(df)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
    ).withColumn("share", F.col("duplicates") / F.greatest(F.col("rows"), F.lit(1)))


def stable_sort(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(ts).asc_nulls_last(), F.col(tie).asc())


def stable_rank(df: DataFrame, ts: str, tie: str, name: str = "pos") -> DataFrame:
    """Position of every row in (time, tie) order, missing times last.

    The order itself for consumers that need it as a column; no total sort into one task.
    """
    keyed = df.withColumn("_t", v.epoch_micros(F.col(ts)).cast("double"))
    keyed = keyed.withColumn("_t", F.coalesce("_t", F.lit(float("inf"))))
    return positions(keyed, [], ["_t", tie], name).drop("_t")


def highest_variance(df: DataFrame, columns: Sequence[str], k: int = 25) -> list[str]:
    row = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    order = sorted(range(len(columns)), key=lambda i: (-(row[i] if row[i] is not None else -1), i))
    return [columns[i] for i in order[:k]]


def median_fill(
    df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """Median fill, then zero. Medians come from ``fit_on`` (training rows) when given."""
    medians = exact_quantiles(fit_on if fit_on is not None else df, columns, [0.5])
    return df.withColumns(
        {c: F.coalesce(v.finite(F.col(c)), F.lit(medians[c][0]), F.lit(0.0)) for c in columns}
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most k rows per key; the row-number limit is applied before the shuffle too."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(over)).filter(F.col("_rn") <= k).drop("_rn")
