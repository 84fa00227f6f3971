"""Writers: feature tables, predictions, reports and JSON-safe records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch_path


def write_table(
    df: DataFrame, name: str, kind: str = "parquet", path: str | None = None,
    partition_by: Sequence[str] = (), **options
) -> str:
    """Write one table and return its folder (a fresh one in the shared area by default)."""
    target = path or scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists").options(**options)
    if kind == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(target)
    return target


def feature_table(df: DataFrame, subject: str, ts: str, target: str) -> DataFrame:
    """Subject and window time first, features, target last."""
    features = [c for c in df.columns if c not in (subject, ts, target)]
    return df.select(
        F.col(subject).alias("subject_id"), F.col(ts).alias("window_time"), *features,
        F.col(target).alias("target"),
    )


def export_features(
    df: DataFrame, subject: str, ts: str, target: str, kind: str = "parquet", path: str | None = None
) -> str:
    """Clustered by subject and time range, so one subject's files stay few and a hot
    subject is still written by many tasks."""
    table = feature_table(df, subject, ts, target)
    ordered = table.repartitionByRange("subject_id", "window_time")
    return write_table(ordered, "features", kind, path)


def prediction_table(
    df: DataFrame, truth: str, predicted: str, probability: str | None = None,
    classes: int = 0, extra: Sequence[str] = ()
) -> DataFrame:
    """y_true, y_pred, then y_proba (two classes) or one column per class, then extras."""
    columns = [F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")]
    if probability:
        p = F.col(probability)
        if not isinstance(df.schema[probability].dataType, (T.ArrayType, T.DoubleType)):
            p = vector_to_array(p)
        if isinstance(df.schema[probability].dataType, T.DoubleType):
            columns.append(p.alias("y_proba"))
        elif classes == 2:
            columns.append(p[1].alias("y_proba"))
        else:
            columns += [p[i].alias(f"proba_class_{i}") for i in range(classes)]
    return df.select(*columns, *extra)


def selected_features(spark, names: Sequence[str], mask: Sequence[bool]) -> DataFrame:
    rows = [(n, bool(m)) for n, m in zip(names, mask)]
    return spark.createDataFrame(rows, "feature string, selected boolean")


def json_safe(df: DataFrame) -> DataFrame:
    """NaN to null, timestamps to ISO text; infinities Spark itself writes as text."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def write_record(df: DataFrame, name: str, path: str | None = None) -> str:
    return write_table(json_safe(df), name, "json", path, ignoreNullFields="false")


def write_tables(tables: Mapping[str, DataFrame], folder: str, kind: str = "csv") -> dict[str, str]:
    """One folder per statistical table."""
    root = folder.rstrip("/")
    return {name: write_table(df, name, kind, f"{root}/{name}") for name, df in tables.items()}
