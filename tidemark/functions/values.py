"""Column expressions for missing values, types, text and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000


def finite(column: Column) -> Column:
    """NaN and both infinities become NULL."""
    x = column.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def is_infinite(column: Column) -> Column:
    return F.abs(column.cast("double")) == F.lit(float("inf"))


def missing(df: DataFrame, name: str) -> Column:
    """True where pandas would report a missing value."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN and infinity to NULL in every floating column; one narrow projection."""
    return df.select(
        *[
            finite(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def numeric_columns(df: DataFrame, booleans: bool = True) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def epoch_micros(column: Column) -> Column:
    """Wall-clock timestamp to microseconds, whatever timestamp type it has."""
    return F.unix_micros(column.cast("timestamp"))


def micros_to_timestamp(column: Column) -> Column:
    return F.timestamp_micros(column).cast("timestamp_ntz")


def epoch_seconds(column: Column) -> Column:
    return epoch_micros(column) / F.lit(float(MICROS))


def feature_tag(column: Column) -> Column:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    slug = F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9]+", "_")
    return F.regexp_replace(slug, "^_+|_+$", "")


def normalise_name(column: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_\-./]+", " ")


def hash_text(seed: int, *columns: Column) -> Column:
    """Shuffle key of a stable row id, the same on any partitioning: 15 hex digits."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.substring(F.md5(text), 1, 15)


def hash_order(seed: int, *columns: Column) -> Column:
    """The same key as a number, for orders that are cut into chunks."""
    return F.conv(hash_text(seed, *columns), 16, 10).cast("long")


def parse_wall_clock(column: Column) -> Column:
    """Day-first patterns before month-first ones, then ISO; NULL if none fits."""
    text = F.trim(column)
    day_first = (
        "d/M/yyyy H:mm:ss.SSSSSS", "d/M/yyyy H:mm:ss.SSS", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm",
        "d-M-yyyy H:mm:ss",
    )
    month_first = ("M/d/yyyy H:mm:ss.SSS", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm")
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in day_first + month_first]
    return F.coalesce(*tries, F.try_to_timestamp(text))
