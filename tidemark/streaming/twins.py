"""Structured Streaming twins of the sliding-window, session and horizon operators.

Each takes a stream with a watermark and gives rows once they can no longer change (append
mode), so what a run has written equals the batch operator over all rows that were not late, as far
as the watermark has come. State of a window, a session or a joined row is dropped once the watermark
has passed it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.session import scratch_path

#: Statistics of a window, as in :func:`tidemark.operators.windows.basic_stats`.
STATS = ("mean", "std", "min", "max", "median", "iqr", "range", "slope", "last", "delta", "skew", "kurtosis")


def event_stream(spark: SparkSession, folder: str, like: DataFrame, ts: str, delay: str) -> DataFrame:
    """Files that arrive in a folder, with rows of the table ``like``; ``ts`` may be late by ``delay``."""
    return spark.readStream.schema(like.schema).parquet(folder).withWatermark(ts, delay)


def window_stats(stream: DataFrame, series: Sequence[str], ts: str, value: str, size: str, step: str, tie: str) -> DataFrame:
    """Distribution and trend per series and window of at least three finite values.

    A slope goes by position in the window, which late rows shift, so the state of an open window
    holds its values; every other statistic is combined as rows come.
    """
    x = F.col(value)
    rows = stream.withColumn(value, v.finite(x)).where(x.isNotNull())
    n, sd = F.count(x), F.stddev_pop(x)
    shape = lambda c: F.when((n >= 8) & (sd > 1e-12), c)
    found = rows.groupBy(*series, F.window(ts, size, step)).agg(
        n.alias("n"), F.avg(x).alias("mean"), sd.alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        shape(F.skewness(x)).alias("skew"), shape(F.kurtosis(x)).alias("kurtosis"),
        F.collect_list(F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"), x.alias("x"))).alias("_rows"),
    ).where("n >= 3")
    ordered = found.withColumn("_x", F.transform(F.sort_array("_rows"), lambda r: r["x"])).drop("_rows")
    weighted = F.aggregate(F.transform("_x", lambda a, i: a * i), F.lit(0.0), lambda a, b: a + b)
    slope = (weighted - (F.col("n") - 1) / 2 * F.col("n") * F.col("mean")) * 12 / (F.col("n").cast("double") * (F.col("n") * F.col("n") - 1))
    return ordered.select(
        *series, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "mean", "std", "min", "max", F.col("_q")[1].alias("median"),
        (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), (F.col("max") - F.col("min")).alias("range"), F.when(F.col("n") >= 5, slope).otherwise(F.lit(0.0)).alias("slope"),
        F.element_at("_x", -1).alias("last"), (F.element_at("_x", -1) - F.element_at("_x", 1)).alias("delta"), "skew", "kurtosis",
    )


def sessions(stream: DataFrame, keys: Sequence[str], ts: str, seconds: Column) -> DataFrame:
    """Sessions of overlapping or touching spans that begin at ``ts`` and last ``seconds`` (none or less: no span)."""
    spans = stream.where(seconds > 0).withColumn("_length", F.make_interval(secs=seconds.cast("decimal(18,6)")))
    return spans.groupBy(*keys, F.session_window(ts, F.col("_length"))).agg(F.count(F.lit(1)).alias("spans")).select(
        *keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "spans"
    )


def horizon_join(signals: DataFrame, targets: DataFrame, keys: Sequence[str], ts: str, target_ts: str, low: str, high: str) -> DataFrame:
    """Every signal with the targets of its keys from ``low`` to ``high`` after it.

    Both sides carry watermarks, so each keeps only rows that the other can still meet.
    """
    renamed = targets.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = " AND ".join(f"{k} = _{k}" for k in keys)
    on = F.expr(f"{same} AND {target_ts} >= {ts} + INTERVAL {low} AND {target_ts} <= {ts} + INTERVAL {high}")
    return signals.join(renamed, on).drop(*[f"_{k}" for k in keys])


def run_available(stream: DataFrame, out: str, checkpoint: str) -> list[dict]:
    """Process what has arrived, append finished rows to the table ``out``; the progress of each batch."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return list(query.recentProgress)


def replay(rows: DataFrame, arrival: Column, count: int, build: Callable[[str], DataFrame]) -> tuple[DataFrame, list[dict]]:
    """Let the rows arrive in ``count`` instalments (``arrival`` from 0), and run the stream after each.

    ``build`` makes the stream from the folder of arrivals. Offsets, state and output live in the
    shared folder, so every run goes on where the one before ended.
    """
    spark = rows.sparkSession
    folder, out, checkpoint = (scratch_path(spark, name) for name in ("arrivals", "streamed", "offsets"))
    progress = []
    numbered = rows.withColumn("_arrival", arrival)
    for k in range(count):
        numbered.where(F.col("_arrival") == k).drop("_arrival").write.mode("append").parquet(folder)
        stream = build(folder)
        progress += run_available(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out), progress
