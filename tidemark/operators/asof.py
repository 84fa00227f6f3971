"""Time joins: interpolated targets, horizon pairs, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import Cuts, Running, chunk_edges, join_on, keyed_rows, positions, running


def interpolate_at(
    probes: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    at: str,
    ts: str,
    value: str,
    max_gap_us: int,
    out: str = "target",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Linear interpolation of ``series`` at each probe time (microseconds).

    NULL outside the series and when the nearer neighbour is farther than ``max_gap_us``.
    Series and probes are united and each probe takes the latest point before and the
    earliest after it, both running aggregates, so no range join is needed. Probes that are
    costly to compute should be checkpointed first: chunk sizes are taken from both sides.
    """
    keys = list(keys)
    points = keyed_rows(series, keys).select(*keys, F.col(ts).alias("_t"), F.col(value).alias("_low"), F.col(value).alias("_high"))
    edges = chunk_edges(points.select("_t").unionByName(probes.select(F.col(at).alias("_t"))), "_t", rows_per_chunk)
    if not edges:
        return _interpolated(points, probes, keys, at, max_gap_us, out, edges)
    # A time that many rows of a key share is one point and one probe.
    single = points.groupBy(*keys, "_t").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    times = keyed_rows(probes, [*keys, at]).select(*keys, F.col(at).alias("_at")).distinct()
    found = _interpolated(single, times, keys, "_at", max_gap_us, out, edges).where(F.col(out).isNotNull())
    return join_on(probes.withColumn("_at", F.col(at)), found, [*keys, "_at"]).drop("_at")


def _interpolated(points: DataFrame, probes: DataFrame, keys: list[str], at: str, max_gap_us: int, out: str, edges: Cuts) -> DataFrame:
    row = F.struct(*probes.columns)
    given = points.select(
        *keys, "_t", F.lit(0).alias("_kind"), F.struct(F.col("_t").alias("t"), F.col("_high").alias("v")).alias("_before"),
        F.struct(F.col("_t").alias("t"), F.col("_low").alias("v")).alias("_after"), F.lit(None).cast(probes.select(row.alias("r")).schema["r"].dataType).alias("_row"),
    )
    nothing = [F.lit(None).cast(given.schema[c].dataType).alias(c) for c in ("_before", "_after")]
    asked = probes.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), *nothing, row.alias("_row"))
    placed = running(
        given.unionByName(asked), keys, ["_t", "_kind"],
        {"_prev": Running("max", F.col("_before")), "_next": Running("min", F.col("_after"), reverse=True)},
        edges,
    )
    before = F.col("_t") - F.col("_prev.t")
    after = F.col("_next.t") - F.col("_t")
    inside = F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * before / (before + after)
    hit = F.when(before == 0, F.col("_prev.v")).when(
        inside & (F.least(before, after) <= F.lit(max_gap_us)), line
    )
    return placed.filter("_kind = 1").select("_row.*", hit.alias(out))


def horizon_pairs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    steps: int,
    step_minutes: float = 5.0,
    gap_minutes: float = 7.5,
    rows_per_chunk: int | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Each row with the value ``steps`` rows later of the same key.

    Kept when the elapsed time is positive and at most ``steps * step + gap``. Rows are
    numbered within the key and joined on (key, position), which is unique, so a long
    series spreads over all tasks.
    """
    order = [ts] + ([tie] if tie else [])
    placed = positions(keyed_rows(df, keys), keys, order, "_pos", rows_per_chunk=rows_per_chunk)
    later = placed.select(
        *keys, (F.col("_pos") - steps).alias("_pos"), F.col(ts).alias("target_time"),
        F.col(value).alias("target"),
    )
    joined = join_on(placed, later, [*keys, "_pos"], "inner").drop("_pos")
    elapsed = (F.col("target_time") - F.col(ts)) / F.lit(60e6)
    limit = steps * step_minutes + gap_minutes
    return joined.withColumn("elapsed_min", elapsed).filter(
        (F.col("elapsed_min") > 0) & (F.col("elapsed_min") <= limit)
    )


def session_islands(
    spans: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    tie: str,
    out: str = "session",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Number overlapping or touching spans of a key as one session, starting at 0."""
    edges = chunk_edges(spans, start, rows_per_chunk, tie)
    order = [start, tie]
    reach = {"_reach": Running("max", F.col(end), inclusive=False)}
    marked = running(spans, keys, order, reach, edges).withColumn(
        "_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
    )
    numbered = running(marked, keys, order, {out: Running("sum", F.col("_new"))}, edges)
    return numbered.withColumn(out, (F.col(out) - 1).cast("long")).drop("_reach", "_new")


def session_bounds(sessions: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    return sessions.groupBy(*keys, "session").agg(
        F.min(start).alias("session_start"), F.max(end).alias("session_end"),
        F.count(F.lit(1)).alias("spans"),
    )
