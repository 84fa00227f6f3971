"""Sliding windows over signals and the aggregate features of each window.

Everything that depends on row order (index, previous value) is computed once per series,
before rows are copied into overlapping windows: a slope does not change when the index
is shifted, and a difference belongs to a window when the earlier row is inside it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators.clean import plausible
from tidemark.operators.ordering import (
    Running, chunk_edges, grouped_quantiles, join_on, keyed_rows, positions, previous, running,
)

MINUTE = 60 * v.MICROS
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def sliding(
    df: DataFrame, t: str, size_us: int, step_us: int, wanted: DataFrame | None = None
) -> DataFrame:
    """One copy of a row per window that contains it; windows start on step multiples.

    ``wanted`` (window_start plus any keys) keeps only windows that have a target, before
    anything is aggregated.
    """
    last = (F.col(t) - F.pmod(F.col(t), F.lit(step_us))).cast("long")
    copies = -(-size_us // step_us)
    starts = F.array(*[last - F.lit(i * step_us).cast("long") for i in range(copies)])
    fits = F.filter(starts, lambda s: s + F.lit(size_us) > F.col(t))
    copies_of = df.withColumn("window_start", F.explode(fits)).withColumn(
        "window_end", F.col("window_start") + F.lit(size_us).cast("long")
    )
    if wanted is None:
        return copies_of
    on = [c for c in wanted.columns if c in copies_of.columns]
    return copies_of.join(wanted, on, "left_semi")


def within_session(
    windows: DataFrame, size_us: int, horizon_us: int = 0
) -> DataFrame:
    """Windows wholly inside their session and able to have a target.

    Expects session_start/session_end and, if targets bound the range, target_start and
    target_end.
    """
    begin, finish = F.col("session_start"), F.col("session_end")
    if "target_start" in windows.columns:
        begin = F.greatest(begin, F.col("target_start") - F.lit(size_us))
        finish = F.least(finish, F.col("target_end") - F.lit(horizon_us))
    fits = (F.col("window_start") >= begin) & (F.col("window_end") <= finish)
    return windows.filter(fits & (finish > begin + F.lit(size_us)))


#: Rows of a pane beyond which its windows' quantiles come from one chunked ordering instead.
PANE_ROWS = 1_000_000
#: Windows of a block, as a multiple of the panes of one window.
BLOCK = 8


def pane_starts(size_us: int, step_us: int) -> tuple[int, int]:
    """Length of a pane and panes of a window; windows begin and end where panes do."""
    pane = math.gcd(size_us, step_us)
    return pane, size_us // pane


def windows_of_pane(size_us: int, step_us: int) -> Column:
    """Starts of the windows that hold the pane at ``_pane``."""
    copies = -(-size_us // step_us)
    return F.expr(f"filter(transform(sequence(0, {copies - 1}), i -> _pane - pmod(_pane, {step_us}L) - i * {step_us}L), s -> s + {size_us}L > _pane)")


def pane_moments(rows: DataFrame, series: Sequence[str], value: str, position: str, *more: Column) -> DataFrame:
    """One row per series and pane: count, range, ends, and central sums of value and position."""
    x, p = F.col(value), F.col(position)
    n, sd = F.count(x), F.stddev_pop(x)
    return rows.groupBy(*series, "_pane").agg(
        n.alias("n"), F.avg(x).alias("mx"), F.avg(p).alias("mp"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.min_by(x, p).alias("first"), F.max_by(x, p).alias("last"),
        (F.var_pop(x) * n).alias("x2"), F.coalesce(F.skewness(x) * n * sd * sd * sd, F.lit(0.0)).alias("x3"),
        F.coalesce((F.kurtosis(x) + 3) * n * F.pow(sd, F.lit(4)), F.lit(0.0)).alias("x4"),
        (F.var_pop(p) * n).alias("p2"), (F.covar_pop(x, p) * n).alias("xp"), *more,
    )


def window_moments(panes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of windows from the moments of their panes (one row per window and pane).

    Panes with their ``_values`` also give the quartiles.
    """
    fields = ("_pane", "n", "mx", "mp", "low", "high", "first", "last", "x2", "x3", "x4", "p2", "xp")
    packed = "_values" in panes.columns
    fields = (*fields, "_values") if packed else fields
    found = panes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_p"))

    def total(term: str) -> Column:
        return F.expr(f"aggregate(_p, 0D, (a, p) -> a + {term})")

    d, e = "(p.mx - mean)", "(p.mp - _mp)"
    found = found.withColumn("n", F.expr("aggregate(_p, 0L, (a, p) -> a + p.n)"))
    found = found.withColumns({"mean": total("p.n * p.mx") / F.col("n"), "_mp": total("p.n * p.mp") / F.col("n")})
    found = found.withColumns({
        "_x2": total(f"p.x2 + p.n * {d} * {d}"), "_x3": total(f"p.x3 + 3 * {d} * p.x2 + p.n * {d} * {d} * {d}"),
        "_x4": total(f"p.x4 + 4 * {d} * p.x3 + 6 * {d} * {d} * p.x2 + p.n * {d} * {d} * {d} * {d}"),
        "_p2": total(f"p.p2 + p.n * {e} * {e}"), "_xp": total(f"p.xp + p.n * {d} * {e}"),
        "min": F.expr("array_min(_p.low)"), "max": F.expr("array_max(_p.high)"), "first": F.expr("_p[0].first"), "last": F.expr("element_at(_p, -1).last"),
    })
    n, var = F.col("n"), F.col("_x2") / F.col("n")
    sd = F.sqrt(var)
    quartiles = []
    if packed:
        found = found.withColumn("_values", F.sort_array(F.flatten(F.col("_p")["_values"])))
        quartiles = [quantile_of("_values", q).alias(name) for name, q in QUARTILES.items()]
    shaped = (n >= 8) & (sd > 1e-12)
    return found.select(
        *keys, "n", "mean", sd.alias("std"), "min", "max", (F.col("max") - F.col("min")).alias("range"),
        F.when(n >= 5, F.col("_xp") / F.col("_p2")).otherwise(F.lit(0.0)).alias("slope"), "last", (F.col("last") - F.col("first")).alias("delta"),
        F.when(shaped, F.col("_x3") / n / (var * sd)).alias("skew"), F.when(shaped, F.col("_x4") / n / (var * var) - 3).alias("kurtosis"), *quartiles,
    )


def quantile_of(values: str, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = f"((size({values}) - 1) * {q}D)"
    left, right = f"{values}[int(floor({at}))]", f"{values}[int(ceil({at}))]"
    return F.expr(f"{left} + ({right} - {left}) * ({at} - floor({at}))")


def window_quantiles(rows: DataFrame, series: Sequence[str], value: str, size_us: int, step_us: int, wanted: DataFrame | None) -> DataFrame:
    """Quartiles per window, from the values of its panes.

    Rows are exchanged once, by series and block of windows; only panes at the end of a block are
    also sent to the one before. Panes and windows are then formed where the rows lie.
    """
    pane, per_window = pane_starts(size_us, step_us)
    length = BLOCK * per_window * pane
    own = F.floor(F.col("_pane") / F.lit(length))
    first = F.floor((F.col("_pane") - F.lit(size_us - pane)) / F.lit(length))
    dealt = rows.select(*series, "_pane", value).withColumn("_block", F.explode(F.sequence(first, own))).repartition(*series, "_block")
    panes = dealt.groupBy(*series, "_block", "_pane").agg(F.collect_list(value).alias("_values"))
    each = panes.withColumn("window_start", F.explode(windows_of_pane(size_us, step_us))).where(F.floor(F.col("window_start") / F.lit(length)) == F.col("_block"))
    found = each.groupBy(*series, "_block", "window_start").agg(F.sort_array(F.flatten(F.collect_list("_values"))).alias("_values"))
    out = found.select(*series, "window_start", *[quantile_of("_values", q).alias(name) for name, q in QUARTILES.items()])
    return out if wanted is None else out.join(wanted, [c for c in wanted.columns if c in out.columns], "left_semi")


def chunked_quantiles(placed, moments, series, t, value, size_us, step_us, wanted, rows_per_chunk) -> DataFrame:
    """Quartiles per window of a large table; windows over a crowded pane apart from the others."""
    crowded = moments.where(F.col("n") > (rows_per_chunk or PANE_ROWS)).select(*series, "_pane")
    if crowded.isEmpty():
        return window_quantiles(placed, series, value, size_us, step_us, wanted)
    on = [*series, "window_start"]
    few = crowded.select(*series, F.explode(windows_of_pane(size_us, step_us)).alias("window_start")).distinct()
    if wanted is not None:
        few = few.join(wanted, [c for c in wanted.columns if c in on], "left_semi")
    spread_out = grouped_quantiles(sliding(placed, t, size_us, step_us, few), on, value, QUARTILES, rows_per_chunk)
    others = placed.join(crowded, [*series, "_pane"], "left_anti")
    packed = window_quantiles(others, series, value, size_us, step_us, wanted).join(few, on, "left_anti")
    return packed.unionByName(spread_out.select(*packed.columns))


STAT_NAMES = (
    "mean", "std", "min", "max", "median", "iqr", "range", "slope", "last", "delta", "skew",
    "kurtosis",
)


def basic_stats(
    df: DataFrame,
    series: Sequence[str],
    t: str,
    value: str,
    size_us: int,
    step_us: int,
    tie: str | None = None,
    rows_per_chunk: int | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Distribution and trend of ``value`` per series and window; windows of n >= 3.

    Non-finite values are dropped first. A series is aggregated once per pane, and a window is put
    together from its panes. Windows over a pane of very many rows (a default timestamp, say) take
    their quantiles from one chunked ordering.
    """
    series = list(series)
    order = [t] + ([tie] if tie else [])
    clean = keyed_rows(df, series).withColumn(value, v.finite(F.col(value)).cast("double")).filter(F.col(value).isNotNull())
    edges = chunk_edges(clean, t, rows_per_chunk, tie)
    pane, _ = pane_starts(size_us, step_us)
    placed = positions(clean.select(*series, *order, value), series, order, "_pos", edges)
    placed = placed.withColumn("_pane", (F.col(t) - F.pmod(F.col(t), F.lit(pane))).cast("long"))
    keys = [*series, "window_start", "window_end"]
    # While there is one chunk, rows already lie by series: panes and windows form without an exchange.
    moments = pane_moments(placed, series, value, "_pos", *([] if edges else [F.collect_list(value).alias("_values")]))
    each = moments.withColumn("window_start", F.explode(windows_of_pane(size_us, step_us)))
    if wanted is not None:
        each = each.join(wanted, [c for c in wanted.columns if c in each.columns], "left_semi")
    stats = window_moments(each, [*series, "window_start"])
    if edges:
        stats = join_on(stats, chunked_quantiles(placed, moments, series, t, value, size_us, step_us, wanted, rows_per_chunk), [*series, "window_start"], "inner")
    stats = stats.withColumn("window_end", F.col("window_start") + F.lit(size_us).cast("long"))
    return stats.filter("n >= 3").select(
        *keys, "n", "mean", "std", "min", "max", F.col("q50").alias("median"),
        (F.col("q75") - F.col("q25")).alias("iqr"), "range", "slope", "last", "delta", "skew",
        "kurtosis",
    )


def sampling_rates(
    df: DataFrame,
    series: Sequence[str],
    t: str,
    fallback: Column,
    longest_s: float = 60.0,
    fewest_rows: int = 10,
    fewest_deltas: int = 5,
    tie: str | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """1 / median positive time step per series, or the fallback when too few remain."""
    order = [t] + ([tie] if tie else [])
    prior = previous(keyed_rows(df, series).select(*series, *order), series, order, [t], rows_per_chunk=rows_per_chunk)
    step = (F.col(t) - F.col(f"prev_{t}")) / F.lit(float(v.MICROS))
    steps = prior.withColumn("_dt", F.when((step > 0) & (step < longest_s), step))
    sizes = steps.groupBy(*series).agg(F.count(F.lit(1)).alias("rows"), F.count("_dt").alias("deltas"))
    medians = grouped_quantiles(
        steps.filter("_dt is not null"), series, "_dt", {"median_dt": 0.5}, rows_per_chunk
    )
    joined = join_on(sizes, medians, series)
    usable = (F.col("rows") >= fewest_rows) & (F.col("deltas") >= fewest_deltas) & (F.col("median_dt") > 0)
    return joined.select(
        *series, "rows", "deltas", F.when(usable, 1.0 / F.col("median_dt")).otherwise(fallback).alias("fs")
    )


def _with_previous(df, series, t, value, tie, rows_per_chunk) -> DataFrame:
    order = [t] + ([tie] if tie else [])
    narrow = keyed_rows(df, series).select(*series, *order, value)
    return previous(narrow, series, order, [t, value], rows_per_chunk=rows_per_chunk)


def hrv_time(
    df: DataFrame,
    series: Sequence[str],
    t: str,
    rr: str,
    size_us: int,
    step_us: int,
    tie: str | None = None,
    rows_per_chunk: int | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Time-domain variability of beat intervals (ms) per window of at least ten beats."""
    kept = df.withColumn(rr, v.finite(F.col(rr))).filter(plausible(F.col(rr), 300, 2000))
    prior = _with_previous(kept, series, t, rr, tie, rows_per_chunk)
    windows = sliding(prior, t, size_us, step_us, wanted)
    inside = F.col(f"prev_{t}") >= F.col("window_start")
    diff = F.when(inside, F.col(rr) - F.col(f"prev_{rr}"))
    eps = F.lit(1e-12)
    base = windows.withColumn("_d", diff).groupBy(*series, "window_start", "window_end").agg(
        F.count(rr).alias("n_beats"), F.avg(rr).alias("mean_rr"), F.stddev_samp(rr).alias("sdnn"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"),
        (F.avg((F.abs("_d") > 50).cast("double")) * 100).alias("pnn50"),
        (F.avg((F.abs("_d") > 20).cast("double")) * 100).alias("pnn20"),
        (F.sqrt(F.lit(0.5)) * F.stddev_samp("_d")).alias("sd1"),
    ).filter("n_beats >= 10")
    square = 2 * F.col("sdnn") * F.col("sdnn") - F.col("sd1") * F.col("sd1")
    return base.withColumns(
        {
            "cvnn": F.col("sdnn") / (F.col("mean_rr") + eps),
            "mean_hr": F.lit(60000.0) / (F.col("mean_rr") + eps),
            "sd2": F.when(square > 0, F.sqrt(square)).otherwise(F.lit(0.0)),
        }
    ).withColumn("sd1_sd2", F.col("sd1") / (F.col("sd2") + eps))


def movement(
    df: DataFrame,
    series: Sequence[str],
    t: str,
    value: str,
    size_us: int,
    step_us: int,
    tie: str | None = None,
    rows_per_chunk: int | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Aggregate movement features per window: rms, mean abs deviation, activity, crossings.

    Deviations need the window mean first; it is joined back on the window, where the
    adaptive skew join splits a hot window.
    """
    clean = df.withColumn(value, v.finite(F.col(value))).filter(F.col(value).isNotNull())
    prior = _with_previous(clean, series, t, value, tie, rows_per_chunk)
    windows = sliding(prior, t, size_us, step_us, wanted)
    keys = [*series, "window_start", "window_end"]
    level = windows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd")
    )
    joined = join_on(windows, level, keys, "inner")
    x, mean = F.col(value), F.col("_mean")
    inside = F.col(f"prev_{t}") >= F.col("window_start")
    crossing = F.when(inside, ((x - mean < 0) != (F.col(f"prev_{value}") - mean < 0)).cast("double"))
    return joined.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sqrt(F.avg(x * x)).alias("rms"),
        F.avg(F.abs(x - mean)).alias("mad"),
        F.avg((x > mean + 0.5 * F.col("_sd")).cast("double")).alias("active_fraction"),
        F.avg(crossing).alias("zero_crossings"),
    )


def tonic_phasic(
    df: DataFrame, series: Sequence[str], order: Sequence[str], value: str,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Centred rolling mean of width max(3, n // 8) per series, and what it leaves.

    The width differs per series, so the mean comes from prefix sums looked up by
    position; both lookups are joins on the unique (series, position).
    """
    specs = {"_pos": Running("sum", F.lit(1).cast("long")), "_cum": Running("sum", F.col(value))}
    df = keyed_rows(df, series)
    placed = running(df, series, order, specs, rows_per_chunk=rows_per_chunk)
    sizes = df.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"))
    joined = join_on(placed, sizes, series, "inner").filter("_n > 8")
    width = F.greatest(F.lit(3), F.floor(F.col("_n") / 8)).cast("long")
    ahead = F.floor((width - 1) / 2)
    hi = F.least(F.col("_n"), F.col("_pos") + ahead)
    lo = F.greatest(F.lit(1), F.col("_pos") + ahead - width + 1)
    spans = joined.withColumns({"_hi": hi.cast("long"), "_lo": (lo - 1).cast("long")})
    sums = placed.select(*series, F.col("_pos").alias("_at"), F.col("_cum").alias("_sum"))
    upper = join_on(
        spans, sums.withColumnsRenamed({"_at": "_hi", "_sum": "_sum_hi"}), [*series, "_hi"], "inner"
    )
    both = join_on(
        upper, sums.withColumnsRenamed({"_at": "_lo", "_sum": "_sum_lo"}), [*series, "_lo"]
    )
    tonic = (F.col("_sum_hi") - F.coalesce("_sum_lo", F.lit(0.0))) / (F.col("_hi") - F.col("_lo"))
    return both.withColumn("tonic", tonic).withColumn("phasic", F.col(value) - F.col("tonic")).groupBy(*series).agg(
        F.avg("tonic").alias("tonic_mean"), F.stddev_pop("phasic").alias("phasic_std"),
        F.max(F.abs("phasic")).alias("phasic_max"),
    )


def widen(
    long: DataFrame, keys: Sequence[str], kind: str, stats: Sequence[str], kinds: Sequence[str],
    prefix: str = "",
) -> DataFrame:
    """One wide row per window from one row per (window, kind)."""
    columns = [
        F.max(F.when(F.col(kind) == k, F.col(s))).alias(f"{prefix}{k}_{s}") for k in kinds for s in stats
    ]
    return long.groupBy(*keys).agg(*columns)


def first_file_wins(
    long: DataFrame, keys: Sequence[str], features: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Per feature the value of the earliest file that has one."""
    rank = F.struct(*order)
    return long.groupBy(*keys).agg(
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f) for f in features]
    )


# Feature-name prefix to sensor block.
SENSOR_BLOCKS = {
    "ecg": "ecg", "hrv": "ecg", "resp": "respiration", "accel": "motion", "e4acc": "motion",
    "bvp": "ppg", "ppg": "ppg", "eda": "eda", "temp": "eda", "sum": "summary", "e4hr": "summary",
}


def sensor_block(name: Column) -> Column:
    prefix = F.element_at(F.split(name, "_"), 1)
    out = F.lit("summary")
    for key, block in SENSOR_BLOCKS.items():
        out = F.when(prefix == key, F.lit(block)).otherwise(out)
    return out


def blocks_of(names: Sequence[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in names:
        out.setdefault(SENSOR_BLOCKS.get(name.split("_")[0], "summary"), []).append(name)
    return out


def extraction_report(
    windows: DataFrame, subject: str, start: str, end: str, target: str,
    size_us: int, step_us: int,
) -> DataFrame:
    """Per subject (and one total row) windows, span in hours and target statistics."""
    overlap = round(max(0.0, 1 - step_us / size_us), 3)
    columns = [
        F.count(F.lit(1)).alias("windows"), F.avg(target).alias("target_mean"),
        F.stddev_pop(target).alias("target_sd"), F.min(target).alias("target_min"),
        F.max(target).alias("target_max"),
        ((F.max(end) - F.min(start)) / F.lit(3600e6)).alias("span_hours"),
        F.lit(overlap).alias("overlap"),
    ]
    each = windows.groupBy(F.col(subject).cast("string").alias("subject")).agg(*columns)
    return each.unionByName(windows.agg(*columns).withColumn("subject", F.lit("all")))
