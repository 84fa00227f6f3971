"""Queries over time series: windows, targets, sessions, signal features, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators import asof, clean, spectral, windows
from tidemark.plans.registry import query, table
from tidemark.session import cut_lineage
from tidemark.sources import segments, sensors

HOUR = 3600 * v.MICROS
DAY = 24 * HOUR


def events_us(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", v.epoch_micros(F.col("ts")).alias("t")
    )


E_SQL = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"


def windows_sql(size: int, step: int, source: str = "e", name: str = "w") -> str:
    copies = -(-size // step)
    return f"""{name} AS (SELECT {source}.*, (t // {step} - i) * {step} AS window_start FROM {source}, range({copies}) r(i)
               WHERE (t // {step} - i) * {step} + {size} > t)"""


STATS_SQL = """count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
    quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
    max(value) - min(value) AS range,
    CASE WHEN count(*) >= 5 THEN regr_slope(value, pos) ELSE 0 END AS slope,
    arg_max(value, pos) AS last, arg_max(value, pos) - arg_min(value, pos) AS delta,
    CASE WHEN count(*) >= 8 AND stddev_pop(value) > 1e-12 THEN
      (avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * avg(value) * avg(value) * avg(value)) / power(stddev_pop(value), 3) END AS skew,
    CASE WHEN count(*) >= 8 AND stddev_pop(value) > 1e-12 THEN kurtosis_pop(value) END AS kurtosis"""
STATS = ["mean", "std", "min", "max", "median", "iqr", "range", "slope", "last", "delta", "skew", "kurtosis"]


# Means of two-decimal values fall exactly between two roundings; the offset keeps both
# engines on the same side.
NUDGE = 1.3e-9


def rounded(names, digits=5):
    return [(F.round(F.col(c) + NUDGE, digits) + 0.0).alias(c) for c in names]


def rounded_sql(names, digits=5):
    return ", ".join(f"round({c} + {NUDGE}, {digits}) + 0.0 AS {c}" for c in names)


@query(
    "window_basic_stats",
    f"""WITH {E_SQL}, {windows_sql(2 * DAY, DAY)}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY t, event_id) - 1 AS pos FROM w),
        s AS (SELECT user_id, window_start, {STATS_SQL} FROM p GROUP BY user_id, window_start)
        SELECT user_id, CAST(window_start // 1000000 AS BIGINT) AS window_s, n, {rounded_sql(STATS)} FROM s WHERE n >= 3""",
)
def window_basic_stats(spark, sf):
    out = windows.basic_stats(events_us(spark, sf), ["user_id"], "t", "value", 2 * DAY, DAY, "event_id")
    return out.select("user_id", F.expr("window_start div 1000000").alias("window_s"), "n", *rounded(STATS))


ASOF_SQL = """
  pr AS (SELECT user_id, t, value FROM e WHERE event_type = 'purchase'),
  b AS (SELECT user_id, probe_t, max(struct_pack(t := t, v := value)) FILTER (t <= probe_t) AS prev, min(struct_pack(t := t, v := value)) FILTER (t >= probe_t) AS nxt
        FROM probes JOIN pr USING (user_id) GROUP BY ALL),
  tg AS (SELECT user_id, probe_t, CASE WHEN prev.t = probe_t THEN prev.v
             WHEN prev IS NOT NULL AND nxt IS NOT NULL AND least(probe_t - prev.t, nxt.t - probe_t) <= {gap}
             THEN prev.v + (nxt.v - prev.v) * (probe_t - prev.t) / (nxt.t - prev.t) END AS target FROM b)
"""


@query(
    "window_features_target",
    f"""WITH {E_SQL}, sig AS (SELECT * FROM e WHERE event_type <> 'purchase'), {windows_sql(2 * DAY, DAY, 'sig')},
        p AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY t, event_id) - 1 AS pos FROM w),
        s AS (SELECT user_id, window_start, {STATS_SQL} FROM p GROUP BY user_id, window_start HAVING count(*) >= 3),
        probes AS (SELECT DISTINCT user_id, window_start + {3 * DAY} AS probe_t FROM s), {ASOF_SQL.format(gap=DAY)}
        SELECT s.user_id, CAST(window_start // 1000000 AS BIGINT) AS window_s, n, {rounded_sql(STATS)}, round(target + 1.3e-9, 5) AS target
        FROM s JOIN tg ON tg.user_id = s.user_id AND tg.probe_t = s.window_start + {3 * DAY} WHERE target IS NOT NULL""",
)
def window_features_target(spark, sf):
    """Flagship: sliding-window features of the signals with the future target value."""
    events = events_us(spark, sf)
    signal = events.filter("event_type <> 'purchase'")
    stats = cut_lineage(windows.basic_stats(signal, ["user_id"], "t", "value", 2 * DAY, DAY, "event_id"))
    probes = stats.withColumn("probe_t", F.col("window_end") + DAY)
    targets = events.filter("event_type = 'purchase'").select("user_id", "t", "value")
    out = asof.interpolate_at(probes, targets, ["user_id"], "probe_t", "t", "value", DAY)
    return out.filter("target is not null").select(
        "user_id", F.expr("window_start div 1000000").alias("window_s"), "n", *rounded(STATS), F.round(F.col("target") + NUDGE, 5).alias("target")
    )


@query(
    "target_asof_interp",
    f"""WITH {E_SQL}, probes AS (SELECT DISTINCT user_id, t + {6 * HOUR} AS probe_t FROM e WHERE event_type = 'click'), {ASOF_SQL.format(gap=12 * HOUR)}
        SELECT user_id, probe_t, round(target, 6) AS target FROM probes LEFT JOIN tg USING (user_id, probe_t)""",
)
def target_asof_interp(spark, sf):
    events = events_us(spark, sf)
    probes = events.filter("event_type = 'click'").select("user_id", (F.col("t") + 6 * HOUR).alias("probe_t"))
    targets = events.filter("event_type = 'purchase'").select("user_id", "t", "value")
    out = asof.interpolate_at(probes, targets, ["user_id"], "probe_t", "t", "value", 12 * HOUR)
    return out.withColumn("target", F.round("target", 6))


@query(
    "window_naive_baseline",
    f"""WITH {E_SQL}, pr0 AS (SELECT 1), sig AS (SELECT * FROM e WHERE event_type <> 'purchase'), {windows_sql(2 * DAY, DAY, 'sig')},
        s AS (SELECT user_id, window_start FROM w GROUP BY ALL HAVING count(*) >= 3),
        probes AS (SELECT DISTINCT user_id, window_start + {3 * DAY} AS probe_t FROM s), {ASOF_SQL.format(gap=DAY)}
        SELECT count(*) AS windows, round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS rmse FROM tg WHERE target IS NOT NULL""",
)
def window_naive_baseline(spark, sf):
    out = window_features_target_rows(spark, sf)
    return out.agg(
        F.count("target").alias("windows"), F.round(F.avg("target"), 6).alias("mean"),
        F.round(F.stddev_pop("target"), 6).alias("rmse"),
    )


def window_features_target_rows(spark, sf):
    events = events_us(spark, sf)
    stats = cut_lineage(windows.basic_stats(
        events.filter("event_type <> 'purchase'"), ["user_id"], "t", "value", 2 * DAY, DAY, "event_id"
    ))
    probes = stats.withColumn("probe_t", F.col("window_end") + DAY)
    targets = events.filter("event_type = 'purchase'").select("user_id", "t", "value")
    return asof.interpolate_at(probes, targets, ["user_id"], "probe_t", "t", "value", DAY).filter("target is not null")


@query(
    "horizon_pairs",
    f"""WITH {E_SQL}, l AS (SELECT user_id, event_id, t, value, lead(t, 6) OVER w AS t6, lead(value, 6) OVER w AS v6 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
        SELECT user_id, event_id, v6 AS target, round((t6 - t) / 60e6, 4) AS elapsed_min FROM l
        WHERE t6 > t AND (t6 - t) / 60e6 <= 6 * 600 + 300""",
)
def horizon_pairs(spark, sf):
    pairs = asof.horizon_pairs(events_us(spark, sf), ["user_id"], "t", "value", 6, 600.0, 300.0, tie="event_id")
    return pairs.select("user_id", "event_id", "target", F.round("elapsed_min", 4).alias("elapsed_min"))


SPANS_SQL = f"""{E_SQL}, sp AS (SELECT user_id, event_id, t AS s, t + CAST(round(value * 600 * 1000000) AS BIGINT) AS f FROM e),
  r AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
  k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS session FROM r)"""


def spans(spark, sf):
    return events_us(spark, sf).select(
        "user_id", "event_id", F.col("t").alias("s"), (F.col("t") + F.round(F.col("value") * 600 * 1000000).cast("long")).alias("f")
    )


@query(
    "session_islands",
    f"""WITH {SPANS_SQL} SELECT user_id, CAST(session AS BIGINT) AS session, min(s) AS session_start, max(f) AS session_end, count(*) AS spans FROM k GROUP BY ALL""",
)
def session_islands(spark, sf):
    placed = asof.session_islands(spans(spark, sf), ["user_id"], "s", "f", "event_id")
    return asof.session_bounds(placed, ["user_id"], "s", "f")


@query(
    "windows_in_sessions",
    f"""WITH {SPANS_SQL}, b AS (SELECT user_id, session, min(s) AS b0, max(f) AS b1 FROM k GROUP BY ALL),
        g AS (SELECT user_id, min(t) AS g0, max(t) AS g1 FROM e WHERE event_type = 'purchase' GROUP BY 1),
        x AS (SELECT k.user_id, k.session, k.s AS t, greatest(b0, g0 - {HOUR}) AS lo, least(b1, g1 - {HOUR}) AS hi FROM k JOIN b USING (user_id, session) JOIN g USING (user_id)),
        {windows_sql(HOUR, HOUR // 3, 'x', 'xw')}
        SELECT user_id, CAST(session AS BIGINT) AS session, CAST(window_start // 1000000 AS BIGINT) AS window_s, count(*) AS n
        FROM xw WHERE window_start >= lo AND window_start + {HOUR} <= hi AND hi > lo + {HOUR} GROUP BY ALL""",
)
def windows_in_sessions(spark, sf):
    placed = asof.session_islands(spans(spark, sf), ["user_id"], "s", "f", "event_id")
    bounds = asof.session_bounds(placed, ["user_id"], "s", "f").drop("spans")
    targets = events_us(spark, sf).filter("event_type = 'purchase'").groupBy("user_id").agg(
        F.min("t").alias("target_start"), F.max("t").alias("target_end")
    )
    rows = placed.join(bounds, ["user_id", "session"]).join(targets, "user_id")
    inside = windows.within_session(windows.sliding(rows, "s", HOUR, HOUR // 3), HOUR, HOUR)
    return inside.groupBy("user_id", "session", F.expr("window_start div 1000000").alias("window_s")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "sampling_rate",
    f"""WITH {E_SQL}, d AS (SELECT user_id, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) / 1e6 AS dt FROM e),
        m AS (SELECT user_id, count(*) AS rows, count(*) FILTER (dt > 0 AND dt < 36000) AS deltas, quantile_cont(dt, 0.5) FILTER (dt > 0 AND dt < 36000) AS med FROM d GROUP BY 1)
        SELECT user_id, rows, deltas, round(CASE WHEN rows >= 10 AND deltas >= 5 THEN 1 / med ELSE 25.0 END, 9) AS fs FROM m""",
)
def sampling_rate(spark, sf):
    out = windows.sampling_rates(events_us(spark, sf), ["user_id"], "t", F.lit(25.0), 36000.0, tie="event_id")
    return out.withColumn("fs", F.round("fs", 9))


HRV = ["mean_rr", "sdnn", "rmssd", "pnn50", "pnn20", "sd1", "cvnn", "mean_hr", "sd2", "sd1_sd2"]


@query(
    "rr_time_domain",
    f"""WITH {E_SQL}, f AS (SELECT user_id, event_id, t, value * 10 AS rr FROM e WHERE value * 10 > 300 AND value * 10 < 2000), {windows_sql(8 * DAY, 4 * DAY, 'f')},
        d AS (SELECT *, rr - lag(rr) OVER (PARTITION BY user_id, window_start ORDER BY t, event_id) AS d FROM w),
        b AS (SELECT user_id, window_start, count(*) AS n_beats, avg(rr) AS mean_rr, stddev_samp(rr) AS sdnn, sqrt(avg(d * d)) AS rmssd,
               avg(CASE WHEN abs(d) > 50 THEN 100.0 WHEN d IS NOT NULL THEN 0.0 END) AS pnn50, avg(CASE WHEN abs(d) > 20 THEN 100.0 WHEN d IS NOT NULL THEN 0.0 END) AS pnn20,
               sqrt(0.5) * stddev_samp(d) AS sd1 FROM d GROUP BY ALL HAVING count(*) >= 10),
        c AS (SELECT *, sdnn / (mean_rr + 1e-12) AS cvnn, 60000 / (mean_rr + 1e-12) AS mean_hr, CASE WHEN 2 * sdnn * sdnn - sd1 * sd1 > 0 THEN sqrt(2 * sdnn * sdnn - sd1 * sd1) ELSE 0 END AS sd2 FROM b),
        z AS (SELECT * REPLACE (round(sd2, 4) AS sd2), CASE WHEN round(sd2, 4) > 0 THEN sd1 / round(sd2, 4) END AS sd1_sd2 FROM c)
        SELECT user_id, CAST(window_start // 1000000 AS BIGINT) AS window_s, n_beats, {rounded_sql(HRV)} FROM z""",
)
def rr_time_domain(spark, sf):
    rr = events_us(spark, sf).withColumn("rr", F.col("value") * 10)
    out = windows.hrv_time(rr, ["user_id"], "t", "rr", 8 * DAY, 4 * DAY, "event_id")
    # Where the ellipse is a line, its width is rounding noise: no ratio.
    width = F.round("sd2", 4)
    out = out.withColumns({"sd2": width, "sd1_sd2": F.when(width > 0, F.col("sd1") / width)})
    return out.select(
        "user_id", F.expr("window_start div 1000000").alias("window_s"), "n_beats", *rounded(HRV)
    )


MOVE = ["rms", "mad", "active_fraction", "zero_crossings"]


@query(
    "movement_activity",
    f"""WITH {E_SQL}, {windows_sql(8 * DAY, 4 * DAY)},
        m AS (SELECT *, avg(value) OVER g AS mu, stddev_pop(value) OVER g AS sd, lag(value) OVER (PARTITION BY user_id, window_start ORDER BY t, event_id) AS pv FROM w WINDOW g AS (PARTITION BY user_id, window_start)),
        z AS (SELECT user_id, window_start, count(*) AS n, sqrt(avg(value * value)) AS rms, avg(abs(value - mu)) AS mad, avg(CASE WHEN value > mu + 0.5 * sd THEN 1.0 ELSE 0.0 END) AS active_fraction,
               avg(CASE WHEN pv IS NULL THEN NULL WHEN (value - mu < 0) <> (pv - mu < 0) THEN 1.0 ELSE 0.0 END) AS zero_crossings FROM m GROUP BY ALL)
        SELECT user_id, CAST(window_start // 1000000 AS BIGINT) AS window_s, n, {rounded_sql(MOVE)} FROM z""",
)
def movement_activity(spark, sf):
    out = windows.movement(events_us(spark, sf), ["user_id"], "t", "value", 8 * DAY, 4 * DAY, "event_id")
    return out.select("user_id", F.expr("window_start div 1000000").alias("window_s"), "n", *rounded(MOVE))


@query(
    "tonic_phasic",
    f"""WITH {E_SQL}, p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM e),
        q AS (SELECT *, greatest(3, n // 8) AS width FROM p WHERE n > 8),
        m AS (SELECT a.user_id, a.pos, a.value, avg(b.value) AS tonic FROM q a JOIN p b ON a.user_id = b.user_id AND b.pos <= a.pos + (a.width - 1) // 2 AND b.pos > a.pos + (a.width - 1) // 2 - a.width GROUP BY ALL)
        SELECT user_id, round(avg(tonic), 5) AS tonic_mean, round(stddev_pop(value - tonic), 5) AS phasic_std, round(max(abs(value - tonic)), 5) AS phasic_max FROM m GROUP BY 1""",
)
def tonic_phasic(spark, sf):
    out = windows.tonic_phasic(events_us(spark, sf), ["user_id"], ["t", "event_id"], "value")
    return out.select("user_id", *rounded(["tonic_mean", "phasic_std", "phasic_max"]))


@query(
    "window_wide_kinds",
    f"""WITH {E_SQL}, {windows_sql(4 * DAY, 2 * DAY)},
        s AS (SELECT user_id, window_start, event_type, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM w GROUP BY ALL HAVING count(*) >= 3)
        SELECT user_id, CAST(window_start // 1000000 AS BIGINT) AS window_s, round(max(mean) FILTER (event_type = 'click') + 1.3e-9, 5) AS sum_click_mean, round(max(std) FILTER (event_type = 'click'), 5) AS sum_click_std,
               round(max(mean) FILTER (event_type = 'view') + 1.3e-9, 5) AS sum_view_mean, round(max(std) FILTER (event_type = 'view'), 5) AS sum_view_std
        FROM s GROUP BY ALL""",
)
def window_wide_kinds(spark, sf):
    events = events_us(spark, sf)
    stats = windows.basic_stats(events, ["user_id", "event_type"], "t", "value", 4 * DAY, 2 * DAY, "event_id")
    wide = windows.widen(stats, ["user_id", "window_start"], "event_type", ["mean", "std"], ["click", "view"], "sum_")
    names = [c for c in wide.columns if c.startswith("sum_")]
    return wide.select("user_id", F.expr("window_start div 1000000").alias("window_s"), *[F.round(F.col(c) + (NUDGE if c.endswith("mean") else 0.0), 5).alias(c) for c in names])


@query(
    "first_file_wins",
    f"""WITH {E_SQL}, f AS (SELECT user_id, event_type, min(t) AS s, avg(value) FILTER (value > 50) AS high FROM e GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_type) AS k FROM f WHERE high IS NOT NULL)
        SELECT user_id, round(high, 6) AS high FROM r WHERE k = 1""",
)
def first_file_wins(spark, sf):
    files = events_us(spark, sf).groupBy("user_id", "event_type").agg(
        F.min("t").alias("s"), F.avg(F.when(F.col("value") > 50, F.col("value"))).alias("high")
    )
    out = windows.first_file_wins(files, ["user_id"], ["high"], ["s", "event_type"])
    return out.filter("high is not null").withColumn("high", F.round("high", 6))


@query(
    "extraction_report",
    f"""WITH {E_SQL}, {windows_sql(2 * DAY, DAY)}, s AS (SELECT user_id, window_start, avg(value) AS target FROM w GROUP BY ALL HAVING count(*) >= 3),
        c AS (SELECT CAST(user_id AS VARCHAR) AS subject, window_start, target FROM s UNION ALL SELECT 'all', window_start, target FROM s)
        SELECT subject, count(*) AS windows, round(avg(target) + 1.3e-9, 5) + 0.0 AS target_mean, round(stddev_pop(target) + 1.3e-9, 5) + 0.0 AS target_sd, round(min(target) + 1.3e-9, 5) + 0.0 AS target_min, round(max(target) + 1.3e-9, 5) + 0.0 AS target_max,
               (max(window_start) + {2 * DAY} - min(window_start)) / 3600e6 AS span_hours, CAST(0.5 AS DOUBLE) AS overlap FROM c GROUP BY 1""",
)
def extraction_report(spark, sf):
    stats = windows.basic_stats(events_us(spark, sf), ["user_id"], "t", "value", 2 * DAY, DAY, "event_id")
    out = windows.extraction_report(stats, "user_id", "window_start", "window_end", "mean", 2 * DAY, DAY)
    shown = ["target_mean", "target_sd", "target_min", "target_max"]
    return out.select("subject", "windows", *rounded(shown), "span_hours", "overlap")


@query(
    "persistence_baseline",
    f"""WITH {E_SQL}, l AS (SELECT value, t, lead(t, 6) OVER w AS t6, lead(value, 6) OVER w AS v6 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
        SELECT count(*) AS pairs, round(sqrt(avg((v6 - value) * (v6 - value))), 6) AS persistence_rmse, round(stddev_pop(v6), 6) AS mean_rmse FROM l WHERE t6 > t AND (t6 - t) / 60e6 <= 6 * 600 + 300""",
)
def persistence_baseline(spark, sf):
    pairs = asof.horizon_pairs(events_us(spark, sf), ["user_id"], "t", "value", 6, 600.0, 300.0, tie="event_id")
    gap = F.col("target") - F.col("value")
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("persistence_rmse"),
        F.round(F.stddev_pop("target"), 6).alias("mean_rmse"),
    )


@query(
    "sensor_blocks",
    """WITH f AS (SELECT unnest(['ecg_', 'hrv_', 'resp_', 'accel_', 'e4acc_', 'bvp_', 'ppg_', 'eda_', 'temp_', 'sum_', 'e4hr_', 'zz_']) || p_name AS feature FROM (SELECT DISTINCT p_name FROM part))
       SELECT CASE split_part(feature, '_', 1) WHEN 'ecg' THEN 'ecg' WHEN 'hrv' THEN 'ecg' WHEN 'resp' THEN 'respiration' WHEN 'accel' THEN 'motion' WHEN 'e4acc' THEN 'motion'
              WHEN 'bvp' THEN 'ppg' WHEN 'ppg' THEN 'ppg' WHEN 'eda' THEN 'eda' WHEN 'temp' THEN 'eda' ELSE 'summary' END AS block, count(*) AS features FROM f GROUP BY 1""",
)
def sensor_blocks(spark, sf):
    prefixes = F.array(*[F.lit(p + "_") for p in (*windows.SENSOR_BLOCKS, "zz")])
    names = table(spark, sf, "part").select("p_name").distinct().select(
        F.explode(F.transform(prefixes, lambda p: F.concat(p, F.col("p_name")))).alias("feature")
    )
    return names.groupBy(windows.sensor_block(F.col("feature")).alias("block")).agg(F.count(F.lit(1)).alias("features"))


# ---------------------------------------------------------------- sensor files
PATHS_SQL = """paths AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'diabetes_set/' WHEN user_id % 3 = 1 THEN 'healthy_set/' ELSE 'other/' END
    || CASE WHEN user_id % 4 = 0 THEN 'S_' || user_id % 1000 WHEN user_id % 4 = 1 THEN 'c1s' || user_id WHEN user_id % 4 = 2 THEN CAST(user_id % 1000 AS VARCHAR) ELSE 'nobody' END
    || '/sensor_data/' || strftime(ts, '%Y_%m_%d-%H_%M_%S') || '/x'
    || CASE event_type WHEN 'click' THEN '_Summary.csv' WHEN 'view' THEN '_RR.csv' WHEN 'error' THEN '_Accel.csv' WHEN 'purchase' THEN '_glucose.csv' ELSE '_notes.csv' END AS path, ts FROM events),
  c AS (SELECT path, ts,
      CASE WHEN path LIKE '%\\_Summary.csv' ESCAPE '\\' THEN 'summary' WHEN path LIKE '%\\_RR.csv' ESCAPE '\\' THEN 'rr' WHEN path LIKE '%\\_Accel.csv' ESCAPE '\\' THEN 'accel' WHEN path LIKE '%glucose.csv' THEN 'target' END AS kind,
      CASE WHEN regexp_matches(split_part(path, '/', 2), '^\\d{1,3}$') THEN lpad(split_part(path, '/', 2), 3, '0')
           WHEN split_part(path, '/', 2) LIKE 'S\\_%' ESCAPE '\\' THEN lpad(split_part(split_part(path, '/', 2), '_', 2), 3, '0')
           WHEN split_part(path, '/', 2) LIKE 'c1s%' THEN split_part(path, '/', 2) ELSE 'unknown' END AS subject_id,
      CASE WHEN path LIKE 'diabetes%' THEN 'diabetes' WHEN path LIKE 'healthy%' THEN 'healthy' ELSE 'unknown' END AS cohort FROM paths)"""


def path_table(spark, sf):
    events = table(spark, sf, "events")
    u, kind = F.col("user_id"), F.col("event_type")
    cohort = F.when(u % 3 == 0, "diabetes_set/").when(u % 3 == 1, "healthy_set/").otherwise("other/")
    subject = F.when(u % 4 == 0, F.concat(F.lit("S_"), (u % 1000).cast("string"))).when(
        u % 4 == 1, F.concat(F.lit("c1s"), u.cast("string"))
    ).when(u % 4 == 2, (u % 1000).cast("string")).otherwise("nobody")
    ending = F.when(kind == "click", "_Summary.csv").when(kind == "view", "_RR.csv").when(
        kind == "error", "_Accel.csv"
    ).when(kind == "purchase", "_glucose.csv").otherwise("_notes.csv")
    stamp = F.date_format("ts", "yyyy_MM_dd-HH_mm_ss")
    return events.select(F.concat(cohort, subject, F.lit("/sensor_data/"), stamp, F.lit("/x"), ending).alias("path"))


@query(
    "signal_discovery",
    f"""WITH {PATHS_SQL} SELECT kind, subject_id, cohort, count(*) AS files, CAST(min(epoch(date_trunc('second', ts))) AS BIGINT) AS first_start FROM c WHERE kind IS NOT NULL GROUP BY ALL""",
)
def signal_discovery(spark, sf):
    files = sensors.classify(path_table(spark, sf)).filter("kind is not null")
    return files.groupBy("kind", "subject_id", "cohort").agg(
        F.count(F.lit(1)).alias("files"), F.unix_seconds(F.min("session_start")).alias("first_start")
    )


@query(
    "signal_inventory",
    f"""WITH {PATHS_SQL} SELECT subject_id, count(*) FILTER (kind = 'target') AS target_files, count(*) FILTER (kind = 'summary') AS summary, count(*) FILTER (kind = 'rr') AS rr,
        count(*) FILTER (kind = 'accel') AS accel, count(*) FILTER (kind = 'target') > 0 AND count(*) FILTER (kind <> 'target') > 0 AS usable FROM c WHERE kind IS NOT NULL GROUP BY 1""",
)
def signal_inventory(spark, sf):
    files = sensors.classify(path_table(spark, sf)).filter("kind is not null")
    return sensors.inventory(files).select("subject_id", "target_files", "summary", "rr", "accel", "usable")


@query(
    "signal_times",
    """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS row_pos, ts, value,
                    avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id) AS ok FROM events)
       SELECT path, count(*) AS n, sum(CASE WHEN ok >= 0.5 THEN epoch_ms(ts) ELSE epoch_ms(TIMESTAMP '2024-01-01') + row_pos * 40 END)::DOUBLE / 1e6 AS total_ms FROM r GROUP BY 1""",
)
def signal_times(spark, sf):
    events = table(spark, sf, "events")
    text = F.when(F.col("user_id") % 2 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss.SSS")).otherwise("no clock")
    rows = events.select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("row_pos"), text.alias("stamp"),
        F.lit("2024-01-01").cast("timestamp").alias("session_start"),
    )
    out = sensors.signal_times(rows, "stamp", F.lit(25.0))
    return out.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.expr("t_us div 1000")).cast("double") / 1e6).alias("total_ms")
    )


@query(
    "target_read",
    """WITH r AS (SELECT user_id, date_trunc('hour', ts) AS h, event_id, value, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase')
       SELECT user_id, CAST(epoch(h) AS BIGINT) AS hour_s, value FROM r WHERE k = 1""",
)
def target_read(spark, sf):
    rows = table(spark, sf, "events").filter("event_type = 'purchase'").select(
        "user_id", "event_id", "value",
        F.concat_ws(" ", F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "HH:00:00")).alias("stamp"),
    )
    parsed = rows.withColumn("t", v.epoch_micros(v.parse_wall_clock(F.col("stamp"))))
    first = clean.dedupe_first(parsed.select("user_id", "t", "event_id", "value"), ["user_id", "t"], ["event_id"])
    return first.select("user_id", F.expr("t div 1000000").alias("hour_s"), "value")


# ---------------------------------------------------------------- segments
def segment_table(spark, sf):
    """Each embedding as one segment: its numbers stand for the samples of every channel."""
    base = table(spark, sf, "embeddings")
    x = F.transform("embedding", lambda e: e.cast("double"))
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 300)
    times = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.timestamp_micros((F.lit(1704067200) + F.col("vec_id") * 300) * 1000000 + i * 100000))
    return base.select(
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("subject_id"),
        F.col("vec_id").alias("segment_no"), start.alias("Timestamp"),
        F.when(F.col("vec_id") % 11 != 0, 100 + 50 * x[0]).alias("glucose"),
        F.struct(
            F.struct(times.alias("Time"), x.alias("BreathingWaveform")).alias("Breathing"),
            F.struct(times.alias("Time"), x.alias("Vertical"), F.transform(x, lambda e: e * 2).alias("Lateral"), F.slice(x, 1, 60).alias("Sagittal")).alias("Accel"),
            F.struct(times.alias("Time"), x.alias("HR")).alias("Summary"),
        ).alias("zephyr"),
        F.struct(
            F.struct(times.alias("Time"), x.alias("EDA")).alias("EDA"),
            F.struct(times.alias("Time"), x.alias("BVP")).alias("BVP"),
            F.struct(times.alias("Time"), x.alias("TEMP")).alias("TEMP"),
        ).alias("e4"),
    )


SEG_SQL = """s AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings WHERE vec_id % 11 <> 0)"""


@query(
    "segment_inventory",
    """SELECT 's' || label AS subject_id, count(*) AS segments FROM embeddings WHERE vec_id % 11 <> 0 GROUP BY 1
       UNION ALL SELECT 'total', count(*) FROM embeddings WHERE vec_id % 11 <> 0""",
)
def segment_inventory(spark, sf):
    return segments.inventory(segments.usable_segments(segment_table(spark, sf)))


@query(
    "segment_scan",
    """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY length(CAST(vec_id AS VARCHAR)), CAST(vec_id AS VARCHAR)) AS k FROM embeddings WHERE vec_id % 11 <> 0)
       SELECT 's' || label AS subject_id, vec_id AS segment_no FROM r WHERE k <= 7""",
)
def segment_scan(spark, sf):
    scanned = segments.usable_segments(segment_table(spark, sf)).select("subject_id", "segment_no")
    return segments.limit_segments(scanned, 7)


@query(
    "segment_array_stats",
    f"""WITH {SEG_SQL}, z AS (SELECT vec_id, {STATS_SQL} FROM s GROUP BY vec_id)
        SELECT vec_id, {rounded_sql(STATS)} FROM z""",
)
def segment_array_stats(spark, sf):
    out = segments.segment_features(segment_table(spark, sf))
    return out.select(F.col("segment_no").alias("vec_id"), *[(F.round(F.col(f"eda_{c}") + NUDGE, 5) + 0.0).alias(c) for c in STATS])


@query(
    "segment_tonic",
    f"""WITH {SEG_SQL}, m AS (SELECT a.vec_id, a.pos, a.value, avg(b.value) AS tonic FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.pos <= a.pos + 3 AND b.pos > a.pos + 3 - 8 GROUP BY ALL)
        SELECT vec_id, round(avg(tonic), 6) + 0.0 AS tonic_mean, round(stddev_pop(value - tonic), 6) AS phasic_std, round(max(abs(value - tonic)), 6) AS phasic_max FROM m GROUP BY 1""",
)
def segment_tonic(spark, sf):
    out = segments.segment_features(segment_table(spark, sf))
    return out.select(
        F.col("segment_no").alias("vec_id"), (F.round("eda_tonic_mean", 6) + 0.0).alias("tonic_mean"),
        F.round("eda_phasic_std", 6).alias("phasic_std"), F.round("eda_phasic_max", 6).alias("phasic_max"),
    )


@query(
    "segment_movement_spectrum",
    f"""WITH {SEG_SQL}, a AS (SELECT vec_id, pos, CASE WHEN pos < 60 THEN sqrt(value * value + 4 * value * value + value * value) END AS m FROM s),
        n AS (SELECT vec_id, pos, m, count(*) OVER w AS n, avg(m) OVER w AS mu, stddev_pop(m) OVER w AS sd, lag(m) OVER (PARTITION BY vec_id ORDER BY pos) AS pm FROM a WHERE m IS NOT NULL WINDOW w AS (PARTITION BY vec_id))
        SELECT vec_id, round(sqrt(avg(m * m)), 6) AS rms, round(avg(abs(m - mu)), 6) AS mad, round(avg(CASE WHEN m > mu + 0.5 * sd THEN 1.0 ELSE 0.0 END), 6) AS active_fraction,
               round(avg(CASE WHEN pm IS NULL THEN NULL WHEN (m - mu < 0) <> (pm - mu < 0) THEN 1.0 ELSE 0.0 END), 6) AS zero_crossings FROM n GROUP BY 1""",
)
def segment_movement_spectrum(spark, sf):
    out = segments.segment_features(segment_table(spark, sf))
    return out.select(F.col("segment_no").alias("vec_id"), *[F.round(f"accel_{c}", 6).alias(c) for c in MOVE])


WELCH_SQL = f"""{SEG_SQL}, g AS (SELECT vec_id, pos, (value - avg(value) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * pos / 64)) AS y FROM s),
  k AS (SELECT i FROM range(33) r(i)),
  f AS (SELECT vec_id, i, i * 10.0 / 64 AS hz, power(sum(y * cos(2 * pi() * i * pos / 64)), 2) + power(sum(y * sin(2 * pi() * i * pos / 64)), 2) AS p FROM g, k GROUP BY vec_id, i),
  d AS (SELECT vec_id, i, hz, p / (10.0 * 24.0) * CASE WHEN i IN (0, 32) THEN 1 ELSE 2 END AS psd FROM f)"""


@query(
    "welch_bands",
    f"""WITH {WELCH_SQL}, t AS (SELECT *, psd / sum(psd) OVER (PARTITION BY vec_id) AS share, lag(psd) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM d)
        SELECT vec_id, arg_max(hz, psd) AS dominant_freq_hz, round(-sum(CASE WHEN share > 1e-12 THEN share * ln(share) END) / ln(count(*) FILTER (share > 1e-12)), 5) AS spectral_entropy,
               round(sum(CASE WHEN hz >= 0.5 AND hz < 3 AND hz - 10.0 / 64 >= 0.5 THEN (psd + before) / 2 * 10.0 / 64 END), 6) AS power_walk,
               round(sum(CASE WHEN hz >= 3 AND hz < 8 AND hz - 10.0 / 64 >= 3 THEN (psd + before) / 2 * 10.0 / 64 END), 6) AS power_fast FROM t GROUP BY 1""",
)
def welch_bands(spark, sf):
    rows = table(spark, sf, "embeddings").filter("vec_id % 11 <> 0").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    samples = rows.select("vec_id", (F.col("pos").cast("long") * 100000).alias("t"), "value", F.lit(10.0).alias("fs"))
    out = spectral.spectral_features(samples, "accel", ["vec_id"], "t", "value", 60 * v.MICROS, 60 * v.MICROS)
    return out.select(
        "vec_id", "dominant_freq_hz", F.round("spectral_entropy", 5).alias("spectral_entropy"),
        F.round("power_walk", 6).alias("power_walk"), F.round("power_fast", 6).alias("power_fast"),
    )


@query("segment_waves")
def segment_waves(spark, sf):
    return segments.segment_features(segment_table(spark, sf)).select(
        "subject_id", "segment_no", "resp_rate_bpm", "resp_band_power", "accel_dominant_freq_hz", "ppg_pulse_rate_bpm"
    )


@query("breathing_windows")
def breathing_windows(spark, sf):
    samples = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", (F.col("pos").cast("long") * 250000).alias("t"), "value", F.lit(4.0).alias("fs")
    )
    return spectral.spectral_features(samples, "breathing", ["vec_id"], "t", "value", 60 * v.MICROS, 60 * v.MICROS)


@query("hrv_spectrum_windows")
def hrv_spectrum_windows(spark, sf):
    rr = events_us(spark, sf).select("user_id", "t", "event_id", (F.col("value") * 10).alias("rr"), F.lit(1.0).alias("fs"))
    return spectral.spectral_features(rr, "rr", ["user_id"], "t", "rr", 16 * DAY, 16 * DAY, "event_id")


@query("beat_detection")
def beat_detection(spark, sf):
    """Each series of embeddings with one label, end to end at 250 Hz."""
    rows = table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("pos", "value"))
    samples = rows.select(
        "label", ((F.col("vec_id") * 64 + F.col("pos")) * 4000).alias("t"), "value", F.lit(250.0).alias("fs")
    )
    return spectral.beats(samples, ["label"], "t", "value", 1800 * v.MICROS, 1800 * v.MICROS)


@query("ecg_band_windows")
def ecg_band_windows(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("pos", "value"))
    samples = rows.select(
        "label", ((F.col("vec_id") * 64 + F.col("pos")) * 4000).alias("t"), "value", F.lit(250.0).alias("fs")
    )
    return spectral.spectral_features(samples, "ecg", ["label"], "t", "value", 1800 * v.MICROS, 1800 * v.MICROS)


@query("pulse_windows")
def pulse_windows(spark, sf):
    samples = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", (F.col("pos").cast("long") * 125000).alias("t"), "value", F.lit(8.0).alias("fs")
    )
    return spectral.spectral_features(samples, "bvp", ["vec_id"], "t", "value", 60 * v.MICROS, 60 * v.MICROS)


@query(
    "segment_pairs",
    """WITH g AS (SELECT label, vec_id, 100 + 50 * CAST(embedding[1] AS DOUBLE) AS now FROM embeddings WHERE vec_id % 11 <> 0),
            l AS (SELECT label, vec_id, lead(vec_id, 2) OVER w AS v2, lead(now, 2) OVER w AS target FROM g WINDOW w AS (PARTITION BY label ORDER BY vec_id))
       SELECT 's' || label AS subject_id, vec_id AS segment_no, round(target, 5) AS target FROM l WHERE (v2 - vec_id) * 5 <= 2 * 5 + 100""",
)
def segment_pairs(spark, sf):
    flat = segments.usable_segments(segment_table(spark, sf)).select(
        "subject_id", "segment_no", v.epoch_micros(F.col("Timestamp")).alias("t"), "glucose"
    )
    pairs = asof.horizon_pairs(flat, ["subject_id"], "t", "glucose", 2, 5.0, 100.0, tie="segment_no")
    return pairs.select("subject_id", "segment_no", F.round("target", 5).alias("target"))
