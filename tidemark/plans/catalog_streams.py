"""Queries that run as streams over the event table, with the SQL of their batch twins.

A tenth of the events arrive four days late. They come in three instalments of twelve days of
arrival; what has been written when the stream has seen all of them is the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.plans.catalog_windows import DAY, E_SQL, STATS, STATS_SQL, rounded, rounded_sql, windows_sql
from tidemark.plans.registry import query, table
from tidemark.streaming import twins

LATE_DAYS, SLICE_DAYS, SLICES = 4, 12, 3
ARRIVAL_SQL = f"""{E_SQL}, a AS (SELECT *, least({SLICES - 1}, (t - (SELECT min(t) FROM e) + CASE WHEN event_id % 10 = 0 THEN {LATE_DAYS * DAY} ELSE 0 END) // {SLICE_DAYS * DAY}) AS slice FROM e)"""
#: Microseconds the watermark stands at, in whole milliseconds, after all slices and before each.
MARKS_SQL = """last AS (SELECT (max(t) // 1000) * 1000 - {delay} AS mark FROM a),
        marks AS (SELECT s AS slice, (SELECT (max(t) // 1000) * 1000 - {delay} FROM a WHERE slice < s) AS mark FROM range({slices}) r(s))"""


def marks_sql(delay: int) -> str:
    return MARKS_SQL.format(delay=delay, slices=SLICES)


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def arrival(rows):
    begin = rows.agg(F.min(F.unix_micros("ts"))).first()[0] or 0
    late = F.when(F.col("event_id") % 10 == 0, LATE_DAYS * DAY).otherwise(0)
    return F.least(F.lit(SLICES - 1), F.floor((F.unix_micros("ts") - begin + late) / (SLICE_DAYS * DAY)).cast("int"))


def streamed(spark, sf, build, delay: str):
    rows = events(spark, sf)
    return twins.replay(rows, arrival(rows), SLICES, lambda folder: build(twins.event_stream(spark, folder, rows, "ts", delay)))[0]


#: Copies of rows in windows that were still open when they came, and windows closed in the end.
OPEN_SQL = f"""{ARRIVAL_SQL}, {marks_sql(DAY)}, {windows_sql(2 * DAY, DAY, 'a')},
        o AS (SELECT w.* FROM w JOIN marks m USING (slice), last WHERE (m.mark IS NULL OR window_start + {2 * DAY} > m.mark) AND window_start + {2 * DAY} <= last.mark)"""


def stats_stream(spark, sf):
    return streamed(spark, sf, lambda s: twins.window_stats(s, ["user_id"], "ts", "value", "2 days", "1 day", "event_id"), "1 day")


@query(
    "stream_window_stats",
    f"""WITH {OPEN_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY t, event_id) - 1 AS pos FROM o),
        s AS (SELECT user_id, window_start, {STATS_SQL} FROM p GROUP BY user_id, window_start)
        SELECT user_id, CAST(window_start // 1000000 AS BIGINT) AS window_s, n, {rounded_sql(STATS)} FROM s WHERE n >= 3""",
)
def stream_window_stats(spark, sf):
    """Sliding-window statistics under a watermark of one day; windows it has passed."""
    return stats_stream(spark, sf).select("user_id", F.unix_seconds("window_start").alias("window_s"), "n", *rounded(STATS))


@query(
    "stream_late_rows",
    f"""WITH {OPEN_SQL}, every AS (SELECT user_id, window_start, count(*) AS n_all FROM w, last WHERE window_start + {2 * DAY} <= last.mark GROUP BY 1, 2),
        kept AS (SELECT user_id, window_start, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT CAST(window_start // 1000000 AS BIGINT) AS window_s, CAST(sum(n_all) AS BIGINT) AS n_all, CAST(sum(n_all - n) AS BIGINT) AS n_late FROM kept JOIN every USING (user_id, window_start) GROUP BY 1""",
)
def stream_late_rows(spark, sf):
    """Rows that came after their window was closed, by window, over the windows written."""
    t = F.unix_micros("ts")
    last = t - F.pmod(t, F.lit(DAY))
    copies = events(spark, sf).withColumn("start", F.explode(F.array(last, last - DAY)))
    every = copies.groupBy("user_id", "start").agg(F.count("*").alias("n_all"))
    kept = stats_stream(spark, sf).select("user_id", F.unix_micros("window_start").alias("start"), "n")
    return kept.join(every, ["user_id", "start"]).groupBy((F.col("start") / v.MICROS).cast("long").alias("window_s")).agg(
        F.sum("n_all").alias("n_all"), F.sum(F.col("n_all") - F.col("n")).alias("n_late")
    )


@query(
    "stream_sessions",
    f"""WITH {ARRIVAL_SQL}, {marks_sql(5 * DAY)}, sp AS (SELECT user_id, event_id, t AS s, t + CAST(round(value * 600 * 1000000) AS BIGINT) AS f FROM a WHERE value > 0),
        r AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
        k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS session FROM r),
        b AS (SELECT user_id, session, min(s) AS session_start, max(f) AS session_end, count(*) AS spans FROM k GROUP BY 1, 2)
        SELECT user_id, session_start, session_end, spans FROM b, last WHERE session_end <= mark""",
)
def stream_sessions(spark, sf):
    """Recording sessions merged in state, under a watermark that no row is later than."""
    found = streamed(spark, sf, lambda s: twins.sessions(s, ["user_id"], "ts", F.round(F.col("value") * 600 * v.MICROS) / v.MICROS), "5 days")
    return found.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "spans")


@query(
    "stream_horizon_targets",
    f"""WITH {E_SQL} SELECT s.event_id, p.event_id AS target_id, p.value AS target, round((p.t - s.t) / 60e6, 4) AS elapsed_min
        FROM e s JOIN e p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND s.event_type <> 'purchase' AND p.t BETWEEN s.t + {DAY // 4} AND s.t + {DAY // 2}""",
)
def stream_horizon_targets(spark, sf):
    """Signals with the purchases six to twelve hours later, joined as two streams."""

    def build(stream):
        signals = stream.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
        targets = stream.where("event_type = 'purchase'").select(F.col("event_id").alias("target_id"), "user_id", F.col("value").alias("target"), F.col("ts").alias("target_ts"))
        return twins.horizon_join(signals, targets, ["user_id"], "ts", "target_ts", "6 HOURS", "12 HOURS")

    found = streamed(spark, sf, build, "5 days")
    elapsed = (F.unix_micros("target_ts") - F.unix_micros("ts")) / F.lit(60e6)
    return found.select("event_id", "target_id", "target", F.round(elapsed, 4).alias("elapsed_min"))
