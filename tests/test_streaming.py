"""Streams against the batch operators over the same rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators import asof, windows
from tidemark.streaming import twins

HOUR = 3600 * v.MICROS


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    seconds = sorted(rng.uniform(0, 40 * 3600) for _ in range(500))
    pdf = pd.DataFrame({"i": range(500), "k": [rng.randrange(3) for _ in range(500)], "x": [rng.choice([float("nan"), rng.gauss(0, 1), 1.0]) if i % 9 == 0 else rng.gauss(0, 1) for i in range(500)], "s": seconds})
    return spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros((F.col("s") * v.MICROS).cast("long"))).drop("s").cache()


def micros(table, *names):
    return table.withColumns({c: F.unix_micros(c) for c in names})


def play(rows, build, delay, late=0):
    """Four instalments by time of arrival; every seventh row comes ``late`` seconds late."""
    arrival = F.least(F.lit(3), F.floor((F.unix_seconds("ts") + F.when(F.col("i") % 7 == 0, late).otherwise(0)) / (10 * 3600)).cast("int"))
    return twins.replay(rows, arrival, 4, lambda folder: build(twins.event_stream(rows.sparkSession, folder, rows, "ts", delay)))


def test_closed_windows_equal_the_batch_and_their_state_is_dropped(spark, rows):
    got, progress = play(rows, lambda s: twins.window_stats(s, ["k"], "ts", "x", "4 hours", "1 hour", "i"), "3 hours", late=3600)
    mark = rows.agg(F.max(F.unix_millis("ts"))).first()[0] * 1000 - 3 * HOUR
    batch = windows.basic_stats(micros(rows, "ts"), ["k"], "ts", "x", 4 * HOUR, HOUR, "i").where(F.col("window_end") <= mark)
    names = ["k", "window_start", "n", *twins.STATS]
    a, b = (t.select(names).toPandas().sort_values(["k", "window_start"]).reset_index(drop=True) for t in (micros(got, "window_start"), batch))
    assert len(a) > 80
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    every = windows.sliding(micros(rows, "ts"), "ts", 4 * HOUR, HOUR).select("k", "window_start").distinct().count()
    assert held[-1] < 0.3 * every and sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress if p.stateOperators) == 0


def test_rows_behind_the_watermark_are_dropped(rows):
    got, progress = play(rows, lambda s: twins.window_stats(s, ["k"], "ts", "x", "4 hours", "1 hour", "i"), "1 hour", late=12 * 3600)
    batch = windows.basic_stats(micros(rows, "ts"), ["k"], "ts", "x", 4 * HOUR, HOUR, "i")
    both = micros(got, "window_start").select("k", "window_start", F.col("n").alias("m")).join(batch, ["k", "window_start"])
    assert both.where("m > n").isEmpty() and both.where("m < n").count() > 10
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress if p.stateOperators) > 10


def test_sessions_equal_islands(spark, rows):
    length = (F.col("i") % 11) * 90
    got, _ = play(rows, lambda s: twins.sessions(s, ["k"], "ts", length), "3 hours", late=3600)
    mark = rows.agg(F.max(F.unix_millis("ts"))).first()[0] * 1000 - 3 * HOUR
    spans = micros(rows, "ts").where(length > 0).withColumn("end", F.col("ts") + length * v.MICROS)
    batch = asof.session_bounds(asof.session_islands(spans, ["k"], "ts", "end", "i"), ["k"], "ts", "end").where(F.col("session_end") <= mark).drop("session")
    a = micros(got, "session_start", "session_end")
    assert a.count() > 50 and a.exceptAll(batch.select(a.columns)).isEmpty() and batch.select(a.columns).exceptAll(a).isEmpty()


def test_horizon_join_equals_the_batch_join(spark, rows):
    def build(s):
        targets = s.where("i % 4 = 0").select("k", F.col("i").alias("j"), F.col("ts").alias("target_ts"))
        return twins.horizon_join(s.where("i % 4 <> 0").select("k", "i", "ts"), targets, ["k"], "ts", "target_ts", "30 MINUTES", "90 MINUTES")

    got, progress = play(rows, build, "3 hours", late=3600)
    batch = build(rows)
    assert batch.count() > 200 and got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()
    assert progress[-1].stateOperators[0].numRowsTotal < 250
