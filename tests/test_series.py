"""Windows, targets, sessions and signal features against direct computation."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import signals as s
from tidemark.functions import values as v
from tidemark.operators import asof, clean, spectral, windows
from tidemark.plans import experiments
from tidemark.session import cut_lineage
from tidemark.sources import sensors


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    n = 2500
    user = np.where(rng.random(n) < 0.35, 1, rng.integers(0, 12, n))
    pdf = pd.DataFrame({"id": np.arange(n), "u": user, "t": rng.integers(0, 86_400_000_000, n), "x": rng.normal(50, 10, n)})
    return spark.createDataFrame(pdf).cache(), pdf


HOUR = 3_600_000_000


def test_window_stats_do_not_depend_on_chunks(series):
    df, pdf = series
    plain = windows.basic_stats(df, ["u"], "t", "x", 4 * HOUR, HOUR, "id").toPandas().sort_values(["u", "window_start"])
    chunked = windows.basic_stats(df, ["u"], "t", "x", 4 * HOUR, HOUR, "id", rows_per_chunk=200).toPandas().sort_values(["u", "window_start"])
    pd.testing.assert_frame_equal(plain.reset_index(drop=True), chunked.reset_index(drop=True))
    row = plain.iloc[len(plain) // 2]
    part = pdf[(pdf.u == row.u) & (pdf.t >= row.window_start) & (pdf.t < row.window_end)].sort_values(["t", "id"])
    want = s.basic_stats(part["x"].to_numpy())
    for name, value in want.items():
        assert row[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name
    assert row["slope"] == pytest.approx(np.polyfit(np.arange(len(part)), part["x"], 1)[0], abs=1e-9)


def test_interpolation_equals_numpy(series):
    df, pdf = series
    rng = np.random.default_rng(3)
    probes = pd.DataFrame({"u": rng.integers(0, 12, 400), "at": rng.integers(0, 90_000_000_000, 400), "k": range(400)})
    target = df.groupBy("u", "t").agg(F.min("x").alias("x"))
    pt = target.toPandas()
    for size in (None, 100):
        got = asof.interpolate_at(df.sparkSession.createDataFrame(probes), target, ["u"], "at", "t", "x", HOUR // 12, rows_per_chunk=size)
        got = got.toPandas().sort_values("k")["target"].to_numpy()
        for (u, at, k), value in zip(probes.itertuples(index=False), got):
            one = pt[pt.u == u].sort_values("t")
            times = one["t"].to_numpy()
            inside = times[0] <= at <= times[-1] and np.abs(times - at).min() <= HOUR // 12
            want = np.interp(at, times, one["x"]) if inside else np.nan
            np.testing.assert_allclose(value, want)


def test_sessions_merge_touching_spans(spark):
    rows = [("a", 1, 0, 10), ("a", 2, 10, 20), ("a", 3, 5, 6), ("a", 4, 25, 30), ("b", 5, 0, 1)]
    df = spark.createDataFrame(rows, "k string, id int, s long, e long")
    for size in (None, 1):
        got = asof.session_islands(df, ["k"], "s", "e", "id", rows_per_chunk=size)
        assert {r["id"]: r["session"] for r in got.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}


def test_horizon_pairs_drop_gaps(spark):
    minute = 60_000_000
    rows = [("a", i, i * 5 * minute + (60 * minute if i >= 10 else 0), float(i)) for i in range(14)]
    df = spark.createDataFrame(rows, "k string, id int, t long, x double")
    got = asof.horizon_pairs(df, ["k"], "t", "x", 6, rows_per_chunk=None).toPandas()
    assert sorted(got["id"]) == [0, 1, 2, 3]
    assert (got["target"] == got["x"] + 6).all()


def test_movement_and_hrv_do_not_depend_on_chunks(series):
    df, _ = series
    for fn, value in ((windows.movement, "x"), (windows.hrv_time, "rr")):
        data = df.withColumn("rr", F.col("x") * 15)
        a = fn(data, ["u"], "t", value, 12 * HOUR, 6 * HOUR, "id").toPandas().sort_values(["u", "window_start"]).reset_index(drop=True)
        b = fn(data, ["u"], "t", value, 12 * HOUR, 6 * HOUR, "id", rows_per_chunk=150).toPandas().sort_values(["u", "window_start"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(a, b)


def test_tonic_equals_pandas_rolling(series):
    df, pdf = series
    got = windows.tonic_phasic(df, ["u"], ["t", "id"], "x", rows_per_chunk=300).toPandas().set_index("u")
    x = pdf[pdf.u == 1].sort_values(["t", "id"])["x"].reset_index(drop=True)
    tonic = x.rolling(max(3, len(x) // 8), min_periods=1, center=True).mean()
    assert got.loc[1, "tonic_mean"] == pytest.approx(tonic.mean())
    assert got.loc[1, "phasic_std"] == pytest.approx((x - tonic).std(ddof=0))


# ---------------------------------------------------------------- ground truth
@pytest.mark.parametrize("bpm", [10, 15, 20])
def test_breathing_rate(bpm):
    t = np.arange(0, 180, 1 / 25)
    x = np.sin(2 * np.pi * bpm / 60 * t) + np.random.default_rng(0).normal(0, 0.15, t.size)
    assert s.breathing(x, 25.0)["rate_bpm"] == pytest.approx(bpm, abs=1)


def ecg(seconds=30, fs=250.0):
    t = np.arange(0, seconds, 1 / fs)
    x = np.random.default_rng(1).normal(0, 0.02, t.size)
    for beat in np.arange(0.4, seconds, 0.8):
        x += np.exp(-((t - beat) ** 2) / (2 * 0.012**2))
    return x


def test_beats_from_waveform():
    rr = s.beat_intervals(ecg(), 250.0)
    assert rr.mean() == pytest.approx(800, abs=20)
    assert s.beat_intervals(ecg(), 1.0) is None


def test_variability_sanity():
    rr = np.random.default_rng(2).normal(800, 40, 400)
    out = s.hrv(rr)
    assert out["mean_rr"] == pytest.approx(800, abs=15) and out["mean_hr"] == pytest.approx(75, abs=3)
    assert "lf_hf_ratio" in out and s.hrv(np.array([800.0, 810, 790])) == {}


def test_filter_blocks_match_direct_recursion():
    b, a = s.butterworth([5.0, 15.0], 250.0)
    x = np.random.default_rng(3).normal(size=700)
    out, past_x, past_y = [], [0.0] * 5, [0.0] * 5
    for value in x:
        past_x = [value, *past_x[:4]]
        y = float(np.dot(b, past_x) - np.dot(a[1:], past_y[:4]))
        past_y = [y, *past_y[:4]]
        out.append(y)
    np.testing.assert_allclose(s._recursive(b, a, x, np.zeros(4)), out, atol=1e-10)
    w = np.exp(-2j * np.pi * np.array([1.0, 8.66, 60.0]) / 250)
    gain = np.abs(np.polyval(b, 1 / w) / np.polyval(a, 1 / w))
    assert gain[1] > 0.99 and gain[0] < 0.1 and gain[2] < 0.1


def test_spectral_job_finds_the_frequency(spark):
    t = np.arange(0, 60, 1 / 50)
    pdf = pd.DataFrame({"k": "a", "t": (t * 1e6).astype("int64"), "x": 1 + 0.3 * np.sin(2 * np.pi * 1.5 * t), "fs": 50.0})
    out = spectral.spectral_features(spark.createDataFrame(pdf), "accel", ["k"], "t", "x", 60_000_000, 60_000_000).first()
    assert out["dominant_freq_hz"] == pytest.approx(1.5, abs=0.11)
    with pytest.raises(ValueError):
        crowded = spark.createDataFrame(pdf.assign(t=pdf.t // 30_000))
        spectral.spectral_features(crowded, "accel", ["k"], "t", "x", 1_000_000, 1_000_000)


def test_units(spark):
    rows = [("m", 5.0), ("m", 7.5), ("m", 10.0), ("g", 90.0), ("g", 135.0), ("g", 180.0)]
    out = clean.normalise_units(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").toPandas()
    assert sorted(out[out.k == "g"].x) == [90, 135, 180]
    assert out[out.k == "m"].x.min() == pytest.approx(90.1, abs=0.5)


# ---------------------------------------------------------------- sensor tree
def write_tree(root):
    rng = np.random.default_rng(4)
    start = dt.datetime(2014, 10, 1, 6, 0, 0)
    for subject in ("001", "002"):
        cohort = "diabetes" if subject == "001" else "healthy"
        folder = root / f"{cohort}_subset_sensor_data" / subject / "sensor_data" / "2014_10_01-06_00_00"
        folder.mkdir(parents=True)
        stamp = "2014_10_01-06_00_00"
        seconds = np.arange(0, 7200, 20)
        clock = [(start + dt.timedelta(seconds=int(x))).strftime("%d/%m/%Y %H:%M:%S.000") for x in seconds]
        pd.DataFrame({"Time": clock, "HR": 70 + rng.normal(0, 2, seconds.size), " BR ": 15.0}).to_csv(folder / f"{stamp}_Summary.csv", index=False)
        beats = np.cumsum(rng.normal(5000, 100, 1400)) / 1000
        clock = [(start + dt.timedelta(seconds=float(x))).strftime("%d/%m/%Y %H:%M:%S.%f")[:-3] for x in beats]
        pd.DataFrame({"Time": clock, "RR": rng.normal(800, 40, beats.size)}).to_csv(folder / f"{stamp}_RR.csv", index=False)
        # No clock: times follow from the folder stamp and the nominal rate.
        pd.DataFrame({"X": rng.normal(0, 1, 9000), "Y": 1.0, "Z": 2.0}).to_csv(folder / f"{stamp}_Accel.csv", index=False)
        target = root / f"{cohort}_subset_pictures" / subject
        target.mkdir(parents=True)
        times = [start + dt.timedelta(minutes=5 * i) for i in range(48)]
        pd.DataFrame({
            "date": [t.strftime("%d/%m/%Y") for t in times], "time": [t.strftime("%H:%M:%S") for t in times],
            "type": "cgm", "glucose": 5 + np.arange(48) / 48,
        }).to_csv(target / "glucose.csv", index=False)


def test_sensor_tree_to_windows(spark, tmp_path):
    write_tree(tmp_path)
    files = sensors.discover(spark, str(tmp_path))
    inventory = {r["subject_id"]: r for r in sensors.inventory(files).collect()}
    assert set(inventory) == {"001", "002"} and all(r["usable"] for r in inventory.values())
    assert inventory["001"]["cohort"] == "diabetes"
    targets = sensors.read_targets(spark, files)
    assert targets.count() == 96
    signals = sensors.read_signals(spark, files, ["accel"])
    first = signals.agg(F.min("t_us"), F.max("t_us")).first()
    assert first[0] == 1412143200 * v.MICROS and first[1] - first[0] == 8999 * 10_000
    built = cut_lineage(experiments.sensor_windows(spark, str(tmp_path)))
    out = built.toPandas()
    assert set(out.subject_id) == {"001", "002"}
    # The session lasts 7180 s, so starts run from minute 0 to 80.
    assert len(out) == 18
    assert out["sum_hr_mean"].between(68, 72).all() and out["hrv_mean_rr"].between(780, 820).all()
    assert out["target"].between(90, 110).all()
    assert ((out.window_end - out.window_start) == 30 * 60 * v.MICROS).all()
    # 90 s of movement at 100 Hz fall into the first window of each subject only.
    assert out["accel_rms"].notna().sum() == out["accel_mean"].notna().sum() == 2
    pruned, kept = experiments.prune_and_fill(
        built, [c for c in out.columns if c.startswith(("sum", "accel"))], fit_on="all"
    )
    assert "sum_hr_mean" in kept and "accel_rms" not in kept and pruned.count() == 18


def test_line_numbers_survive_splits(spark, tmp_path):
    folder = tmp_path / "with space+plus"
    folder.mkdir()
    for name, rows in (("a.csv", 3000), ("b.csv", 1)):
        (folder / name).write_text("\ufeffx,y\n" + "".join(f"{i},{i * 2}\n" for i in range(rows)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = sensors.numbered_lines(spark, str(folder)).cache()
        assert lines.select("path").distinct().count() == 2
        got = lines.filter(F.col("path").endswith("a.csv")).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (got["line"].str.split(",").str[0].astype(int) == got["row_pos"]).all() and len(got) == 3000
    assert set(got["head"]) == {"x,y"} and str(folder / "a.csv") in set(got["path"])


@pytest.mark.parametrize(("size", "step"), [(6, 2), (5, 2), (2, 5), (3, 3)])
def test_windows_from_panes_equal_windows_of_rows(spark, size, step):
    rng = np.random.default_rng(size * 10 + step)
    minute = 60_000_000
    t = np.sort(rng.integers(0, 300 * minute, 900))
    t[300:420] = t[300]  # a crowded pane
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 900), "i": range(900), "t": t, "x": 1e6 + rng.normal(size=900)})
    df = spark.createDataFrame(pdf)
    size, step = size * 10 * minute, step * 10 * minute
    wanted = spark.createDataFrame([(int(s),) for s in range(-size // step * step, 300 * minute, 2 * step)], "window_start long")
    want = {}
    for (k,), own in pdf.sort_values(["t", "i"]).groupby(["k"]):
        for s in range(-size // step * step, 300 * minute, step):
            x = own.x[(own.t >= s) & (own.t < s + size)].to_numpy()
            if len(x) >= 3:
                q = np.quantile(x, [0.25, 0.5, 0.75])
                d = x - x.mean()
                shaped = len(x) >= 8
                want[k, s] = (len(x), x.mean(), x.std(), q[1], q[2] - q[0], np.polyfit(np.arange(len(x)), d, 1)[0] if len(x) >= 5 else 0.0, x[-1], x[-1] - x[0], (d**3).mean() / x.std() ** 3 if shaped else None, (d**4).mean() / x.std() ** 4 - 3 if shaped else None)
    names = ("n", "mean", "std", "median", "iqr", "slope", "last", "delta", "skew", "kurtosis")
    for options in ({}, {"rows_per_chunk": 100}, {"rows_per_chunk": 250}, {"rows_per_chunk": 100, "wanted": wanted}):
        got = {(r.k, r.window_start): tuple(r[c] for c in names) for r in windows.basic_stats(df, ["k"], "t", "x", size, step, "i", **options).collect()}
        expected = {k: x for k, x in want.items() if "wanted" not in options or k[1] % (2 * step) == (-size // step * step) % (2 * step)}
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(expected[k], rel=1e-6, abs=1e-6) for k in expected)


def test_a_time_that_many_rows_share_is_one_point_and_one_probe(spark):
    target = spark.createDataFrame([("a", 100, float(i)) for i in range(200)] + [("a", 200, 5.0), ("a", 0, 1.0), (None, 100, 9.0)], "u string, t long, x double")
    rows = [("a", i, 100) for i in range(150)] + [("a", 150, 150), ("a", 151, 50), ("b", 152, 100), (None, 153, 100), ("a", 154, None)]
    probes = spark.createDataFrame(rows, "u string, i int, at long")
    few, many = ({r.i: r.target for r in asof.interpolate_at(probes, target, ["u"], "at", "t", "x", 60, rows_per_chunk=n).collect()} for n in (None, 20))
    assert few == many and len(few) == 155
    assert few[0] == few[149] == 199.0 and few[150] == (199.0 + 5.0) / 2 and few[151] == 0.5 and few[152] is few[153] is few[154] is None


def test_segments_are_worked_on_in_small_slices(spark, monkeypatch):
    from tidemark.plans.catalog_windows import segment_table
    from tidemark.sources import segments

    df = segment_table(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(segments, "SLICE_ROWS", 7)
    small = segments.segment_features(df).toPandas().sort_values("segment_no").reset_index(drop=True)
    monkeypatch.setattr(segments, "SLICE_ROWS", 10_000)
    whole = segments.segment_features(df).toPandas().sort_values("segment_no").reset_index(drop=True)
    pd.testing.assert_frame_equal(small, whole)
    assert len(small) > 7 and small.drop(columns=["subject_id", "segment_no", "ts", "glucose_now"]).notna().any().sum() > 50
