"""Nested five-minute segments: scan, inventory, row-local features.

A segment holds its signals as arrays, so its features need no shuffle: one Arrow batch
function turns the arrays of a row into numbers. A row is one five-minute segment, so the
arrays are bounded by the sensors' rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import signals as s
from tidemark.functions import values as v
from tidemark.operators.clean import top_per_key
from tidemark.session import spread

SEGMENT_MINUTES = 5.0
# Fallback sampling rates (Hz) per channel.
RATES = {"ecg": 250.0, "resp": 25.0, "accel": 100.0, "bvp": 64.0, "e4acc": 32.0}
WAVES = {
    "ecg": ("zephyr.ECG.EcgWaveform", "zephyr.ECG.Time"),
    "resp": ("zephyr.Breathing.BreathingWaveform", "zephyr.Breathing.Time"),
    "bvp": ("e4.BVP.BVP", "e4.BVP.Time"),
}
AXES = {
    "accel": (("Vertical", "Lateral", "Sagittal"), "zephyr.Accel"),
    "e4acc": (("x", "y", "z"), "e4.ACC"),
}
PLAIN = {
    **{f"sum_{c.lower()}": f"zephyr.Summary.{c}" for c in ("HR", "BR", "Posture", "Activity", "HRConfidence", "ECGNoise")},
    "eda": "e4.EDA.EDA", "temp": "e4.TEMP.TEMP", "e4hr": "e4.HR.HR",
}


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return usable_segments(spark.read.parquet(path))


def usable_segments(df: DataFrame) -> DataFrame:
    return df.filter(F.col("glucose").isNotNull() & F.col("Timestamp").isNotNull())


def natural_order(name: Column) -> list[Column]:
    """1, 2, 10 rather than 1, 10, 2: length first, then text."""
    return [F.length(name), name]


def inventory(df: DataFrame) -> DataFrame:
    each = df.groupBy("subject_id").agg(F.count(F.lit(1)).alias("segments"))
    return each.unionByName(df.agg(F.count(F.lit(1)).alias("segments")).withColumn("subject_id", F.lit("total")))


def limit_segments(df: DataFrame, per_subject: int | None) -> DataFrame:
    if not per_subject:
        return df
    name = F.col("segment_no").cast("string")
    return top_per_key(df, ["subject_id"], natural_order(name), per_subject)


def has_path(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def axis_norm(*axes: Column) -> Column:
    """Magnitude per sample, cut to the shortest axis; NULL when an axis is missing."""
    shortest = F.array_min(F.array(*[F.size(a) for a in axes]))
    squares = [F.transform(F.slice(a, F.lit(1), shortest), lambda x: x * x) for a in axes]
    total = squares[0]
    for more in squares[1:]:
        total = F.zip_with(total, more, lambda a, b: a + b)
    present = axes[0].isNotNull()
    for a in axes[1:]:
        present = present & a.isNotNull()
    return F.when(present & (shortest > 0), F.transform(total, lambda x: F.sqrt(x)))


# Outputs of the batch function, in order.
WAVE_FEATURES = (
    [f"ecg_{k}" for k in ("total_power", "bandpower_0.5_4hz", "bandpower_0.5_4hz_rel", "bandpower_4_15hz", "bandpower_4_15hz_rel", "bandpower_15_40hz", "bandpower_15_40hz_rel")]
    + [f"hrv_{k}" for k in ("mean_rr", "sdnn", "rmssd", "pnn50", "pnn20", "cvnn", "mean_hr", "n_beats", "sd1", "sd2", "sd1_sd2", "vlf_power", "lf_power", "hf_power", "total_power", "lf_hf_ratio", "lf_nu", "hf_nu")]
    + [f"resp_{k}" for k in ("rate_bpm", "interval_std", "interval_cv", "n_breaths", "dominant_freq_hz", "band_power")]
    + [f"{p}_{k}" for p in ("accel", "e4acc") for k in ("rms", "mad", "active_fraction", "zero_crossings", "dominant_freq_hz", "spectral_entropy", "power_walk", "power_fast")]
    + [f"ppg_{k}" for k in ("pulse_rate_bpm", "pri_sdnn", "n_pulses")]
    + [f"eda_{k}" for k in ("tonic_mean", "phasic_std", "phasic_max")]
)


def _movement(x: np.ndarray, fs: float) -> dict[str, float]:
    x = s.finite(x)
    if x.size < int(fs * 5) or x.size < 3:
        return {}
    centred = x - x.mean()
    flips = np.diff(np.signbit(centred).astype(int)) != 0
    return {
        "rms": float(np.sqrt((x**2).mean())), "mad": float(np.abs(centred).mean()),
        "active_fraction": float((x > x.mean() + 0.5 * x.std()).mean()),
        "zero_crossings": float(flips.mean()),
    } | s.movement_spectrum(x, fs)


def _tonic(x: np.ndarray) -> dict[str, float]:
    if x.size <= 8:
        return {}
    width = max(3, x.size // 8)
    ahead = (width - 1) // 2
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(x.size)
    hi, lo = np.minimum(x.size, at + ahead + 1), np.maximum(0, at + ahead + 1 - width)
    tonic = (total[hi] - total[lo]) / (hi - lo)
    rest = x - tonic
    return {"tonic_mean": float(tonic.mean()), "phasic_std": float(rest.std()), "phasic_max": float(np.abs(rest).max())}


def _wave_row(row: dict, use_ecg: bool) -> dict[str, float]:
    """Every feature of one segment, named ``channel_feature``."""
    out: dict[str, float] = {}

    def put(prefix: str, found: dict[str, float] | None):
        out.update({f"{prefix}_{k}": x for k, x in (found or {}).items()})

    def signal(name):
        x = row.get(name)
        return None if x is None or len(x) == 0 else np.asarray(x, dtype=float)

    waves = {"resp": s.breathing, "accel": _movement, "e4acc": _movement}
    for name in CHANNELS:
        x = signal(name)
        if x is None or (name == "ecg" and not use_ecg):
            continue
        fs = s.sampling_rate(row.get(f"{name}_t"), RATES.get(name, 1.0))
        # Waveforms shorter than their minimum length give no statistics either.
        shortest = {"ecg": 5, "resp": 10, "accel": 5, "e4acc": 5}.get(name, 0)
        if s.finite(x).size >= int(fs * shortest):
            put(name, s.basic_stats(x))
        if name in waves:
            put(name, waves[name](x, fs))
        elif name == "bvp":
            put("ppg", s.pulse(x, fs))
        elif name == "eda":
            put("eda", _tonic(x))
        elif name == "ecg":
            put("ecg", s.ecg_bands(x, fs))
            rr = s.beat_intervals(x, fs)
            put("hrv", s.hrv(rr) if rr is not None else None)
    return out


CHANNELS = (*WAVES, *AXES, *PLAIN)


def flatten(df: DataFrame) -> DataFrame:
    """Nested segment to one array column per channel, times of waveforms in microseconds."""
    columns = {}

    def clock(path: str) -> Column:
        return F.transform(F.col(path), lambda t: v.epoch_micros(t))

    for name, (values, times) in WAVES.items():
        if has_path(df, values):
            columns |= {name: F.col(values), f"{name}_t": clock(times)}
    for name, (axes, node) in AXES.items():
        if has_path(df, f"{node}.{axes[0]}"):
            columns |= {name: axis_norm(*[F.col(f"{node}.{a}") for a in axes]), f"{name}_t": clock(f"{node}.Time")}
    for name, path in PLAIN.items():
        if has_path(df, path):
            columns[name] = F.col(path)
    return df.select(
        "subject_id", "segment_no", F.col("Timestamp").alias("ts"), F.col("glucose").cast("double").alias("glucose_now"),
        *[c.alias(n) for n, c in columns.items()],
    )


#: Segments whose features a task holds at once.
SLICE_ROWS = 256


def _samples(cell: pa.ListScalar) -> np.ndarray | None:
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else None


def segment_features(df: DataFrame, use_ecg: bool = True) -> DataFrame:
    """One wide feature row per usable segment, without a shuffle of its own."""
    flat = flatten(usable_segments(spread(df)))
    if not use_ecg:
        flat = flat.drop("ecg", "ecg_t")
    keys = ["subject_id", "segment_no", "ts", "glucose_now"]
    names = [f"{c}_{k}" for c in CHANNELS if c in flat.columns for k in s.STATS] + list(WAVE_FEATURES)
    schema = flat.select(*keys).schema
    for name in names:
        schema = schema.add(name, "double")

    signals = [c for c in flat.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = np.full((len(names), part.num_rows), np.nan)
                for i in range(part.num_rows):
                    for name, x in _wave_row({c: _samples(part.column(c)[i]) for c in signals}, use_ecg).items():
                        if name in place:
                            found[place[name], i] = np.nan if x is None else x
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], *[pa.array(x) for x in found]], [*keys, *names])

    place = {name: i for i, name in enumerate(names)}
    out = flat.mapInArrow(run, schema)
    return out.select(*keys, *[v.finite(F.col(f"`{n}`")).alias(n) for n in names])
