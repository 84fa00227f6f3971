"""Grouped spectral jobs over windows of long signals.

A group is one series in one window. Its size is bounded by window length times sampling
rate; the bound is checked by an aggregate before any group is handed to Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import signals as s
from tidemark.functions import values as v
from tidemark.operators.windows import sliding

MAX_RATE_HZ = 1_000.0

FEATURES = {
    "breathing": ("rate_bpm", "interval_std", "interval_cv", "n_breaths", "dominant_freq_hz", "band_power"),
    "accel": ("dominant_freq_hz", "spectral_entropy", "power_walk", "power_fast"),
    "ecg": ("total_power", "bandpower_0.5_4hz", "bandpower_0.5_4hz_rel", "bandpower_4_15hz", "bandpower_4_15hz_rel", "bandpower_15_40hz", "bandpower_15_40hz_rel"),
    "rr": ("vlf_power", "lf_power", "hf_power", "total_power", "lf_hf_ratio", "lf_nu", "hf_nu"),
    "bvp": ("pulse_rate_bpm", "pri_sdnn", "n_pulses"),
}
FUNCTIONS = {
    "breathing": s.breathing, "accel": s.movement_spectrum, "ecg": s.ecg_bands, "bvp": s.pulse,
    "rr": lambda x, fs: s.hrv_spectrum(x),
}


def check_groups(windows: DataFrame, keys: Sequence[str], size_us: int) -> None:
    """Refuse windows holding more samples than any sensor can deliver in their length."""
    bound = int(size_us / 1e6 * MAX_RATE_HZ)
    worst = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if worst is not None and worst > bound:
        raise ValueError(f"a window holds {worst} samples, more than {MAX_RATE_HZ:g} Hz can give")


def window_arrays(
    df: DataFrame, series: Sequence[str], t: str, value: str, size_us: int, step_us: int,
    tie: str | None, wanted: DataFrame | None,
) -> DataFrame:
    """One row per series and window: samples in time order as an array, and the rate."""
    order = [t] + ([tie] if tie else [])
    narrow = df.select(*series, *order, v.finite(F.col(value)).alias(value), "fs").filter(F.col(value).isNotNull())
    windows = sliding(narrow, t, size_us, step_us, wanted)
    keys = [*series, "window_start"]
    check_groups(windows, keys, size_us)
    sample = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_x"))))
    return windows.groupBy(*keys).agg(
        F.transform(sample, lambda s: s["_x"]).alias("_samples"), F.max("fs").alias("_fs")
    )


def spectral_features(
    df: DataFrame,
    kind: str,
    series: Sequence[str],
    t: str,
    value: str,
    size_us: int,
    step_us: int,
    tie: str | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Spectral and peak features per series and window; needs a column ``fs``."""
    series, names, compute = list(series), FEATURES[kind], FUNCTIONS[kind]
    arrays = window_arrays(df, series, t, value, size_us, step_us, tie, wanted)
    keys = [*series, "window_start"]
    schema = arrays.select(*keys).schema
    for name in names:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                compute(np.asarray(x, dtype=float), float(fs)) if len(x) >= 5 else {}
                for x, fs in zip(batch["_samples"], batch["_fs"])
            ]
            more = pd.DataFrame(found, index=batch.index).reindex(columns=list(names)).astype(float)
            yield pd.concat([batch[keys], more], axis=1)

    out = arrays.mapInPandas(run, schema)
    return out.select(*keys, *[v.finite(F.col(f"`{n}`")).alias(n) for n in names])


def beats(
    df: DataFrame, series: Sequence[str], t: str, value: str, size_us: int, step_us: int,
    tie: str | None = None, wanted: DataFrame | None = None,
) -> DataFrame:
    """Beat intervals detected in each window of a waveform, one row per beat."""
    series = list(series)
    arrays = window_arrays(df, series, t, value, size_us, step_us, tie, wanted)
    keys = [*series, "window_start"]
    schema = arrays.select(*keys).schema.add("_rr", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [s.beat_intervals(np.asarray(x, dtype=float), float(fs)) for x, fs in zip(batch["_samples"], batch["_fs"])]
            yield batch[keys].assign(_rr=[[] if rr is None else rr.tolist() for rr in found])

    return arrays.mapInPandas(run, schema).select(*keys, F.posexplode("_rr").alias("beat", "rr"))
