"""The three flows end to end: table, sensor tree, segments; and the block manifest.

Order is fixed: split first, then screen, fit and search on training rows, and score the
test rows once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators import (
    asof, clean, leakage, metrics, modality, models, prep, profile, resample, search, spectral, splits, stats, windows,
)
from tidemark.session import cut_lineage
from tidemark.sources import segments, sensors, sinks

MINUTE = 60 * v.MICROS


@dataclass(frozen=True)
class TableSettings:
    domain: str = "generic"
    split: str | None = None  # None picks group, stratified or random
    test_size: float = 0.2
    gap: int = 0
    folds: int = 5
    seed: int = 42
    impute: str = "median"
    scaler: str = "standard"
    max_levels: int = 30
    drop_flagged: bool = False
    scorer: str = "linear"
    search: search.SearchSettings = search.SearchSettings()
    baselines: Sequence[str] | None = None
    trees: int = 300
    boost_rounds: int = 100
    bootstrap: int = 1000
    repeats: int = 15


def split_table(
    df: DataFrame, row_id: str, target: str, classes: bool, kind: str | None = None,
    group: str | None = None, ts: str | None = None, size: float = 0.2, gap: int = 0,
    folds: int = 5, seed: int = 42,
) -> tuple[DataFrame, str, list[str]]:
    """Outer split and inner folds of the training side, by the resolved strategy."""
    kind, notes = splits.resolve(kind or ("group" if group else "stratified" if classes else "random"), classes, group is not None)
    if kind == "time_series":
        parted = splits.time_split(df, ts or row_id, row_id, size, gap)
    elif kind == "group":
        parted = splits.group_split(df, group, size, seed)
    elif kind == "stratified":
        parted = splits.stratified_split(df, row_id, target, size, seed)
    else:
        parted = splits.random_split(df, row_id, size, seed)
    parted = cut_lineage(parted)
    train = parted.filter("split = 'train'")
    if kind == "group":
        folded = splits.group_folds(train, group, folds, seed)
    elif kind == "stratified":
        folded = splits.stratified_folds(train, row_id, target, folds, seed)
    else:
        # Expanding time folds overlap in training rows; one fold label per row is kept
        # for them too, by time blocks.
        folded = time_blocks(train, ts or row_id, row_id, folds) if kind == "time_series" else splits.random_folds(train, row_id, folds, seed)
    rest = parted.filter("split <> 'train'").withColumn("fold", F.lit(-1))
    return cut_lineage(folded.unionByName(rest)), kind, notes


def time_blocks(df: DataFrame, ts: str, row_id: str, folds: int) -> DataFrame:
    rows = df.count()
    folds = splits.fold_count(folds, rows)
    cuts = splits._time_cutoffs(df, ts, row_id, [rows * i // folds for i in range(1, folds)])
    block = sum([splits._at_or_after(ts, row_id, c).cast("int") for c in cuts], F.lit(0))
    return df.withColumn("fold", block)


def table_experiment(
    df: DataFrame, row_id: str, target: str, group: str | None = None, ts: str | None = None,
    settings: TableSettings = TableSettings(), screen: bool = True,
) -> dict[str, DataFrame]:
    """Table to report tables."""
    s, spark = settings, df.sparkSession
    out: dict[str, DataFrame] = {}
    rows = clean.drop_missing_target(df, target)
    task = profile.infer_task(rows, target)
    out["validation"] = profile.validate(rows, target)
    critical = out["validation"].filter("level = 'CRITICAL'")
    if not critical.isEmpty():
        raise ValueError("; ".join(r["message"] for r in critical.collect()))
    classes = 0
    if task == "classification":
        labels = clean.class_labels(rows, target)
        classes = len(labels)
        rows = clean.encode_labels(rows, target, "_label").drop(target).withColumnRenamed("_label", target)
        out["class_mapping"] = spark.createDataFrame([(str(x), i) for i, x in enumerate(labels)], "value string, label int")
    out["facts"] = profile.dataset_facts(rows, target, group)
    out["naive"] = profile.naive_class(rows, target) if classes else profile.naive_regression(rows, target)
    parted, kind, notes = split_table(
        rows, row_id, target, bool(classes), s.split, group, ts, s.test_size, s.gap, s.folds, s.seed
    )
    out["split"] = splits.split_summary(parted, group)
    out["notes"] = spark.createDataFrame([(kind, n) for n in notes], "split string, note string")
    if group:
        out["group_overlap"] = splits.group_overlap(parted, group)
    reserved = [c for c in (row_id, group, ts) if c]
    usable = parted.drop(*[c for c in v.datetime_columns(parted) if c not in reserved])
    if screen:
        out["leakage"] = cut_lineage(leakage.screen(usable.drop(*[c for c in (group, ts) if c and c != row_id]), target, s.domain, row_id=row_id))
        usable = leakage.apply_screen(usable, out["leakage"], s.drop_flagged)
    fitted = prep.fit_preprocessor(usable, [*reserved, target], s.impute, s.scaler, s.max_levels)
    ready = fitted.transform(usable)
    renamed = {c: f"f{i}" for i, c in enumerate(fitted.features)}
    shown = {f: c for c, f in renamed.items()}
    ready = cut_lineage(
        ready.select(row_id, target, "split", "fold", *[F.col(f"`{c}`").cast("double").alias(f) for c, f in renamed.items()])
    )
    train = ready.filter("split = 'train'")
    names = list(shown)
    found = search.search(names, search.make_scorer(s.scorer, train, names, target, classes), s.search)
    out["selected"] = sinks.selected_features(spark, [shown[f] for f in names], found.mask)
    out["history"] = search.history_table(spark, found)
    m, test = models.split_input(ready, found.selected, target, classes, seed=s.seed, trees=s.trees, boost_rounds=s.boost_rounds)
    out["baselines"] = models.run_baselines(m, test, s.baselines)
    best = models.logistic(m) if classes else models.ridge(m)
    predicted = cut_lineage(best(test))
    proba = "proba" if "proba" in predicted.columns else None
    out["predictions"] = sinks.prediction_table(predicted, target, "prediction", proba, classes, [row_id])
    if classes:
        replicates = resample.bootstrap_classification(
            predicted.withColumn(target, F.col(target).cast("double")), target, "prediction", "balanced_accuracy", s.bootstrap, s.seed
        )
    else:
        replicates = resample.bootstrap_regression(predicted, row_id, target, "prediction", "rmse", s.bootstrap, s.seed)
    out["interval"] = resample.interval(replicates, "value")

    def error(scored: DataFrame, by: list[str]) -> DataFrame:
        if classes:
            found = metrics.classification(scored.withColumn(target, F.col(target).cast("double")), target, "prediction", by)
            return found.select(*by, (1 - F.col("balanced_accuracy")).alias("value"))
        e = F.col("prediction") - F.col(target)
        return scored.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("value"))

    importance = resample.permutation_importance(test, row_id, found.selected, best, error, s.repeats, s.seed, higher_is_better=False)
    names_table = spark.createDataFrame(list(shown.items()), "feature string, name string")
    out["importance"] = importance.join(F.broadcast(names_table), "feature").drop("feature").withColumnRenamed("name", "feature")
    if classes == 2:
        held = models.out_of_fold(m, models.logistic)
        out["thresholds"] = metrics.threshold_sweep(held, target, "proba")
    numeric = [c for c in v.numeric_columns(rows, booleans=False) if c not in (*reserved, target)]
    out["describe"] = stats.describe(rows, numeric) if numeric else spark.createDataFrame([], "variable string")
    return out


# ---------------------------------------------------------------- sensor tree
@dataclass(frozen=True)
class WindowSettings:
    window_min: int = 30
    step_min: int = 10
    horizon_min: int = 30
    gap_min: float = 7.5
    use_ecg: bool = False
    cohorts: Sequence[str] | None = None
    max_subjects: int | None = None

    @property
    def size(self) -> int:
        return self.window_min * MINUTE

    @property
    def step(self) -> int:
        return self.step_min * MINUTE

    @property
    def horizon(self) -> int:
        return self.horizon_min * MINUTE


def wanted_windows(sessions: DataFrame, targets: DataFrame, s: WindowSettings) -> DataFrame:
    """Windows of every session that have a target, with it.

    Made from session bounds alone, so no signal row is read for a rejected window.
    """
    span = targets.groupBy("subject_id").agg(F.min("t_us").alias("g0"), F.max("t_us").alias("g1"))
    bounded = sessions.join(span, "subject_id")
    begin = F.greatest(F.col("session_start"), F.col("g0") - s.size)
    finish = F.least(F.col("session_end"), F.col("g1") - s.horizon)
    first = F.expr(f"cast(ceil(begin / {s.step}D) as bigint) * {s.step}")
    grid = bounded.withColumns({"begin": begin, "finish": finish}).filter(F.col("finish") > F.col("begin") + s.size).withColumn(
        "first", first
    ).filter(F.col("first") + s.size <= F.col("finish"))
    starts = grid.withColumn("window_start", F.explode(F.sequence("first", F.col("finish") - s.size, F.lit(s.step))))
    probes = starts.select(
        "subject_id", "session", "window_start", (F.col("window_start") + s.size).alias("window_end"),
        (F.col("window_start") + s.size + s.horizon).alias("target_time"),
    )
    found = asof.interpolate_at(probes, targets, ["subject_id"], "target_time", "t_us", "value", int(s.gap_min * MINUTE))
    return found.filter("target is not null")


def sensor_windows(spark: SparkSession, root: str, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """One row per window: ids, times, target and the features of every signal kind."""
    s = settings
    files = sensors.cohort_filter(sensors.discover(spark, root), s.cohorts)
    usable = sensors.inventory(files).filter("usable").select("subject_id")
    files = sensors.limit_subjects(files.join(usable, "subject_id", "left_semi"), s.max_subjects)
    targets = sensors.read_targets(spark, files)
    enough = targets.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("subject_id")
    targets = cut_lineage(clean.normalise_units(targets.join(enough, "subject_id", "left_semi"), ["subject_id"], "value"))
    kinds = ["summary", "breathing", "accel", "rr"] + (["ecg"] if s.use_ecg else [])
    lines = cut_lineage(sensors.read_rows(spark, files, kinds))

    spans = lines.groupBy("subject_id", "kind", "file_id").agg(
        F.min("t_us").alias("start"), F.max("t_us").alias("end"), F.count(F.lit(1)).alias("rows"),
        F.min(sensors.first_numeric(F.col("values"))).alias("first"), F.max("names").alias("head"),
    ).filter("rows >= 10")
    placed = cut_lineage(asof.session_islands(spans, ["subject_id"], "start", "end", "file_id"))
    sessions = asof.session_bounds(placed, ["subject_id"], "start", "end")
    base = cut_lineage(wanted_windows(sessions, targets, s))
    wanted = base.select("subject_id", "session", "window_start")

    fallback = F.lit(1.0)
    for kind, rate in sensors.NOMINAL_RATES.items():
        fallback = F.when(F.col("kind") == kind, F.lit(rate)).otherwise(fallback)
    rates = windows.sampling_rates(lines, ["file_id", "kind"], "t_us", fallback, tie="row_pos").select("file_id", "fs")
    beat = sensors.positions_of(F.col("head"), lambda n: n.contains("rr") | n.contains("interval"))
    axes = sensors.positions_of(F.col("head"), lambda n: n.isin(*clean.AXIS_NAMES))
    # One row per file: session, rate and the channels to read.
    facts = placed.join(rates, "file_id").select(
        "file_id", "session", "start", "fs",
        F.when(F.col("kind") == "rr", F.coalesce(F.get(beat, F.lit(0)), F.col("first"))).otherwise(F.col("first")).alias("at"),
        F.when(F.size(axes) >= 3, F.slice(axes, 1, 3)).otherwise(F.array("first")).alias("axes"),
    )
    rows = cut_lineage(lines.join(facts, "file_id"))
    one = rows.withColumn("value", F.get("values", F.col("at"))).drop("names", "values").filter("value is not null")
    series = ["subject_id", "session", "file_id", "start"]
    keys = ["subject_id", "session", "window_start"]
    parts: list[DataFrame] = []

    def finish(found: DataFrame, prefix: str, names: Sequence[str]) -> None:
        renamed = found.select(*series, "window_start", *[F.col(f"`{n}`").alias(f"{prefix}_{n}") for n in names])
        # One small row per window: stored, so the final join does not carry ten long plans.
        won = windows.first_file_wins(renamed, keys, [f"{prefix}_{n}" for n in names], ["start", "file_id"])
        parts.append(cut_lineage(won))

    def shape(data: DataFrame, by: Sequence[str]) -> DataFrame:
        return windows.basic_stats(data, by, "t_us", "value", s.size, s.step, "row_pos", wanted=wanted).filter("n >= 5")

    def spectrum(data: DataFrame, kind: str) -> DataFrame:
        return spectral.spectral_features(data, kind, series, "t_us", "value", s.size, s.step, "row_pos", wanted)

    def long_enough(found: DataFrame, data: DataFrame, seconds: int) -> DataFrame:
        fs = data.groupBy("file_id").agg(F.max("fs").alias("fs"))
        return found.join(fs, "file_id").filter(F.col("n") >= F.floor(F.col("fs") * seconds))

    summary = sensors.long_signals(rows.filter("kind = 'summary'")).filter("value is not null")
    summary = summary.withColumn("channel", v.feature_tag(F.col("channel")))
    channels = [r["channel"] for r in summary.groupBy("channel").agg(F.min("ordinal").alias("o")).orderBy("o", "channel").collect()]
    if channels:
        found = shape(summary.filter(F.col("channel").isin(channels)), [*series, "channel"])
        wide = windows.widen(found, [*series, "window_start"], "channel", windows.STAT_NAMES, channels)
        finish(wide, "sum", [f"{c}_{k}" for c in channels for k in windows.STAT_NAMES])

    rr = clean.repair_intervals(one.filter("kind = 'rr'"), ["file_id"], "value")
    beats = windows.hrv_time(rr, series, "t_us", "value", s.size, s.step, "row_pos", wanted=wanted)
    finish(beats, "hrv", ["mean_rr", "sdnn", "rmssd", "pnn50", "pnn20", "cvnn", "mean_hr", "n_beats", "sd1", "sd2", "sd1_sd2"])
    finish(spectrum(rr, "rr"), "hrv", spectral.FEATURES["rr"])

    breath = one.filter("kind = 'breathing'")
    finish(long_enough(shape(breath, series), breath, 10), "resp", windows.STAT_NAMES)
    finish(spectrum(breath, "breathing"), "resp", spectral.FEATURES["breathing"])

    picked = F.transform("axes", lambda i: F.get(F.col("values"), i))
    squares = F.aggregate(picked, F.lit(0.0), lambda a, x: a + x * x)
    strength = F.when(F.size("axes") >= 3, F.sqrt(squares)).otherwise(picked[0])
    motion = rows.filter("kind = 'accel'").withColumn("value", strength).drop("names", "values").filter("value is not null")
    finish(long_enough(shape(motion, series), motion, 5), "accel", windows.STAT_NAMES)
    moving = windows.movement(motion, series, "t_us", "value", s.size, s.step, "row_pos", wanted=wanted)
    finish(long_enough(moving, motion, 5), "accel", ["rms", "mad", "active_fraction", "zero_crossings"])
    finish(spectrum(motion, "accel"), "accel", spectral.FEATURES["accel"])

    if s.use_ecg:
        ecg = one.filter("kind = 'ecg'")
        finish(long_enough(shape(ecg, series), ecg, 5), "ecg", windows.STAT_NAMES)
        finish(spectrum(ecg, "ecg"), "ecg", spectral.FEATURES["ecg"])
        finish(detected_variability(ecg, series, s, wanted), "ecghrv", ["mean_rr", "sdnn", "n_beats"])

    out = base.join(files.groupBy("subject_id").agg(F.max("cohort").alias("cohort")), "subject_id")
    for part in parts:
        out = out.join(part, keys, "left")
    features = [c for c in out.columns if c not in (*keys, "window_end", "target_time", "target", "cohort")]
    return out.filter(F.coalesce(*[F.col(f"`{c}`").isNotNull() | F.lit(None) for c in features], F.lit(False)))


def detected_variability(ecg: DataFrame, series, s: WindowSettings, wanted: DataFrame) -> DataFrame:
    found = spectral.beats(ecg, series, "t_us", "value", s.size, s.step, "row_pos", wanted)
    return found.groupBy(*series, "window_start").agg(
        F.avg("rr").alias("mean_rr"), F.stddev_samp("rr").alias("sdnn"), F.count("rr").cast("double").alias("n_beats")
    ).filter("n_beats >= 10")


def prune_and_fill(
    df: DataFrame, features: Sequence[str], minimum: float = 0.5, fit_on: str = "train"
) -> tuple[DataFrame, list[str]]:
    """Coverage pruning and median fill; parameters from training rows, or all rows."""
    basis = prep.train_rows(df) if fit_on == "train" else df
    kept = clean.covered_columns(basis, features, minimum)
    dropped = [c for c in features if c not in kept]
    return clean.median_fill(df.drop(*dropped), kept, basis), kept


# ---------------------------------------------------------------- segments
def segment_pairs(
    df: DataFrame, steps: int = 6, use_ecg: bool = True, gap_minutes: float = 7.5,
    per_subject: int | None = None, persistence: bool = True,
) -> DataFrame:
    """Segment features with the reading ``steps`` segments later."""
    found = segments.segment_features(segments.limit_segments(df, per_subject), use_ecg)
    timed = cut_lineage(found.withColumn("t_us", v.epoch_micros(F.col("ts"))))
    pairs = asof.horizon_pairs(
        timed, ["subject_id"], "t_us", "glucose_now", steps, segments.SEGMENT_MINUTES, gap_minutes, tie="segment_no"
    ).drop("target_time", "elapsed_min", "t_us")
    return pairs if persistence else pairs.drop("glucose_now")


def segment_report(all_segments: DataFrame, pairs: DataFrame) -> DataFrame:
    read = all_segments.groupBy("subject_id").agg(F.count(F.lit(1)).alias("read"))
    used = pairs.groupBy("subject_id").agg(F.count(F.lit(1)).alias("pairs"))
    return read.join(used, "subject_id", "left").select(
        "subject_id", "read", F.coalesce("pairs", F.lit(0)).alias("pairs"),
        (F.col("read") - F.coalesce("pairs", F.lit(0))).alias("dropped"),
    )


# ---------------------------------------------------------------- block manifest
def manifest_experiment(
    df: DataFrame, row_id: str, target: str, explicit: Mapping[str, Sequence[str]] | None = None,
    encoding: str = "expression", seed: int = 42, exclude: Sequence[str] = (), word_buckets: int = 64,
) -> dict[str, DataFrame]:
    """Blocks, nested split, training-fitted blocks, fused model, ablation and verdict."""
    spark = df.sparkSession
    task = profile.infer_task(df, target)
    classes = 0
    if task == "classification":
        classes = len(clean.class_labels(df, target))
        df = clean.encode_labels(df, target, "_label").drop(target).withColumnRenamed("_label", target)
    blocks = modality.infer_modalities(df, target, [row_id, *exclude], explicit)
    out = {"blocks": modality.modality_table(spark, blocks), "schema": modality.block_schema(df, blocks, encoding)}
    parted = cut_lineage(splits.nested_split(df, row_id, seed=seed))
    inputs: dict[str, list[str]] = {}
    ready = parted
    if "genomic" in blocks:
        kind = modality.genomic_encoding(df, blocks["genomic"]) if encoding == "auto" else encoding
        ready = (prep.snp_block if kind == "snp" else prep.expression_block)(ready, blocks["genomic"])
        inputs["genomic"] = blocks["genomic"]
    if "tabular" in blocks:
        columns = blocks["tabular"]
        fitted = prep.fit_preprocessor(parted.select(*columns, "split"))
        ready = fitted.transform(ready)
        inputs["tabular"] = [c for c in fitted.features]
    if "text" in blocks:
        from tidemark.functions.text import hashed_words

        ready = modality.with_text(ready, blocks["text"])
        words = hashed_words(ready.select(row_id, "text_block"), row_id, "text_block", word_buckets)
        wide = words.groupBy(row_id).pivot("bucket", list(range(word_buckets))).agg(F.first("weight"))
        named = wide.select(row_id, *[F.col(f"`{b}`").alias(f"word_{b}") for b in range(word_buckets)])
        inputs["text"] = [f"word_{b}" for b in range(word_buckets)]
        ready = ready.join(named, row_id, "left").fillna(0.0, inputs["text"])
    renamed = {c: f"{b}__{i}" for b, cs in inputs.items() for i, c in enumerate(cs)}
    ready = cut_lineage(ready.select(row_id, target, "split", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in renamed.items()]))
    fused_blocks = {b: [renamed[c] for c in cs] for b, cs in inputs.items()}
    m = models.ModelInput(ready.filter("split = 'train'"), tuple(renamed.values()), target, classes, seed)
    fit = models.logistic if classes else models.ridge
    test = ready.filter("split = 'test'")
    fused = models.early_fusion(m, fused_blocks, fit)
    out["ablation"] = models.block_ablation(m, fused_blocks, test, fit, fused)
    out["verdict"] = models.fusion_verdict(out["ablation"], task)
    if len(fused_blocks) > 1:
        _, weights = models.late_fusion(m, fused_blocks, ready.filter("split = 'validation'"), fit)
        out["weights"] = spark.createDataFrame(list(weights.items()), "block string, weight double")
    if "tabular" in fused_blocks:
        tabular = models.ModelInput(m.train, tuple(fused_blocks["tabular"]), target, classes, seed, 50, 20)
        out["tabular_reference"] = models.run_baselines(tabular, test, ["dummy_majority" if classes else "dummy_mean", "logistic_regression" if classes else "ridge"])
    return out
