"""Sensor trees: file discovery, inventory, signal and target reads as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators.clean import dedupe_first

# File-name endings per signal kind, target file names, nominal rates (Hz),
# subject folder patterns and the session stamp in a folder name.
KIND_ENDINGS = {
    "summary": ("_summary.csv", "_summaryenhanced.csv", "_summaryenhanced_.csv"),
    "breathing": ("_breathing.csv", "_br.csv", "_breathingwaveform.csv"),
    "accel": ("_accel.csv", "_acceleration.csv", "_accelerometer.csv"),
    "ecg": ("_ecg.csv", "_ecgwaveform.csv"),
    "rr": ("_rr.csv", "_rrdata.csv", "_rtor.csv"),
    "events": ("_events.csv", "_eventdata.csv", "_general.csv"),
}
TARGET_NAMES = ("glucose.csv", "glucose_data.csv", "cgm.csv")
NOMINAL_RATES = {"ecg": 250.0, "breathing": 25.0, "accel": 100.0, "summary": 1.0}
SUBJECT_PATTERNS = (
    r"^(\d{1,3})$", r"(?i)^S[_-]?(\d{1,3})$", r"(?i)^subject[_-]?(\d{1,3})$", r"(?i)^(c\d+s\d+)$",
    r"(?i)^(p\d{1,4})$",
)
SESSION_STAMP = r"(\d{4})[_-](\d{2})[_-](\d{2})[-_](\d{2})[_-](\d{2})[_-](\d{2})"
TIME_NAMES = ("time", "timestamp", "datetime", "date_time")
SIGNAL_KINDS = tuple(KIND_ENDINGS)


def classify(df: DataFrame, path: str = "path") -> DataFrame:
    """Add kind, subject_id, cohort and session stamp derived from a path column.

    Rows whose file is no known kind get a NULL kind.
    """
    lowered = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    kind = None
    for name, endings in KIND_ENDINGS.items():
        hit = F.lit(False)
        for ending in endings:
            hit = hit | lowered.endswith(ending)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    is_target = lowered.isin(*TARGET_NAMES) | (lowered.contains("glucose") & lowered.endswith(".csv"))
    kind = kind.when(is_target, "target")

    folders = F.reverse(F.slice(F.split(F.col(path), "/"), F.lit(1), F.size(F.split(F.col(path), "/")) - 1))

    def subject_of(part: Column) -> Column:
        found = [F.nullif(F.regexp_extract(part, p, 1), F.lit("")) for p in SUBJECT_PATTERNS]
        value = F.coalesce(*found)
        return F.when(value.rlike(r"^\d+$"), F.lpad(value, 3, "0")).otherwise(F.lower(value))

    subjects = F.filter(F.transform(folders, subject_of), lambda s: s.isNotNull())
    whole = F.lower(F.col(path))
    cohort = F.when(whole.contains("diabet"), "diabetes").when(
        whole.contains("healthy") | whole.contains("control"), "healthy"
    ).otherwise("unknown")
    parts = F.reverse(F.split(F.col(path), "/"))
    stamps = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, SESSION_STAMP, 0)), lambda s: s != "")
    stamp = F.regexp_replace(F.get(stamps, F.lit(0)), "[_-]", "")
    return df.withColumns(
        {
            "kind": kind,
            "subject_id": F.coalesce(F.get(subjects, F.lit(0)), F.lit("unknown")),
            "cohort": cohort,
            "session_start": F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")),
        }
    )


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Recognised files below a folder; content is not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv").load(root).select("path")
    )
    relative = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return classify(relative).filter("kind is not null")


def inventory(files: DataFrame) -> DataFrame:
    """Files per subject and kind; usable subjects have a target and some signal."""
    counts = files.groupBy("subject_id").agg(
        F.max(F.when(F.col("cohort") != "unknown", F.col("cohort"))).alias("_cohort"),
        F.count_if(F.col("kind") == "target").alias("target_files"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in SIGNAL_KINDS],
    )
    signals = sum([F.col(k) for k in SIGNAL_KINDS], F.lit(0))
    return counts.select(
        "subject_id", F.coalesce("_cohort", F.lit("unknown")).alias("cohort"), "target_files",
        *SIGNAL_KINDS, ((F.col("target_files") > 0) & (signals > 0)).alias("usable"),
    )


def cohort_filter(files: DataFrame, cohorts: Sequence[str] | None) -> DataFrame:
    return files.filter(F.col("cohort").isin(*[c.lower() for c in cohorts])) if cohorts else files


def limit_subjects(files: DataFrame, count: int | None) -> DataFrame:
    if not count:
        return files
    chosen = files.select("subject_id").distinct().orderBy("subject_id").limit(count)
    return files.join(F.broadcast(chosen), "subject_id", "left_semi")


# ---------------------------------------------------------------- reads
def numbered_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(path, row_pos, head, line): body lines with their position in the file.

    Large files are read in splits by several tasks. Lines are counted per split and each
    split starts where the splits before it end, so no file has to fit into one task.
    """
    lines = spark.read.text(paths).select(
        # The metadata path is an encoded URI; a plus sign in it is literal.
        F.regexp_replace(
            F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/"
        ).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"),
        F.col("value").alias("line"),
    )
    in_split = Window.partitionBy("path", "block").orderBy("seen")
    local = lines.withColumn("_i", F.row_number().over(in_split) - 1)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    placed = local.join(starts, ["path", "block"]).withColumn("_i", F.col("_i") + F.col("_start"))
    heads = placed.filter("_i = 0").select("path", F.regexp_replace("line", "^\ufeff", "").alias("head"))
    body = placed.filter("_i > 0").filter(F.trim("line") != "")
    return body.join(heads, "path").select(
        "path", (F.col("_i") - 1).cast("long").alias("row_pos"), "head", "line"
    )


def cells(lines: DataFrame) -> DataFrame:
    """(path, row_pos, channel, text) for every field of every line."""
    names = F.transform(F.split("head", ","), lambda c: F.trim(c))
    fields = F.transform(F.split("line", ","), lambda c: F.trim(c))
    pairs = F.filter(F.arrays_zip(names.alias("channel"), fields.alias("text")), lambda p: p["channel"].isNotNull())
    return lines.select("path", "row_pos", "head", F.posexplode(pairs).alias("ordinal", "p")).select(
        "path", "row_pos", "ordinal", F.col("p.channel").alias("channel"), F.col("p.text").alias("text")
    )


def signal_times(rows: DataFrame, text: str, rate: Column) -> DataFrame:
    """Row times: parsed where at least half of a file's stamps parse, else start + i / rate.

    Expects path, row_pos and session_start. A file without either is left out, and so
    are rows whose own stamp does not parse in a parsed file.
    """
    parsed = rows.withColumn("_parsed", v.parse_wall_clock(F.col(text)))
    usable = parsed.groupBy("path").agg(
        (F.count("_parsed") >= 0.5 * F.count(F.lit(1))).alias("_usable")
    )
    joined = parsed.join(usable, "path")
    synthetic = v.epoch_micros(F.col("session_start")) + F.round(F.col("row_pos") / rate * v.MICROS).cast("long")
    t = F.when(F.col("_usable"), v.epoch_micros(F.col("_parsed"))).otherwise(synthetic)
    return joined.withColumn("t_us", t).drop("_parsed", "_usable").filter("t_us is not null")


def read_rows(spark: SparkSession, files: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row per file line: ids, t_us, and the channels' names and values as arrays.

    The clock is picked out of a line where it stands, so lines are not taken apart and
    regrouped. ``files`` is the discovery table; its paths (metadata) are listed on the
    driver.
    """
    wanted = files.filter(F.col("kind").isin(*kinds))
    paths = [r["path"] for r in wanted.select("path").collect()]
    if not paths:
        schema = (
            "subject_id string, cohort string, kind string, file_id string, row_pos long, t_us long, "
            "names array<string>, values array<double>"
        )
        return spark.createDataFrame([], schema)
    names = F.transform(F.split("head", ","), lambda c: F.trim(c))
    fields = F.transform(F.split("line", ","), lambda c: F.trim(c))
    pairs = F.filter(F.arrays_zip(names.alias("c"), fields.alias("x")), lambda p: p["c"].isNotNull())
    is_time = lambda p: F.lower(p["c"]).isin(*TIME_NAMES)
    lines = numbered_lines(spark, paths).withColumn("_p", pairs).select(
        "path", "row_pos",
        F.get(F.filter("_p", is_time), F.lit(0))["x"].alias("stamp"),
        F.filter("_p", lambda p: ~is_time(p)).alias("_p"),
    )
    rate = F.lit(1.0)
    for kind, value in NOMINAL_RATES.items():
        rate = F.when(F.col("kind") == kind, F.lit(value)).otherwise(rate)
    tagged = lines.join(wanted.select("path", "subject_id", "cohort", "kind", "session_start"), "path")
    return signal_times(tagged, "stamp", rate).select(
        "subject_id", "cohort", "kind", F.col("path").alias("file_id"), "row_pos", "t_us",
        F.transform("_p", lambda p: p["c"]).alias("names"),
        F.transform("_p", lambda p: v.finite(p["x"].try_cast("double"))).alias("values"),
    )


def long_signals(rows: DataFrame) -> DataFrame:
    """signals(..., ordinal, channel, value): one row per line and channel."""
    kept = [c for c in rows.columns if c not in ("names", "values")]
    cell = F.posexplode(F.arrays_zip("names", "values")).alias("ordinal", "_c")
    return rows.select(*kept, cell).select(
        *kept, "ordinal", F.col("_c.names").alias("channel"), F.col("_c.values").alias("value")
    )


def read_signals(spark: SparkSession, files: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return long_signals(read_rows(spark, files, kinds))


def first_numeric(values: Column) -> Column:
    """Position of the first value that is a number; NULL when there is none."""
    at = F.array_position(F.transform(values, lambda x: x.isNotNull()), F.lit(True))
    return F.when(at > 0, at - 1).cast("int")


def positions_of(names: Column, test) -> Column:
    """Positions of the channel names that pass a test."""
    found = F.transform(names, lambda n, i: F.when(test(F.lower(F.trim(n))), i))
    return F.filter(found, lambda i: i.isNotNull())


def read_targets(spark: SparkSession, files: DataFrame) -> DataFrame:
    """targets(subject_id, t_us, value): one value per subject and time, first file first.

    The value column is chosen once per file: the first with a value's name, else the first
    that holds a number. Where its cell is empty the row has no value.
    """
    wanted = files.filter("kind = 'target'")
    paths = [r["path"] for r in wanted.select("path").collect()]
    lines = numbered_lines(spark, paths)
    long = cells(lines).withColumn("channel", F.lower("channel"))
    number = F.expr("try_cast(text as double)")
    named = F.col("channel").contains("glucose") | F.col("channel").isin("value", "glycemia", "bg")
    value_rank = F.struct(F.when(named, 0).otherwise(1), "ordinal")
    stamp_like = F.col("channel").contains("time") | F.col("channel").contains("date")
    usable = long.filter(~stamp_like & (named | number.isNotNull()))
    chosen = usable.groupBy("path").agg(F.min_by("ordinal", value_rank).alias("value_ordinal"))
    rows = long.join(chosen, "path", "left").groupBy("path", "row_pos").agg(
        F.max(F.when(F.col("channel") == "date", F.col("text"))).alias("day"),
        F.max(F.when(F.col("channel") == "time", F.col("text"))).alias("clock"),
        F.min_by(F.when(stamp_like, F.col("text")), F.when(stamp_like, F.col("ordinal"))).alias("stamp"),
        F.max(F.when(F.col("ordinal") == F.col("value_ordinal"), number)).alias("value"),
    )
    both = F.col("day").isNotNull() & F.col("clock").isNotNull()
    text = F.when(both, F.concat_ws(" ", "day", "clock")).otherwise(F.col("stamp"))
    placed = rows.withColumn("t_us", v.epoch_micros(v.parse_wall_clock(text))).join(
        wanted.select("path", "subject_id"), "path"
    )
    clean = placed.filter("t_us is not null and value is not null").select(
        "subject_id", "t_us", F.col("path").alias("file_id"), "row_pos", "value"
    )
    return dedupe_first(clean, ["subject_id", "t_us"], ["file_id", "row_pos"]).select(
        "subject_id", "t_us", "value"
    )
