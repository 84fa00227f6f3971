"""Table scans: single files, folders, archives, and several tables at once."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File suffixes that are read as tables.
DELIMITED = {".csv": ",", ".txt": ",", ".tsv": "\t"}
COLUMNAR = (".parquet", ".pq")
NATIVE_CODECS = (".gz", ".bz2")


def table_suffix(path: str) -> str:
    name = PurePosixPath(path).name.lower()
    for codec in (*NATIVE_CODECS, ".xz"):
        name = name.removesuffix(codec)
    return PurePosixPath(name).suffix


def strip_names(df: DataFrame, lower: bool = False) -> DataFrame:
    return df.toDF(*[c.strip().lower() if lower else c.strip() for c in df.columns])


def _path_status(spark: SparkSession, path: str):
    """Hadoop listing through Spark's own binary reader, content not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        return not _path_status(spark, path).isEmpty()
    except Exception as error:  # AnalysisException: PATH_NOT_FOUND
        if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error):
            return False
        raise


def read_table(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Read one table, choosing the reader by suffix.

    gzip and bzip2 go through Spark's codecs; xz and zip are expanded by tasks. Giving a
    ``schema`` avoids the inference pass over delimited files.
    """
    suffix = table_suffix(path)
    lowered = path.lower()
    if lowered.endswith((".zip", ".xz")):
        tables = read_archives(spark, path, **options)
        if len(tables) != 1:
            raise ValueError(f"{path} holds {len(tables)} tables; use read_any")
        return next(iter(tables.values()))
    if suffix in DELIMITED:
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
        reader = spark.read.option("header", True).option("sep", DELIMITED[suffix])
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return strip_names(reader.options(**options).csv(path))
    if suffix in COLUMNAR:
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
        return strip_names(spark.read.options(**options).parquet(path))
    raise ValueError(f"unsupported table suffix: {suffix or path}")


def limited(df: DataFrame, max_rows: int | None) -> DataFrame:
    return df.limit(max_rows) if max_rows else df


# ---------------------------------------------------------------- archives
LINES = "path string, member string, line_no long, line string"


def _archive_members(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    name = PurePosixPath(path).name
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for member in archive.namelist():
                if member.endswith("/") or member.startswith("__MACOSX"):
                    continue
                if table_suffix(member) not in DELIMITED:
                    continue
                data = archive.read(member)
                lowered = member.lower()
                if lowered.endswith(".gz"):
                    data, member = gzip.decompress(data), member[:-3]
                elif lowered.endswith(".bz2"):
                    data, member = bz2.decompress(data), member[:-4]
                elif lowered.endswith(".xz"):
                    data, member = lzma.decompress(data), member[:-3]
                yield f"{name}:{member}", data
    elif name.lower().endswith(".xz"):
        yield name, lzma.decompress(content)


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            for member, data in _archive_members(path, content):
                lines = data.decode("utf-8-sig", errors="replace").splitlines()
                for start in range(0, len(lines), 50_000):
                    part = lines[start : start + 50_000]
                    yield pd.DataFrame(
                        {"path": path, "member": member,
                         "line_no": range(start, start + len(part)), "line": part}
                    )


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every delimited member; archives are expanded in parallel, one task each."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_expand, LINES)


def read_archives(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """Every non-empty table inside zip or xz files, keyed ``archive:member`` by its path inside.

    Archives of one name in different folders have their whole path in the key.
    """
    lines = archive_lines(spark, path)
    heads = lines.filter("line_no = 0").select("path", "member").collect()
    tables = {}
    labels = Counter(head["member"] for head in heads)
    for head in heads:
        key = head["member"] if labels[head["member"]] == 1 else f"{PurePosixPath(head['path']).parent}/{head['member']}"
        sep = "\t" if head["member"].lower().removesuffix(".xz").endswith(".tsv") else ","
        # RDD only as the carrier Spark's CSV reader accepts for in-memory lines.
        body = lines.filter((F.col("member") == head["member"]) & (F.col("path") == head["path"])).select("line")
        df = (
            spark.read.option("header", True).option("inferSchema", True).option("sep", sep)
            .options(**options)
            .csv(body.rdd.map(lambda row: row[0]))
        )
        df = strip_names(df)
        if not df.isEmpty():
            tables[key] = df
    return tables


def read_any(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    if path.lower().endswith((".zip", ".xz")):
        return read_archives(spark, path, **options)
    df = read_table(spark, path, **options)
    return {PurePosixPath(path).name: df}


def list_tables(
    spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True
) -> list[str]:
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select("path")
    )
    paths = sorted({whole_table(_root(folder), r["path"]) for r in files.collect()})
    return [
        p for p in paths
        if table_suffix(p) in DELIMITED or table_suffix(p) in COLUMNAR
        or p.lower().endswith((".zip", ".xz"))
    ]


def whole_table(root: str, path: str) -> str:
    """The file, or the folder below the root that is named as a table and holds it as a part."""
    above, found, inside = path.partition(root)
    parts = inside.split("/")
    for i, part in enumerate(parts[:-1], start=1):
        if table_suffix(part) in DELIMITED or table_suffix(part) in COLUMNAR:
            return above + found + "/".join(parts[:i])
    return path


def _root(folder: str) -> str:
    return folder.rstrip("/").split(":")[-1].rstrip("/") + "/"


def read_folder(
    spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, **options
) -> dict[str, DataFrame]:
    """Tables of a folder, keyed by their path below it; a table may be a folder of parts itself."""
    tables: dict[str, DataFrame] = {}
    root = _root(folder)
    for path in list_tables(spark, folder, pattern, recursive):
        inside = PurePosixPath(path.split(root, 1)[-1]).parent
        for name, df in read_any(spark, path.removeprefix("file:"), **options).items():
            tables[str(inside / name)] = df
    return tables


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: rows, columns, first six column names."""
    parts = []
    for name, df in tables.items():
        shown = ", ".join(df.columns[:6]) + (" ..." if len(df.columns) > 6 else "")
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("file"),
                "rows",
                F.lit(len(df.columns)).cast("long").alias("columns"),
                F.lit("ok").alias("status"),
                F.lit(shown).alias("column_preview"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def describe_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Preview of what each path would load; a path that fails becomes an error row."""
    schema = "file string, rows long, columns long, status string, column_preview string"
    out = None
    for path in paths:
        try:
            tables = (
                read_any(spark, path)
                if table_suffix(path) or path.lower().endswith((".zip", ".xz"))
                else read_folder(spark, path)
            )
            part = describe_tables(tables)
        except Exception as error:
            row = [(path, None, None, f"error: {str(error).splitlines()[0][:200]}", None)]
            part = spark.createDataFrame(row, schema)
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- several tables
def stack(tables: Mapping[str, DataFrame], source: bool = True) -> DataFrame:
    """Union by name; absent columns are NULL, ``source_file`` names the origin."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("source_file", F.lit(name)) if source else df
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables to stack")
    return out


def stack_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per column: tables that have it, rows that get a value from them, rows left missing."""
    spark = next(iter(tables.values())).sparkSession
    sizes = {name: df.count() for name, df in tables.items()}
    total = sum(sizes.values())
    seen: dict[str, list[str]] = {}
    for name, df in tables.items():
        for column in df.columns:
            seen.setdefault(column, []).append(name)
    rows = [
        (c, len(ns), sum(sizes[n] for n in ns), total - sum(sizes[n] for n in ns), len(ns) == len(tables))
        for c, ns in sorted(seen.items())
    ]
    return spark.createDataFrame(
        rows, "column string, tables long, rows long, rows_missing long, in_every_table boolean"
    )


def _stem(name: str) -> str:
    return PurePosixPath(name).stem[:12]


def merge(
    tables: Mapping[str, DataFrame], key: str, how: str = "inner"
) -> DataFrame:
    """Left-deep key join; clashing columns of later tables get ``_<table stem>``."""
    absent = [n for n, df in tables.items() if key not in df.columns]
    if absent:
        raise KeyError(f"key '{key}' is missing from: {', '.join(absent)}")
    names = list(tables)
    out = tables[names[0]]
    for name in names[1:]:
        right = tables[name]
        clashes = (set(out.columns) & set(right.columns)) - {key}
        for column in sorted(clashes):
            right = right.withColumnRenamed(column, f"{column}_{_stem(name)}")
        out = out.join(right, key, {"outer": "full"}.get(how, how))
    return out


def merge_report(tables: Mapping[str, DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Rows before and after each join step, computed from key counts alone.

    Joining on one key multiplies per-key counts, so the sizes of every step follow from
    ``(key, rows)`` tables; the wide join itself is never run for the report.
    """
    names = list(tables)
    state = tables[names[0]].groupBy(key).agg(F.count(F.lit(1)).alias("acc"))
    columns = set(tables[names[0]].columns)
    steps = []

    steps.append(
        state.agg(
            F.coalesce(F.sum("acc"), F.lit(0)).cast("long").alias("rows_before"),
            F.coalesce(F.sum("acc"), F.lit(0)).cast("long").alias("rows_after"),
            F.count(key).alias("unique_keys"),
        ).select(
            F.lit(0).alias("step"), F.lit(names[0]).alias("file"), "rows_before", "rows_after",
            "unique_keys", F.lit("").alias("suffixed"),
        )
    )
    for order, name in enumerate(names[1:], start=1):
        right = tables[name].groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        suffixed = sorted((columns & set(tables[name].columns)) - {key})
        both = state.join(right, key, "full")
        l, r = F.coalesce("acc", F.lit(0)), F.coalesce("n", F.lit(0))
        product = F.when((l > 0) & (r > 0), l * r)
        kept = {
            "inner": product,
            "left": F.when(l > 0, F.coalesce(product, l)),
            "right": F.when(r > 0, F.coalesce(product, r)),
            "outer": F.coalesce(product, F.greatest(l, r)),
        }[how]
        merged = both.select(key, kept.alias("acc")).filter("acc is not null")
        sizes = both.agg(
            F.coalesce(F.sum(l), F.lit(0)).cast("long").alias("rows_before"),
            F.coalesce(F.sum(kept), F.lit(0)).cast("long").alias("rows_after"),
            F.count_if((r > 0) & F.col(key).isNotNull()).alias("unique_keys"),
        )
        steps.append(
            sizes.select(
                F.lit(order).alias("step"), F.lit(name).alias("file"), "rows_before",
                "rows_after", "unique_keys", F.lit(",".join(suffixed)).alias("suffixed"),
            )
        )
        state = merged
        columns |= set(tables[name].columns) | {f"{c}_{_stem(name)}" for c in suffixed}
    out = steps[0]
    for part in steps[1:]:
        out = out.unionByName(part)
    first = F.first_value("rows_after").over(Window.partitionBy(F.lit(0)).orderBy("step"))
    return out.withColumn("kept_share", F.col("rows_after") / F.greatest(first, F.lit(1))).withColumn(
        "warning", F.col("kept_share") < 0.9
    )


def column_overlap(tables: Mapping[str, DataFrame]) -> float:
    sets = [set(df.columns) for df in tables.values()]
    return len(set.intersection(*sets)) / max(1, len(set.union(*sets)))


def combine(
    tables: Mapping[str, DataFrame],
    mode: str = "auto",
    key: str | None = None,
    how: str = "inner",
    source: bool = True,
) -> tuple[DataFrame, str]:
    """Single table, stack or merge; ``auto`` stacks on column overlap of 0.8 or no key."""
    if not tables:
        raise ValueError("no readable tables")
    if len(tables) == 1:
        return next(iter(tables.values())), "single"
    if mode == "auto":
        mode = "stack" if column_overlap(tables) >= 0.8 or not key else "merge"
    if mode == "merge":
        if not key:
            raise ValueError("merge needs a key column")
        return merge(tables, key, how), "merge"
    return stack(tables, source), "stack"


def load_dataset(spark: SparkSession, paths: Sequence[str], **how) -> tuple[DataFrame, str]:
    tables: dict[str, DataFrame] = {}
    for path in paths:
        one = table_suffix(path) or path.lower().endswith((".zip", ".xz"))
        tables.update(read_any(spark, path) if one else read_folder(spark, path))
    return combine(tables, **how)


def run_registry(spark: SparkSession, pattern: str) -> DataFrame:
    """All result records under a glob, newest first: ``run``, ``record``, ``path`` and ``modified``.

    Records differ in their fields, so each is a VARIANT, typed where a path is read; a file
    that is not JSON has a null record. The run is the record's folder, without a ``name=`` before it.
    """
    files = spark.read.text(pattern, wholetext=True)
    path = F.col("_metadata.file_path")
    folder = F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -2)), "^[^=]*=", "")
    return files.select(
        folder.alias("run"), F.try_parse_json("value").alias("record"), path.alias("path"), F.col("_metadata.file_modification_time").alias("modified"),
    ).orderBy(F.desc("modified"), "path")


# Names of a record's fields, and of the blocks that may hold the final model's metrics.
HEADLINES = ("transformer", "multimodal")


def run_index(registry: DataFrame) -> DataFrame:
    """One comparable row per run: source, task, rows, selected features, primary metric, baseline, seed.

    The metric is ROC-AUC of a classification and RMSE otherwise, from the first headline block that
    is there. The baseline is the fractional number of smallest name under ``naive_baseline``. What
    a record lacks, or holds in another type, is null.
    """

    def at(path: str, kind: str):
        return F.try_variant_get("record", f"$.{path}", kind)

    metric = F.when(at("task", "string") == "classification", "roc_auc").otherwise("rmse")
    value = F.coalesce(*[F.when(metric == m, at(f"{block}.{m}", "double")) for block in HEADLINES for m in ("roc_auc", "rmse")])
    naive = F.filter(F.map_entries(at("naive_baseline", "map<string, variant>")), lambda e: F.schema_of_variant(e["value"]).rlike("^(DOUBLE|FLOAT|DECIMAL)"))
    fractional = F.transform(naive, lambda e: F.struct(e["key"], F.try_variant_get(e["value"], "$", "double").alias("value")))
    return registry.where("record is not null").select(
        "run", at("dataset.source", "string").alias("source"), at("task", "string").alias("task"), at("dataset.n_rows", "long").alias("n_rows"),
        at("feature_selection.n_selected", "long").alias("n_selected"), metric.alias("metric"), value.alias("value"),
        F.array_min(fractional)["value"].alias("naive_baseline"), at("seed", "long").alias("seed"),
    )


def manifest(
    df: DataFrame, target: str, drop: Sequence[str] = ()
) -> DataFrame:
    """Labelled rows without id and group columns."""
    return df.dropna(subset=[target]).drop(*drop)
