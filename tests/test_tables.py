"""Sources, sinks, profiling, splits, leakage and preprocessing."""

import bz2
import gzip
import json
import lzma
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators import clean, leakage, modality, prep, profile, splits
from tidemark.sources import sinks, tables


# ---------------------------------------------------------------- sources
def test_suffixes_and_missing_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" x ,y\n1,2\n3,4\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    assert tables.read_table(spark, str(tmp_path / "a.csv")).columns == ["x", "y"]
    assert tables.read_table(spark, str(tmp_path / "b.tsv")).first()["y"] == 2
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "a.docx"))


def test_archives(spark, tmp_path):
    text = "pid,x\n1,2\n3,4\n"
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b.csv.bz2").write_bytes(bz2.compress(text.encode()))
    (tmp_path / "c.csv.xz").write_bytes(lzma.compress(text.encode()))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("one.csv", text)
        z.writestr("deep/two.csv.gz", gzip.compress(text.encode()))
        z.writestr("deep/one.csv", "pid,x\n7,8\n")
        z.writestr("__MACOSX/one.csv", text)
        z.writestr("empty.csv", "pid,x\n")
        z.writestr("readme.md", "no")
    for name in ("a.csv.gz", "b.csv.bz2", "c.csv.xz"):
        assert tables.read_table(spark, str(tmp_path / name)).count() == 2
    found = tables.read_any(spark, str(tmp_path / "d.zip"))
    assert sorted(found) == ["d.zip:deep/one.csv", "d.zip:deep/two.csv", "d.zip:one.csv"]
    assert [found[name].count() for name in sorted(found)] == [1, 2, 2]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv.gz").write_bytes(gzip.compress(b"pid,x\n5,6\n"))
    folder = tables.read_folder(spark, str(tmp_path))
    assert len(folder) == 7 and {"a.csv.gz", "sub/a.csv.gz"} <= folder.keys()
    preview = tables.describe_paths(spark, [str(tmp_path), str(tmp_path / "gone.csv")]).toPandas()
    assert preview["status"].str.startswith("error").sum() == 1 and preview["rows"].sum() == 12


def test_a_folder_of_parts_is_one_table(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(4).repartition(2).write.option("header", True).csv(str(tmp_path / "sub" / "rows.csv"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "plain"))
    found = tables.read_folder(spark, str(tmp_path))
    assert {n: df.count() for n, df in found.items() if not n.startswith("plain/")} == {"many.parquet": 10, "sub/rows.csv": 4}
    assert [df.count() for n, df in found.items() if n.startswith("plain/")] == [7]
    assert tables.describe_tables(tables.read_folder(spark, str(tmp_path), "*.parquet")).count() == 2


def test_stack_and_merge(spark):
    a = spark.createDataFrame([(1, 2), (3, 4)], "x int, y int")
    b = a.withColumn("extra", F.lit(1))
    stacked = tables.stack({"a.csv": a, "b.csv": b})
    assert stacked.count() == 4 and stacked.filter("extra is null").count() == 2
    report = {r["column"]: r["in_every_table"] for r in tables.stack_report({"a": a, "b": b}).collect()}
    assert report == {"x": True, "y": True, "extra": False}
    left = spark.range(100).select(F.col("id").alias("pid"), F.lit(1).alias("v"))
    right = spark.range(50).select(F.col("id").alias("pid"), F.lit(2).alias("v"))
    merged = tables.merge({"left.csv": left, "right.csv": right}, "pid")
    assert merged.count() == 50 and merged.columns == ["pid", "v", "v_right"]
    for how in ("inner", "left", "right", "outer"):
        steps = tables.merge_report({"left.csv": left, "right.csv": right}, "pid", how).orderBy("step").collect()
        assert steps[1]["rows_after"] == tables.merge({"left.csv": left, "right.csv": right}, "pid", how).count()
    assert tables.merge_report({"left.csv": left, "right.csv": right}, "pid").filter("warning").count() == 1
    with pytest.raises(KeyError):
        tables.merge({"a": a, "l": left}, "pid")


def test_written_records_are_json_safe(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), float("inf"), float("-inf"), 1.5)], "a double, b double, c double, d double")
    sinks.write_record(df, "r", str(tmp_path / "r"))
    line = "".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))
    assert json.loads(line) == {"a": None, "b": "Infinity", "c": "-Infinity", "d": 1.5}
    runs = tables.run_registry(spark, str(tmp_path / "r" / "*.json"))
    assert runs.columns == ["run", "record", "path", "modified"] and runs.count() == 1
    bare = tables.run_index(runs).first()
    assert (bare["run"], bare["metric"], bare["value"], bare["naive_baseline"], bare["seed"]) == ("r", "rmse", None, None, None)
    paths = sinks.write_tables({"one": df, "two": df}, str(tmp_path / "t"))
    assert all(spark.read.csv(p, header=True).count() == 1 for p in paths.values())


def test_counts_written_with_an_exponent_are_read_as_digits(spark):
    from tidemark.plans.catalog_tables import count_text

    df = spark.createDataFrame([("719.0",), ("1.1991E7",), ("Infinity",), (None,)], "x string")
    assert [r[0] for r in df.select(count_text(F.col("x"))).collect()] == ["719", "11991000", None, None]


def test_index_of_runs_with_differing_records(spark, tmp_path):
    records = {
        "a": {"task": "classification", "dataset": {"source": "x.csv", "n_rows": 9}, "multimodal": {"roc_auc": 0.75}, "naive_baseline": {"n": 3, "accuracy": 0.5, "f1": 0.25}, "seed": 7},
        "b": {"task": "regression", "dataset": {"n_rows": "many"}, "transformer": {"rmse": 2}, "multimodal": {"rmse": 1.0}, "feature_selection": {"n_selected": 4}, "seed": None},
        "c": ["not", "an", "object"],
    }
    for name, record in records.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "results.json").write_text("{")
    got = {r["run"]: r for r in tables.run_index(tables.run_registry(spark, str(tmp_path / "*" / "results.json"))).collect()}
    assert set(got) == {"a", "b", "c"}
    assert tuple(got["a"])[1:] == ("x.csv", "classification", 9, None, "roc_auc", 0.75, 0.5, 7)
    assert tuple(got["b"])[1:] == (None, "regression", None, 4, "rmse", 2.0, None, None)
    assert tuple(got["c"])[1:] == (None, None, None, None, "rmse", None, None, None)


def _png(path, rgb):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(rgb) * 4 for _ in range(4))
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def test_images_join_with_presence(spark, tmp_path):
    _png(tmp_path / "a.png", (255, 0, 0))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    df = spark.createDataFrame([(1, "a.png"), (2, "bad.png"), (3, "missing.png"), (4, None)], "id int, path string")
    out = {r["id"]: r for r in modality.with_images(df, "path", str(tmp_path)).collect()}
    assert [out[i]["has_image"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert sorted(out[1]["means"]) == [0.0, 0.0, 1.0]


# ---------------------------------------------------------------- profile
def test_task_inference(spark):
    rng = np.random.default_rng(0)
    cases = {
        "classification": [[0, 1] * 20, [0.0, 1.0] * 20, ["yes", "no"] * 20, [True, False] * 20, list(range(10)) * 4],
        "regression": [rng.normal(size=40).tolist()],
    }
    for want, columns in cases.items():
        for values in columns:
            df = spark.createDataFrame(pd.DataFrame({"y": values}))
            assert profile.infer_task(df, "y") == want
    with pytest.raises(ValueError):
        profile.infer_task(spark.createDataFrame([(None,)], "y double"), "y")


def test_validation(spark):
    df = spark.range(60).select(
        F.lit(1).alias("const"), F.col("id").alias("x"), (F.col("id") % 30 == 0).cast("int").alias("y"),
        F.when(F.col("id") > 1, F.lit(0)).otherwise(F.lit(None)).alias("gap"),
    )
    found = {(r["column"], r["check"]) for r in profile.validate(df.union(df.limit(1)), "y").collect()}
    assert {("const", "constant"), ("gap", "constant"), ("y", "imbalance")} <= found
    assert any(check == "duplicates" for _, check in found)
    assert profile.validate(df, "nope").first()["level"] == "CRITICAL"
    assert profile.validate(df.limit(0), "y").first()["check"] == "empty"
    one = profile.validate(df.withColumn("y", F.lit(1)), "y")
    assert one.filter("check = 'one_class' and level = 'CRITICAL'").count() == 1


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None)], "a int, b int")
    assert clean.duplicate_rows(df).first()["duplicates"] == 1


def test_normalise_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert v.normalise_missing(df).filter("x is not null").count() == 1


# ---------------------------------------------------------------- splits
def split_of(df, seed=42, parts=1):
    return {r["id"]: r["split"] for r in splits.random_split(df.repartition(parts), "id", seed=seed).collect()}


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(500)
    assert split_of(df, parts=1) == split_of(df, parts=8)
    assert split_of(df, seed=1) != split_of(df, seed=2)
    assert sum(s == "test" for s in split_of(df).values()) == 100


def test_rows_that_share_an_id_are_split_to_the_row(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("row"), F.col("id").alias("x"), (F.col("id") % 2).alias("y")).repartition(5)
    assert splits.random_split(df, "row").filter("split = 'test'").count() == 200
    assert splits.stratified_split(df, "row", "y").filter("split = 'test'").count() == 200
    assert [r["count"] for r in splits.random_folds(df, "row").groupBy("fold").count().collect()] == [200] * 5
    assert [r["count"] for r in splits.stratified_folds(df, "row", "y").groupBy("fold").count().collect()] == [200] * 5
    parts = {r["split"]: r["count"] for r in splits.nested_split(df, "row").groupBy("split").count().collect()}
    assert parts == {"test": 200, "validation": 160, "train": 640}


def test_group_split_is_disjoint(spark):
    df = spark.range(200).withColumn("g", (F.col("id") / 10).cast("int"))
    out = splits.group_split(df, "g")
    assert splits.group_overlap(out, "g").isEmpty()
    assert out.filter("split = 'test'").select("g").distinct().count() == 4
    folds = splits.group_folds(df, "g", 5)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert {r["count"] for r in folds.groupBy("fold").count().collect()} == {40}


def test_group_folds_balance_a_giant_group(spark):
    df = spark.range(900).withColumn("g", F.when(F.col("id") < 300, F.lit(-1)).otherwise(F.col("id") % 150))
    loads = sorted(r["count"] for r in splits.group_folds(df, "g", 3).groupBy("fold").count().collect())
    assert loads == [300, 300, 300]


def test_time_split_keeps_the_gap(spark):
    df = spark.range(200).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 0 + (F.col("id") / 3).cast("int")))
    out = splits.time_split(df, "ts", "id", gap=10).toPandas()
    train, test = out[out.split == "train"].id, out[out.split == "test"].id
    assert len(test) == 40 and train.max() < test.min() and test.min() - train.max() == 11
    with pytest.raises(ValueError):
        splits.time_split(df, "ts", "id", gap=190)


def test_stratified_folds_spread_each_class(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    out = splits.stratified_folds(df, "id", "y", 5).groupBy("fold", "y").count().toPandas()
    for _, part in out.groupby("y"):
        assert part["count"].max() - part["count"].min() <= 1
    sizes = out.groupby("fold")["count"].sum()
    assert sizes.max() - sizes.min() <= 1


def test_downgrades():
    assert splits.resolve("nope", True, False)[0] == "random"
    assert splits.resolve("group", True, False)[0] == "random"
    assert splits.resolve("stratified", False, True)[0] == "random"
    with pytest.raises(ValueError):
        splits._check(4)


# ---------------------------------------------------------------- leakage
def test_leakage(spark):
    df = spark.range(100).select(
        "id", F.rand(1).alias("a"), (F.col("id") % 2).alias("leak"), (F.col("id") % 2).alias("y"),
        F.rand(2).alias("glucose_level"), F.rand(3).alias("insulin_dose"),
    )
    generic = {(r["column"], r["kind"]) for r in leakage.screen(df, "y", row_id="id").collect()}
    assert generic == {("leak", "duplicate")}
    domain = {(r["column"], r["kind"]) for r in leakage.screen(df, "y", "diabetes", row_id="id").collect()}
    assert {("glucose_level", "name_proxy"), ("insulin_dose", "name_proxy")} <= domain
    assert "leak" not in leakage.apply_screen(df, leakage.screen(df, "y", row_id="id")).columns


# ---------------------------------------------------------------- preprocessing
def test_training_rows_alone_decide_parameters(spark):
    pdf = pd.DataFrame({"id": range(100), "a": np.arange(100.0), "b": ["x", "y"] * 50, "split": ["train"] * 80 + ["test"] * 20})
    df = spark.createDataFrame(pdf)
    changed = spark.createDataFrame(pdf.assign(a=np.where(pdf.split == "test", 1e9, pdf.a), b=np.where(pdf.split == "test", "z", pdf.b)))
    first, second = (prep.fit_preprocessor(d, ["id"]) for d in (df, changed))
    assert first.numeric.params == second.numeric.params and first.categorical == second.categorical
    out = second.transform(changed).filter("split = 'test'").toPandas()
    assert (out[["b_x", "b_y"]].to_numpy() == 0).all()


@pytest.mark.parametrize("impute", ["mean", "median", "most_frequent", "constant"])
@pytest.mark.parametrize("scaler", ["standard", "minmax", "robust", "none"])
def test_numeric_fit_equals_direct(spark, impute, scaler):
    x = np.array([1.0, 2, 2, np.nan, 9, np.inf, 4])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = prep.fit_numeric(df, ["x"], impute, scaler).transform(df).toPandas()["x"].to_numpy()
    seen = x[np.isfinite(x)]
    fill = {"mean": seen.mean(), "median": np.median(seen), "most_frequent": 2.0, "constant": 0.0}[impute]
    z = np.where(np.isfinite(x), x, fill)
    q = np.percentile(z, [25, 50, 75])
    want = {
        "standard": (z - z.mean()) / z.std(), "minmax": (z - z.min()) / np.ptp(z),
        "robust": (z - q[1]) / (q[2] - q[0]), "none": z,
    }[scaler]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_rare_levels_and_modalities(spark):
    df = spark.createDataFrame([(f"l{i % 40}",) for i in range(400)] + [("l0",)] * 9, "c string")
    fit = prep.fit_categorical(df, ["c"])
    assert len(fit.names()) == 30 and fit.rare["c"] and "l0" in fit.levels["c"]
    rows = [(i, 30 + i, "word " * 20, f"scan_{i}.png", i % 3, 1.5, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, age int, note_text string, scan_path string, gene_001 int, gene_002 double, outcome int")
    blocks = modality.infer_modalities(df, "outcome", ["id"])
    assert blocks == {"image": ["scan_path"], "text": ["note_text"], "genomic": ["gene_001", "gene_002"], "tabular": ["age"]}
    assert modality.genomic_encoding(df, ["gene_001"]) == "snp"
    assert modality.genomic_encoding(df, ["gene_002"]) == "expression"


def test_checkpoints_use_the_configured_folder(spark, tmp_path):
    from tidemark import session

    spark.conf.set("spark.checkpoint.dir", f"file:{tmp_path}") if spark.conf.isModifiable("spark.checkpoint.dir") else None
    found = session.shared_dir(spark)
    assert found == spark.conf.get("spark.checkpoint.dir", None) or found == spark.sparkContext.getCheckpointDir()
    assert session.scratch_path(spark, "x").startswith(found.rstrip("/"))


def test_few_large_files_are_spread_by_their_bytes(spark, tmp_path, monkeypatch):
    from tidemark import session

    spark.range(200_000).coalesce(1).write.parquet(str(tmp_path / "one file"))
    df = spark.read.parquet(str(tmp_path / "one file"))
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(df).rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "SPLIT_BYTES", 10_000)
    parts = session.spread(df).rdd.getNumPartitions()
    assert parts > 4 * cores and session.spread(df).count() == 200_000
