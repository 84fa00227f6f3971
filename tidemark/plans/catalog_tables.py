"""Queries over tables: scans, cleaning, profiling, splits, leakage, preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators import clean, leakage, prep, profile, splits
from tidemark.plans.registry import query, table
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources import sinks, tables


def lineitem_row(df):
    return df.withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


# ---------------------------------------------------------------- sources
@query(
    "scan_by_suffix",
    """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice) / 1000, 1) AS total_k
       FROM orders GROUP BY o_orderpriority""",
)
def scan_by_suffix(spark, sf):
    df = tables.read_table(spark, f"{sf}/orders.parquet")
    return df.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice") / 1000, 1).alias("total_k")
    )


@query(
    "csv_scan",
    """SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first_key,
              round(avg(c_acctbal), 4) AS mean_balance
       FROM customer GROUP BY c_mktsegment""",
)
def csv_scan(spark, sf):
    path = sinks.write_table(table(spark, sf, "customer"), "customer", "csv")
    df = tables.read_table(
        spark, path + "/*.csv",
        schema="c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    )
    return df.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"),
        F.round(F.avg("c_acctbal"), 4).alias("mean_balance"),
    )


@query(
    "compressed_scan",
    """SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 1) AS total
       FROM part GROUP BY p_brand""",
)
def compressed_scan(spark, sf):
    path = sinks.write_table(table(spark, sf, "part"), "part", "csv", compression="gzip")
    df = tables.read_table(
        spark, path + "/*.csv.gz",
        schema="p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    )
    return df.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 1).alias("total")
    )


TABLE_COLUMNS = {
    "benchmark": "item_id, text",
    "conversations": "conv_id, turn, role, text",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "labels": "doc_id, quality, toxic",
    "nation": "n_nationkey, n_name, n_regionkey",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "region": "r_regionkey, r_name",
    "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
}


@query(
    "folder_preview",
    " UNION ALL ".join(
        f"""SELECT '{name}.parquet' AS file, (SELECT count(*) FROM {name}) AS rows,
            CAST({len(cols.split(', '))} AS BIGINT) AS columns, 'ok' AS status,
            '{cols}' AS column_preview"""
        for name, cols in TABLE_COLUMNS.items()
    ),
)
def folder_preview(spark, sf):
    found = tables.read_folder(spark, sf, "*.parquet")
    chosen = {f"{n}.parquet": found[f"{n}.parquet"] for n in TABLE_COLUMNS}
    return tables.describe_tables(chosen)


@query(
    "stack_sources",
    """SELECT source_file, count(*) AS n, count(o_orderdate) AS with_date,
              round(sum(o_totalprice) / 1000, 1) AS total_k
       FROM (SELECT 'open' AS source_file, o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O'
             UNION ALL
             SELECT 'filled', o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderstatus = 'F')
       GROUP BY source_file""",
)
def stack_sources(spark, sf):
    orders = table(spark, sf, "orders")
    parts = {
        "open": orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice", "o_orderdate"),
        "filled": orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"),
    }
    return tables.stack(parts).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderdate").alias("with_date"),
        F.round(F.sum("o_totalprice") / 1000, 1).alias("total_k"),
    )


@query(
    "stack_report",
    """WITH a AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'O')
       SELECT 'extra' AS "column", CAST(1 AS BIGINT) AS tables, b.n AS rows, a.n AS rows_missing, false AS in_every_table FROM a, b
       UNION ALL SELECT 'o_orderkey', 2, a.n + b.n, 0, true FROM a, b UNION ALL SELECT 'o_totalprice', 2, a.n + b.n, 0, true FROM a, b""",
)
def stack_report(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    first = orders.filter("o_orderstatus = 'O'").drop("o_orderstatus")
    second = orders.filter("o_orderstatus <> 'O'").drop("o_orderstatus").withColumn("extra", F.col("o_orderkey") % 7)
    return tables.stack_report({"a": first, "b": second})


MERGE_SQL = """
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
     b AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1)
"""


@query(
    "merge_sources",
    """SELECT c.c_mktsegment, count(*) AS n, count(o.o_orderkey) AS with_order,
              round(sum(o.o_totalprice) / 1000, 1) AS total_k
       FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
       GROUP BY c.c_mktsegment""",
)
def merge_sources(spark, sf):
    left = table(spark, sf, "customer").withColumnRenamed("c_custkey", "custkey")
    right = table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey")
    merged = tables.merge({"customer.csv": left, "orders.csv": right}, "custkey", "left")
    return merged.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("with_order"),
        F.round(F.sum("o_totalprice") / 1000, 1).alias("total_k"),
    )


@query(
    "merge_report",
    MERGE_SQL
    + """SELECT 0 AS step, 'customer.csv' AS file, CAST(sum(n) AS BIGINT) AS rows_before,
                CAST(sum(n) AS BIGINT) AS rows_after, count(k) AS unique_keys, '' AS suffixed,
                1.0 AS kept_share, false AS warning FROM b
         UNION ALL
         SELECT 1, 'orders.csv', (SELECT CAST(sum(n) AS BIGINT) FROM b),
                (SELECT CAST(sum(a.n * b.n) AS BIGINT) FROM a JOIN b USING (k)),
                (SELECT count(k) FROM a), 'comment',
                round((SELECT sum(a.n * b.n) FROM a JOIN b USING (k)) / (SELECT sum(n) FROM b), 6),
                (SELECT sum(a.n * b.n) FROM a JOIN b USING (k)) / (SELECT sum(n) FROM b) < 0.9""",
)
def merge_report(spark, sf):
    left = table(spark, sf, "customer").withColumnRenamed("c_custkey", "custkey").withColumn("comment", F.lit("c"))
    right = table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey").withColumn("comment", F.lit("o"))
    out = tables.merge_report({"customer.csv": left, "orders.csv": right}, "custkey", "inner")
    return out.withColumn("kept_share", F.round("kept_share", 6))


@query(
    "mixed_load",
    """SELECT 'merge' AS mode, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey
       UNION ALL SELECT 'stack', 2 * count(*) FROM orders
       UNION ALL SELECT 'single', count(*) FROM customer""",
)
def mixed_load(spark, sf):
    customer = table(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "key")
    cases = [
        tables.combine({"c": customer, "o": orders}, key="key"),
        tables.combine({"a": orders, "b": orders}, key="key"),
        tables.combine({"c": customer}),
    ]
    out = None
    for df, mode in cases:
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "header_normalise",
    "SELECT count(*) AS n, round(avg(s_acctbal), 4) AS balance FROM supplier",
)
def header_normalise(spark, sf):
    messy = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("  Balance "))
    df = tables.strip_names(messy, lower=True)
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("balance"), 4).alias("balance"))


@query(
    "manifest_scan",
    """SELECT d.lang, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS good
       FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang""",
)
def manifest_scan(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = tables.manifest(joined, "quality", drop=["doc_id", "toxic", "text"])
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query(
    "limited_scan",
    """SELECT user_id, event_id FROM (
         SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
                dense_rank() OVER (ORDER BY user_id) AS u FROM events)
       WHERE k <= 5 AND u <= 10""",
)
def limited_scan(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id")
    users = events.select("user_id").distinct().orderBy("user_id").limit(10)
    first = events.join(F.broadcast(users), "user_id", "left_semi")
    return clean.top_per_key(first, ["user_id"], [F.asc("event_id")], 5)


def run_records(spark, sf):
    """One result record per order priority, in a folder of its own; the fields differ by task."""
    runs = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))
    runs = runs.withColumn("i", F.substring("o_orderpriority", 1, 1).cast("int"))
    regression = F.to_json(F.struct(
        F.lit("regression").alias("task"), F.struct(F.col("o_orderpriority").alias("source"), F.col("n").alias("n_rows")).alias("dataset"),
        F.struct(F.col("i").alias("n_selected")).alias("feature_selection"), F.struct(F.col("mean").alias("rmse"), F.lit(0.5).alias("roc_auc")).alias("transformer"),
        F.struct(F.lit("mean").alias("kind"), F.col("n").alias("count"), (F.col("mean") + 0.25).alias("rmse")).alias("naive_baseline"), (40 + F.col("i")).alias("seed"),
    ))
    classes = F.to_json(F.struct(
        F.lit("classification").alias("task"), F.struct(F.col("n").alias("n_rows"), F.array("i", "n").alias("shape")).alias("dataset"),
        F.struct((F.col("i") / 8).alias("roc_auc")).alias("multimodal"), F.lit("text").alias("seed"), F.lit("none").alias("naive_baseline"),
    ))
    body = F.when(F.col("i") == 5, F.lit("{ cut off")).when(F.col("i") % 2 == 0, classes).otherwise(regression)
    path = scratch_path(spark, "runs")
    runs.select(F.concat(F.lit("run "), "i").alias("run"), body.alias("value")).coalesce(1).write.partitionBy("run").text(path)
    return tables.run_registry(spark, f"{path}/*/*.txt")


RUNS_SQL = """r AS (SELECT o_orderpriority AS p, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS i, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1)"""


@query(
    "run_registry",
    f"""WITH {RUNS_SQL} SELECT 'run ' || i AS run, CASE WHEN i = 5 THEN NULL WHEN i % 2 = 0 THEN 'classification' ELSE 'regression' END AS task, i <> 5 AS readable FROM r""",
)
def run_registry(spark, sf):
    """Records found under a glob; one of them is damaged."""
    return run_records(spark, sf).select("run", F.try_variant_get("record", "$.task", "string").alias("task"), F.col("record").isNotNull().alias("readable"))


@query(
    "run_index",
    f"""WITH {RUNS_SQL} SELECT 'run ' || i AS run, CASE WHEN i % 2 = 1 THEN p END AS source, CASE WHEN i % 2 = 0 THEN 'classification' ELSE 'regression' END AS task, n AS n_rows,
            CASE WHEN i % 2 = 1 THEN CAST(i AS BIGINT) END AS n_selected, CASE WHEN i % 2 = 0 THEN 'roc_auc' ELSE 'rmse' END AS metric, CASE WHEN i % 2 = 0 THEN i / 8.0 ELSE mean END AS value,
            CASE WHEN i % 2 = 1 THEN mean + 0.25 END AS naive_baseline, CASE WHEN i % 2 = 1 THEN CAST(40 + i AS BIGINT) END AS seed FROM r WHERE i <> 5""",
)
def run_index(spark, sf):
    """The comparison index over the same records."""
    return tables.run_index(run_records(spark, sf))


# ---------------------------------------------------------------- sinks
def count_text(written):
    """A count as digits alone; from ten million on, a double is written with an exponent."""
    return F.when(written.rlike("^[0-9]"), written.cast("double").cast("long").cast("string"))


@query(
    "feature_export",
    """SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id""",
)
def feature_export(spark, sf):
    features = table(spark, sf, "events").select("user_id", "ts", "value")
    path = sinks.export_features(features, "user_id", "ts", "value")
    read = spark.read.parquet(path)
    return read.groupBy(F.col("subject_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("target"), 2).alias("total")
    )


@query(
    "json_record",
    """SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(count(*) AS VARCHAR) END AS rows_text,
              CASE WHEN l_returnflag = 'R' THEN 'Infinity' ELSE CAST(count(*) AS VARCHAR) END AS inf_text
       FROM lineitem GROUP BY l_returnflag""",
)
def json_record(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).cast("double").alias("n"))
    special = counts.select(
        "l_returnflag",
        F.when(F.col("l_returnflag") == "A", F.lit(float("nan"))).otherwise(F.col("n")).alias("rows_text"),
        F.when(F.col("l_returnflag") == "R", F.lit(float("inf"))).otherwise(F.col("n")).alias("inf_text"),
    )
    path = sinks.write_record(special, "record")
    read = spark.read.schema("l_returnflag string, rows_text string, inf_text string").json(path)
    return read.select(
        "l_returnflag",
        F.col("rows_text").cast("double").cast("long").cast("string").alias("rows_text"),
        F.coalesce(count_text(F.col("inf_text")), F.col("inf_text")).alias("inf_text"),
    )


# ---------------------------------------------------------------- cleaning
@query(
    "drop_missing_target",
    """SELECT d.source, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source""",
)
def drop_missing_target(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return clean.drop_missing_target(joined, "quality").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "finite_values",
    """SELECT l_returnflag, count(x) AS kept, count(*) - count(x) AS dropped,
              round(avg(x), 6) AS mean
       FROM (SELECT l_returnflag, CASE WHEN l_discount > 0 THEN l_extendedprice / (l_discount * 100) END AS x FROM lineitem)
       GROUP BY l_returnflag""",
)
def finite_values(spark, sf):
    ratio = F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / (F.col("l_discount") * 100)).otherwise(F.lit(float("inf")))
    df = v.normalise_missing(table(spark, sf, "lineitem").select("l_returnflag", ratio.alias("x")))
    return df.groupBy("l_returnflag").agg(
        F.count("x").alias("kept"), (F.count(F.lit(1)) - F.count("x")).alias("dropped"),
        F.round(F.avg("x"), 6).alias("mean"),
    )


@query(
    "column_types",
    """SELECT 'numeric' AS kind, CAST(8 AS INTEGER) AS columns, count(l_orderkey) + count(l_partkey) + count(l_suppkey) + count(l_linenumber) + count(l_quantity) + count(l_extendedprice) + count(l_discount) + count(l_tax) AS cells FROM lineitem
       UNION ALL SELECT 'categorical', 2, count(l_returnflag) + count(l_linestatus) FROM lineitem
       UNION ALL SELECT 'datetime', 1, count(l_shipdate) FROM lineitem""",
)
def column_types(spark, sf):
    df = table(spark, sf, "lineitem")
    kinds = {"numeric": v.numeric_columns(df), "categorical": v.categorical_columns(df), "datetime": v.datetime_columns(df)}
    out = None
    for kind, columns in kinds.items():
        cells = sum([F.count(c) for c in columns], F.lit(0).cast("long"))
        part = df.select(*columns).agg(cells.alias("cells")).select(F.lit(kind).alias("kind"), F.lit(len(columns)).alias("columns"), "cells")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "time_slice",
    """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
       WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY event_type""",
)
def time_slice(spark, sf):
    start, end = F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")
    return clean.time_slice(table(spark, sf, "events"), "ts", start, end).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "usable_subjects",
    """SELECT user_id, count(*) AS n FROM events e
       WHERE EXISTS (SELECT 1 FROM events t WHERE t.user_id = e.user_id AND t.event_type = 'purchase')
         AND EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type <> 'purchase')
       GROUP BY user_id""",
)
def usable_subjects(spark, sf):
    events = table(spark, sf, "events")
    target = F.bool_or(F.col("event_type") == "purchase")
    signal = F.bool_or(F.col("event_type") != "purchase")
    # One combinable aggregate per user instead of two semi joins on a skewed key.
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), target.alias("t"), signal.alias("s")
    ).filter("t and s").select("user_id", "n")


@query(
    "plausibility_filter",
    """SELECT user_id, count(*) AS n, round(avg(value * 10), 6) AS mean_rr FROM events
       WHERE value * 10 > 300 AND value * 10 < 2000 GROUP BY user_id""",
)
def plausibility_filter(spark, sf):
    rr = F.col("value") * 10
    return table(spark, sf, "events").filter(clean.plausible(rr, 300, 2000)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(rr), 6).alias("mean_rr")
    )


@query(
    "coverage_pruning",
    """SELECT 'quality' AS feature, round(count(quality) / count(*), 6) AS coverage, count(quality) / count(*) >= 0.5 AS kept
       FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL
       SELECT 'n_chars', round(count(n_chars) / count(*), 6), count(n_chars) / count(*) >= 0.5 FROM documents""",
)
def coverage_pruning(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return clean.coverage(joined, ["quality", "n_chars"]).withColumn("coverage", F.round("coverage", 6))


@query(
    "label_encoding",
    """SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS label, n
       FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""",
)
def label_encoding(spark, sf):
    encoded = clean.encode_labels(table(spark, sf, "orders"), "o_orderpriority")
    return encoded.groupBy("o_orderpriority", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_tags",
    r"""SELECT p_name, p_type, regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_type || ')')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS tag,
               count(*) AS n FROM part GROUP BY ALL""",
)
def feature_tags(spark, sf):
    label = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "tag", v.feature_tag(label)
    )


@query(
    "dedupe_by_time",
    """SELECT user_id, day, value, event_id FROM (
         SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, value, event_id,
                row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS k FROM events)
       WHERE k = 1""",
)
def dedupe_by_time(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id", F.col("ts").cast("date").cast("string").alias("day"), "event_id", "value"
    )
    return clean.dedupe_first(events, ["user_id", "day"], ["event_id"])


@query(
    "duplicate_rows",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS rows,
              round(sum(n - 1) / sum(n), 6) AS share
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount, l_tax)""",
)
def duplicate_rows(spark, sf):
    narrow = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    return clean.duplicate_rows(narrow).withColumn("share", F.round("share", 6))


@query(
    "stable_time_sort",
    """SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey) AS pos FROM orders""",
)
def stable_time_sort(spark, sf):
    when = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    df = table(spark, sf, "orders").select("o_orderkey", when.alias("seen"))
    return clean.stable_rank(df, "seen", "o_orderkey").select("o_orderkey", "pos")


@query(
    "top_orders",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
)
def top_orders(spark, sf):
    """A top-k report."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    "top_variance",
    """SELECT feature FROM (
         SELECT 'l_quantity' AS feature, var_samp(l_quantity) AS v FROM lineitem UNION ALL
         SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem UNION ALL
         SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL
         SELECT 'l_tax', var_samp(l_tax) FROM lineitem) ORDER BY v DESC LIMIT 2""",
)
def top_variance(spark, sf):
    df = table(spark, sf, "lineitem")
    top = clean.highest_variance(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)
    return spark.createDataFrame([(c,) for c in top], "feature string")


@query(
    "unit_normalise",
    """SELECT user_id, event_type, count(*) AS n, CAST(bool_or(u) AS BOOLEAN) AS rescaled, round(sum(x), 3) AS total FROM (
         SELECT e.user_id, e.event_type, m.med < 35 AS u, CASE WHEN m.med < 35 THEN e.value * 18.018 ELSE e.value END AS x
         FROM events e JOIN (SELECT user_id, event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY ALL) m USING (user_id, event_type))
       GROUP BY user_id, event_type""",
)
def unit_normalise(spark, sf):
    df = clean.normalise_units(table(spark, sf, "events"), ["user_id", "event_type"], "value")
    return df.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("unit") == "converted").alias("rescaled"),
        F.round(F.sum("value"), 3).alias("total"),
    )


@query(
    "axis_magnitude",
    """SELECT l_returnflag, count(*) AS n, round(avg(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)), 6) AS mean_magnitude
       FROM lineitem GROUP BY l_returnflag""",
)
def axis_magnitude(spark, sf):
    df = table(spark, sf, "lineitem").withColumnsRenamed({"l_quantity": "x", "l_discount": "y", "l_tax": "z"})
    axes = clean.pick_channel(df.select("x", "y", "z"), "accel")
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(clean.magnitude(*[F.col(a) for a in axes])), 6).alias("mean_magnitude"),
    )


@query(
    "interval_unit_repair",
    """SELECT user_id, count(*) AS n, round(avg(abs(CASE WHEN m.med < 10 THEN value * 1000 ELSE value END)), 4) AS mean_rr
       FROM events JOIN (SELECT user_id, quantile_cont(abs(value), 0.5) AS med FROM events GROUP BY 1) m USING (user_id)
       GROUP BY user_id""",
)
def interval_unit_repair(spark, sf):
    df = clean.repair_intervals(table(spark, sf, "events").select("user_id", "value"), ["user_id"], "value")
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_rr"))


# ---------------------------------------------------------------- profiling
PROFILE_COLUMNS = {
    "l_linenumber": "int", "l_quantity": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


@query(
    "profile_columns",
    " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS "column", '{t}' AS dtype, count(*) AS rows,
            count(*) - count({c}) AS missing, 0.0 AS missing_pct, count(DISTINCT {c}) AS "distinct" FROM lineitem"""
        for i, (c, t) in enumerate(PROFILE_COLUMNS.items())
    ),
)
def profile_columns(spark, sf):
    return profile.summary(table(spark, sf, "lineitem").select(*PROFILE_COLUMNS))


@query(
    "task_inference",
    """SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS "distinct", 'classification' AS task FROM lineitem
       UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), 'classification' FROM lineitem
       UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), 'regression' FROM lineitem
       UNION ALL SELECT 'l_tax', count(DISTINCT l_tax), 'regression' FROM lineitem""",
)
def task_inference(spark, sf):
    return profile.infer_tasks(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber", "l_extendedprice", "l_tax"]
    )


@query(
    "mode_share",
    " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS mode, (SELECT count({c}) FROM lineitem) AS present,
             (SELECT count(DISTINCT {c}) FROM lineitem) AS "distinct",
             round(count(*) / (SELECT count({c}) FROM lineitem), 6) AS mode_share
             FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"""
        for c in ("l_returnflag", "l_linestatus", "l_linenumber")
    ),
)
def mode_share(spark, sf):
    out = profile.mode_share(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return out.withColumn("mode_share", F.round("mode_share", 6))


@query(
    "validation_report",
    """SELECT 'WARNING' AS level, 'always_one' AS "column", 'constant' AS "check" FROM (SELECT count(*) AS c FROM documents) WHERE c > 0
       UNION ALL SELECT 'WARNING', 'rarely', 'missing' FROM (SELECT count(*) AS c FROM documents) WHERE c > 0
       UNION ALL SELECT 'NOTE', 'nearly', 'near_constant' FROM (SELECT sum(CASE WHEN doc_id % 200 = 0 THEN 1 ELSE 0 END) / count(*) AS r FROM documents) WHERE 1 - r > 0.99
       UNION ALL SELECT 'WARNING', 'inverse', 'infinite' FROM (SELECT count(*) AS c FROM documents WHERE doc_id = 0) WHERE c > 0
       UNION ALL SELECT 'NOTE', 'text', 'cardinality' FROM (SELECT count(DISTINCT text) AS d, count(*) AS c FROM documents) WHERE d > 50 AND d > 0.5 * c
       UNION ALL SELECT 'WARNING', 'quality', 'target_missing' FROM (SELECT count(*) - count(quality) AS m FROM documents LEFT JOIN labels USING (doc_id)) WHERE m > 0""",
)
def validation_report(spark, sf):
    docs = table(spark, sf, "documents").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    wide = docs.withColumns(
        {
            "always_one": F.lit(1),
            "rarely": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")),
            "nearly": (F.col("doc_id") % 200 == 0).cast("int"),
            "inverse": F.when(F.col("doc_id") == 0, F.lit(float("inf"))).otherwise(1.0 / F.col("doc_id")),
        }
    )
    return profile.validate(wide, "quality").select("level", "column", "check")


@query(
    "naive_class",
    """SELECT quality AS majority_class, round(count(*) / (SELECT count(*) FROM labels), 6) AS accuracy
       FROM labels GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1""",
)
def naive_class(spark, sf):
    return profile.naive_class(table(spark, sf, "labels"), "quality").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "naive_regression",
    """SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS rmse,
              round(avg(abs(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem))), 4) AS mae FROM lineitem""",
)
def naive_regression(spark, sf):
    out = profile.naive_regression(table(spark, sf, "lineitem"), "l_extendedprice")
    return out.select(*[F.round(c, 4).alias(c) for c in ("mean", "rmse", "mae")])


@query(
    "class_imbalance",
    """SELECT count(*) AS classes, min(n) AS smallest, max(n) AS largest, round(min(n) / max(n), 6) AS ratio
       FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)""",
)
def class_imbalance(spark, sf):
    return profile.imbalance(table(spark, sf, "labels"), "toxic").withColumn("ratio", F.round("ratio", 6))


@query(
    "dataset_facts",
    """SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, CAST(4 AS INTEGER) AS n_features FROM orders""",
)
def dataset_facts(spark, sf):
    return profile.dataset_facts(table(spark, sf, "orders"), "o_totalprice", "o_custkey")


# ---------------------------------------------------------------- splits
def md5_sql(*parts: str, seed: int = 42) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"substr(md5('{seed}|' || {joined}), 1, 15)"


@query(
    "split_random",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {md5_sql('o_orderkey')}) <= ceil(0.2 * count(*) OVER ())
               THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def split_random(spark, sf):
    return splits.random_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "split_group",
    f"""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY {md5_sql('o_custkey')}) AS k, count(*) OVER () AS n
                   FROM (SELECT DISTINCT o_custkey FROM orders))
        SELECT o_orderkey, o_custkey, CASE WHEN k <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split
        FROM orders JOIN g USING (o_custkey)""",
)
def split_group(spark, sf):
    return splits.group_split(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


STRATA_SQL = f"""
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
     t AS (SELECT CAST(ceil(0.2 * sum(n)) AS BIGINT) AS wanted, sum(n) AS total FROM c),
     q AS (SELECT o_orderpriority, n, CAST(floor(n * wanted / total) AS BIGINT) AS base, n * wanted / total - floor(n * wanted / total) AS rest, wanted FROM c, t),
     r AS (SELECT o_orderpriority, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, o_orderpriority) <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q)
"""


@query(
    "split_stratified",
    STRATA_SQL
    + f"""SELECT o_orderkey, o_orderpriority,
            CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY {md5_sql('o_orderkey')}) <= quota THEN 'test' ELSE 'train' END AS split
          FROM orders JOIN r USING (o_orderpriority)""",
)
def split_stratified(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return splits.stratified_split(df, "o_orderkey", "o_orderpriority")


@query(
    "split_time",
    """SELECT o_orderkey, CASE WHEN p > n - t THEN 'test' WHEN p > n - t - 25 THEN 'gap' ELSE 'train' END AS split
       FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS p, count(*) OVER () AS n,
                    CAST(round_even(count(*) OVER () * 0.2, 0) AS BIGINT) AS t FROM orders)""",
)
def split_time(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return splits.time_split(df, "o_orderdate", "o_orderkey", gap=25).select("o_orderkey", "split")


@query(
    "split_nested",
    f"""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY {md5_sql('o_orderkey')}) <= ceil(0.2 * count(*) OVER ()) AS test FROM orders),
        b AS (SELECT o_orderkey, row_number() OVER (ORDER BY {md5_sql('o_orderkey', seed=43)}) <= ceil(0.2 * count(*) OVER ()) AS val FROM a WHERE NOT test)
        SELECT o_orderkey, CASE WHEN test THEN 'test' WHEN val THEN 'validation' ELSE 'train' END AS split FROM a LEFT JOIN b USING (o_orderkey)""",
)
def split_nested(spark, sf):
    return splits.nested_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "folds_random",
    f"""SELECT o_orderkey, CAST(CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1)
                 ELSE (n % 5) + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
        FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {md5_sql('o_orderkey')}) - 1 AS p, count(*) OVER () AS n FROM orders)""",
)
def folds_random(spark, sf):
    return splits.random_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "folds_stratified",
    f"""WITH s AS (SELECT doc_id, quality, row_number() OVER (ORDER BY quality, {md5_sql('doc_id')}) - 1 AS p,
                          row_number() OVER (PARTITION BY quality ORDER BY {md5_sql('doc_id')}) AS r FROM labels),
             f AS (SELECT quality, p % 5 AS fold, count(*) AS n FROM s GROUP BY ALL),
             e AS (SELECT quality, fold, sum(n) OVER (PARTITION BY quality ORDER BY fold) AS upto, sum(n) OVER (PARTITION BY quality ORDER BY fold) - n AS before FROM f)
        SELECT s.doc_id, s.quality, CAST(e.fold AS INTEGER) AS fold FROM s JOIN e ON s.quality = e.quality AND s.r > e.before AND s.r <= e.upto""",
)
def folds_stratified(spark, sf):
    return splits.stratified_folds(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(
    "folds_group",
    """SELECT CAST(5 AS BIGINT) AS folds, count(DISTINCT o_custkey) AS groups, CAST(1 AS BIGINT) AS folds_per_group,
              count(*) AS rows, true AS balanced FROM orders""",
)
def folds_group(spark, sf):
    placed = splits.group_folds(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    per_group = placed.groupBy("o_custkey").agg(
        F.min("fold").alias("lo"), F.max("fold").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    loads = per_group.groupBy("lo").agg(
        F.sum("n").alias("load"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("big"),
        F.max(F.col("hi") - F.col("lo") + 1).cast("long").alias("spread"),
    )
    return loads.agg(
        F.count(F.lit(1)).alias("folds"), F.sum("groups").alias("groups"),
        F.max("spread").alias("folds_per_group"), F.sum("load").alias("rows"),
        (F.max("load") - F.min("load") <= F.max("big")).alias("balanced"),
    )


@query(
    "folds_time",
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
            f AS (SELECT CAST(i AS INTEGER) AS fold FROM range(5) t(i))
       SELECT fold, side, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (
         SELECT o_orderkey, fold, CASE WHEN p < n - (5 - fold) * (n // 6) - 10 THEN 'train'
                WHEN p >= n - (5 - fold) * (n // 6) AND p < n - (4 - fold) * (n // 6) THEN 'test' END AS side
         FROM p, f) WHERE side IS NOT NULL GROUP BY ALL""",
)
def folds_time(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return splits.time_folds(df, "o_orderdate", "o_orderkey", 5, 10).groupBy("fold", "side").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")
    )


@query(
    "group_overlap",
    f"""WITH s AS (SELECT o_custkey, row_number() OVER (ORDER BY {md5_sql('o_orderkey')}) <= ceil(0.2 * count(*) OVER ()) AS test FROM orders)
        SELECT o_custkey FROM s WHERE test INTERSECT SELECT o_custkey FROM s WHERE NOT test""",
)
def group_overlap(spark, sf):
    return splits.group_overlap(splits.random_split(table(spark, sf, "orders"), "o_orderkey"), "o_custkey")


# ---------------------------------------------------------------- leakage
LEAK_COLUMNS = ["l_quantity", "l_discount", "copy", "nearly", "scaled"]


def leak_frame(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        price.alias("target"), "l_quantity", "l_discount", price.alias("copy"),
        (price * 1.000001).alias("nearly"), (price * 2 + F.col("l_quantity")).alias("scaled"),
    )


@query(
    "leak_exact",
    """SELECT * FROM (VALUES ('l_quantity', false), ('l_discount', false), ('copy', true), ('nearly', true), ('scaled', false)) t("column", duplicate)
       WHERE (SELECT count(*) FROM lineitem) > 0""",
)
def leak_exact(spark, sf):
    return leakage.exact_duplicates(leak_frame(spark, sf), "target")


@query(
    "leak_correlation",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, round(corr({e}, l_extendedprice), 6) AS r, abs(corr({e}, l_extendedprice)) >= 0.95 AS flagged FROM lineitem"""
        for c, e in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("scaled", "l_extendedprice * 2 + l_quantity"))
    ),
)
def leak_correlation(spark, sf):
    out = leakage.target_correlations(leak_frame(spark, sf), "target", ["l_quantity", "l_discount", "scaled"])
    return out.withColumn("r", F.round("r", 6))


@query(
    "leak_map",
    """SELECT 'l_returnflag' AS "column", count(*) AS "distinct", count(*) BETWEEN 2 AND 50 AND bool_and(d <= 1) AS deterministic
         FROM (SELECT count(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY l_returnflag)
       UNION ALL SELECT 'status_copy', count(*), count(*) BETWEEN 2 AND 50 AND bool_and(d <= 1)
         FROM (SELECT count(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY lower(l_linestatus))
       UNION ALL SELECT 'l_linenumber', count(*), count(*) BETWEEN 2 AND 50 AND bool_and(d <= 1)
         FROM (SELECT count(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY l_linenumber)""",
)
def leak_map(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("status_copy", F.lower("l_linestatus"))
    return leakage.deterministic_maps(df, "l_linestatus", ["l_returnflag", "status_copy", "l_linenumber"])


@query(
    "leak_names",
    """SELECT 'insulin_units' AS "column", 'insulin' AS term, count(p_size) AS present FROM part
       UNION ALL SELECT 'quality_score', 'score', count(p_retailprice) FROM part UNION ALL SELECT 'p_label', 'label', count(p_name) FROM part""",
)
def leak_names(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", "p_brand", F.col("p_size").alias("insulin_units"),
        F.col("p_retailprice").alias("quality_score"), F.col("p_name").alias("p_label"),
    )
    hits = leakage.name_proxies(leakage.catalogue(df), leakage.rule_table(spark, "diabetes"))
    present = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "present")
    return hits.join(present, "column")


@query(
    "leak_codes",
    r"""WITH h AS (SELECT 'E1' || CAST(p_size % 8 AS VARCHAR) AS code FROM part)
        SELECT 'code' AS "column", p AS pattern, round(avg(CASE WHEN regexp_matches(code, p, 'i') THEN 1.0 ELSE 0.0 END), 6) AS share,
               avg(CASE WHEN regexp_matches(code, p, 'i') THEN 1.0 ELSE 0.0 END) > 0.1 AS flagged
        FROM h, (VALUES ('^250(\.\d+)?$'), ('^E0[89]'), ('^E1[0-3]')) t(p) GROUP BY p""",
)
def leak_codes(spark, sf):
    code = F.concat(F.lit("E1"), (F.col("p_size") % 8).cast("string"))
    df = table(spark, sf, "part").select("p_partkey", code.alias("code"))
    out = leakage.code_columns(df, "diabetes", ["code"])
    return out.withColumn("share", F.round("share", 6))


@query(
    "leak_temporal_names",
    """SELECT 'o_orderdate' AS "column", count(DISTINCT o_orderdate) AS "distinct" FROM orders""",
)
def leak_temporal_names(spark, sf):
    orders = table(spark, sf, "orders")
    found = leakage.temporal_names(leakage.catalogue(orders, "o_totalprice"))
    names = [r["column"] for r in found.collect()]
    return found.join(profile.distinct_counts(orders, names), "column")


@query(
    "leak_screen_train",
    """SELECT * FROM (VALUES ('copy', 'duplicate', 'exclude'), ('nearly', 'duplicate', 'exclude'), ('scaled', 'high_correlation', 'flag')) t("column", kind, action)
       WHERE (SELECT count(*) FROM lineitem) > 0""",
)
def leak_screen_train(spark, sf):
    price = F.col("l_extendedprice")
    df = lineitem_row(table(spark, sf, "lineitem")).select(
        "row_id", price.alias("goal"), "l_quantity", "l_discount", price.alias("copy"),
        (price * 1.000001).alias("nearly"), (price * 2 + F.col("l_quantity")).alias("scaled"),
    )
    parted = splits.random_split(df, "row_id")
    # The copy differs from the target on test rows, which the screen must not see.
    spoiled = parted.withColumn("copy", F.when(F.col("split") == "test", F.lit(0.0)).otherwise(F.col("copy")))
    spoiled = cut_lineage(spoiled)
    return leakage.screen(spoiled, "goal", row_id="row_id").select("column", "kind", "action")


# ---------------------------------------------------------------- preprocessing
@query(
    "impute_scale",
    f"""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS q, l_extendedprice AS p,
                   row_number() OVER (ORDER BY {md5_sql('l_orderkey * 10 + l_linenumber')}) <= ceil(0.2 * count(*) OVER ()) AS test FROM lineitem),
             m AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(p, 0.5) AS mp FROM s WHERE NOT test),
             f AS (SELECT row_id, test, coalesce(q, mq) AS q, coalesce(p, mp) AS p FROM s, m),
             k AS (SELECT avg(q) AS aq, stddev_pop(q) AS sq, avg(p) AS ap, stddev_pop(p) AS sp FROM f WHERE NOT test)
        SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(avg((q - aq) / sq) + 0.0, 6) + 0.0 AS mean_q,
               round(stddev_pop((q - aq) / sq), 6) AS sd_q, round(min((p - ap) / sp), 6) AS min_p, round(max((p - ap) / sp), 6) AS max_p
        FROM f, k GROUP BY test""",
)
def impute_scale(spark, sf):
    df = lineitem_row(table(spark, sf, "lineitem")).select(
        "row_id", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"),
        F.col("l_extendedprice").alias("p"),
    )
    parted = cut_lineage(splits.random_split(df, "row_id"))
    out = prep.fit_numeric(parted, ["q", "p"]).transform(parted)
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), (F.round(F.avg("q"), 6) + 0.0).alias("mean_q"),
        F.round(F.stddev_pop("q"), 6).alias("sd_q"), F.round(F.min("p"), 6).alias("min_p"),
        F.round(F.max("p"), 6).alias("max_p"),
    )


@query(
    "robust_minmax_scale",
    """WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr,
                         min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
       SELECT l_returnflag, round(avg((l_quantity - med) / iqr), 6) + 0.0 AS robust_mean, round(avg((l_extendedprice - lo) / (hi - lo)), 6) AS minmax_mean
       FROM lineitem, m GROUP BY l_returnflag""",
)
def robust_minmax_scale(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    out = prep.fit_numeric(df, ["l_quantity"], scaler="robust").transform(df)
    out = prep.fit_numeric(df, ["l_extendedprice"], scaler="minmax").transform(out)
    return out.groupBy("l_returnflag").agg(
        (F.round(F.avg("l_quantity"), 6) + 0.0).alias("robust_mean"),
        F.round(F.avg("l_extendedprice"), 6).alias("minmax_mean"),
    )


@query(
    "onehot_rare",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
            r AS (SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM c)
       SELECT CASE WHEN k <= 9 THEN 'p_brand_' || p_brand ELSE 'p_brand_infrequent_sklearn' END AS feature, CAST(sum(n) AS DOUBLE) AS total
       FROM r GROUP BY 1""",
)
def onehot_rare(spark, sf):
    df = table(spark, sf, "part").select("p_brand")
    fit = prep.fit_categorical(df, ["p_brand"], max_levels=10)
    coded = fit.one_hot(df)
    names = fit.names()
    return coded.agg(*[F.sum(f"`{c}`").alias(c) for c in names]).unpivot([], [F.col(f"`{c}`") for c in names], "feature", "total")


@query(
    "ordinal_codes",
    """WITH t AS (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'),
            k AS (SELECT p, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS code FROM t)
       SELECT o_orderpriority, coalesce(k.code, -1) AS code, count(*) AS n FROM orders LEFT JOIN k ON p = o_orderpriority GROUP BY ALL""",
)
def ordinal_codes(spark, sf):
    df = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    known = df.filter("o_orderstatus <> 'P' and o_orderpriority <> '5-LOW'")
    fit = prep.fit_categorical(known, ["o_orderpriority"], max_levels=None)
    out = df.withColumn("code", F.col("o_orderpriority"))
    fit.levels["code"], fit.modes["code"] = fit.levels["o_orderpriority"], fit.modes["o_orderpriority"]
    return prep.ordinal_encode(out, ["code"], fit).groupBy("o_orderpriority", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "categorical_mode_fill",
    """WITH d AS (SELECT CASE WHEN n_chars % 4 = 0 THEN NULL ELSE lang END AS lang FROM documents),
            m AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
       SELECT coalesce(d.lang, (SELECT lang FROM m)) AS lang, count(*) AS n FROM d GROUP BY 1""",
)
def categorical_mode_fill(spark, sf):
    df = table(spark, sf, "documents").select(F.when(F.col("n_chars") % 4 != 0, F.col("lang")).alias("lang"))
    fit = prep.fit_categorical(df, ["lang"])
    return df.select(fit.filled("lang").alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "median_fill",
    """WITH d AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders),
            m AS (SELECT quantile_cont(x, 0.5) AS med FROM d)
       SELECT o_orderpriority, round(avg(coalesce(x, med)), 4) AS mean FROM d, m GROUP BY 1""",
)
def median_fill(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("x")
    )
    return clean.median_fill(df, ["x"]).groupBy("o_orderpriority").agg(F.round(F.avg("x"), 4).alias("mean"))


@query(
    "target_standardise",
    """WITH m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders)
       SELECT o_orderpriority, round(avg((o_totalprice - a) / s), 6) + 0.0 AS mean, round(max(o_totalprice), 2) AS restored_max FROM orders, m GROUP BY 1""",
)
def target_standardise(spark, sf):
    df = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    mean, sd = prep.target_scale(df, "o_totalprice")
    scaled = prep.standardise_target(df, "o_totalprice").withColumn("back", F.col("y_scaled"))
    return prep.restore_target(scaled, "back", mean, sd).groupBy("o_orderpriority").agg(
        (F.round(F.avg("y_scaled"), 6) + 0.0).alias("mean"), F.round(F.max("back"), 2).alias("restored_max")
    )


@query(
    "class_weights",
    """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k, min(n) / max(n) AS r FROM c)
       SELECT toxic, n, CASE WHEN r < 0.4 THEN round(total / (k * n), 6) ELSE 1.0 END AS weight FROM c, t""",
)
def class_weights(spark, sf):
    df = table(spark, sf, "labels")
    weighted = prep.with_class_weight(df, "toxic", prep.class_weights(df, "toxic"))
    return weighted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query(
    "genomic_blocks",
    """WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s FROM lineitem)
       SELECT l_returnflag, round(max((l_quantity - a) / s), 6) AS top_z, CAST(sum(greatest(0, least(2, l_linenumber))) AS DOUBLE) AS snp_total
       FROM lineitem, m GROUP BY 1""",
)
def genomic_blocks(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_quantity").alias("gene_a"), F.col("l_linenumber").cast("double").alias("snp_a")
    )
    out = prep.snp_block(prep.expression_block(df, ["gene_a"]), ["snp_a"])
    return out.groupBy("l_returnflag").agg(
        F.round(F.max("gene_a"), 6).alias("top_z"), F.sum("snp_a").alias("snp_total")
    )
