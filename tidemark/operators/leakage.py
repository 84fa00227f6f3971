"""Target-leakage screens, computed on training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as v

# Terms that mark a column name as a stand-in for the target, per domain.
DOMAIN_TERMS = {
    "generic": (
        "target", "label", "ground truth", "true label", "outcome copy", "y true", "y pred",
        "prediction", "predicted", "score",
    ),
    "diabetes": (
        "glucose", "hba1c", "a1c", "glycated haemoglobin", "glycated hemoglobin", "insulin",
        "c peptide", "ogtt", "glucose tolerance", "fructosamine", "metformin", "glipizide",
        "glyburide", "pioglitazone", "sitagliptin", "liraglutide", "semaglutide",
        "antidiabetic", "diabetes diagnosis", "diabetes code", "diabetes medication",
    ),
    "mortality": (
        "death", "died", "deceased", "expire", "date of death", "dod", "discharge disposition",
        "hospice", "time of death",
    ),
    "readmission": (
        "readmit", "readmission", "days to readmission", "next admission", "return visit",
        "bounce back",
    ),
    "sepsis": (
        "sofa", "qsofa", "sirs", "vasopressor", "norepinephrine", "lactate", "blood culture",
        "antibiotic start",
    ),
}
# Diagnosis-code patterns per domain, and words that mark a temporal name.
CODE_PATTERNS = {"diabetes": (r"^250(\.\d+)?$", r"^E0[89]", r"^E1[0-3]")}
TEMPORAL_WORDS = ("date", "time", "timestamp", "datetime")

REPORT = "column string, kind string, action string, detail string"


def rule_table(spark, domain: str, extra: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(term) rows of the generic set plus the domain; ``extra`` replaces whole domains."""
    rules = {**DOMAIN_TERMS, **(extra or {})}
    names = {"generic", (domain or "generic").lower()}
    terms = sorted({t for name in names for t in rules.get(name, ())})
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    return frame.select(v.normalise_name(F.col("term")).alias("term")).filter("term <> ''").distinct()


def read_rules(spark, path: str) -> dict[str, list[str]]:
    """Domain term lists from a JSON-lines or Parquet table (domain, term)."""
    table = spark.read.parquet(path) if path.endswith((".parquet", ".pq")) else spark.read.json(path)
    out: dict[str, list[str]] = {}
    for row in table.select("domain", "term").collect():
        out.setdefault(row["domain"].lower(), []).append(row["term"])
    return out


def exact_duplicates(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns equal to the target, null-safe, or numerically close on complete pairs."""
    columns = list(columns or [c for c in df.columns if c != target])
    kind = df.schema[target].dataType
    numeric = set(v.numeric_columns(df))
    checks = []
    for c in columns:
        x, y = F.col(f"`{c}`"), F.col(f"`{target}`")
        same = F.bool_and(x.eqNullSafe(y)) if df.schema[c].dataType == kind else F.lit(False)
        if c in numeric and target in numeric:
            a, b = x.cast("double"), y.cast("double")
            pair = ~v.missing(df, c) & ~v.missing(df, target)
            near = (F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)) | (a == b)
            close = F.coalesce(F.bool_and(F.when(pair, near)), F.lit(False))
            same = same | close
        checks.append(same.alias(c))
    return df.agg(*checks).unpivot([], columns, "column", "duplicate")


def deterministic_maps(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Columns of 2 to 50 values where each value has at most one target value.

    One value maps to one target exactly when its smallest and largest target agree, so
    two combinable aggregates replace a distinct count. Columns an approximate count puts
    far above the bound are reported without being grouped.
    """
    columns = list(columns)
    rough = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    crowded = {c: rough[i] for i, c in enumerate(columns) if rough[i] > 100}
    columns = [c for c in columns if c not in crowded]
    y = F.when(~v.missing(df, target), F.col(f"`{target}`"))
    per_value = None
    for c in columns:
        part = (
            df.filter(~v.missing(df, c)).groupBy(F.col(f"`{c}`").alias("_v"))
            .agg(F.min(y).eqNullSafe(F.max(y)).alias("single"))
            .select(F.lit(c).alias("column"), "single")
        )
        per_value = part if per_value is None else per_value.unionByName(part)
    skipped = df.sparkSession.createDataFrame(
        [(c, n, False) for c, n in crowded.items()], "column string, distinct long, deterministic boolean"
    )
    if per_value is None:
        return skipped
    per_column = per_value.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), F.bool_and("single").alias("single")
    )
    return per_column.select(
        "column", "distinct",
        (F.col("distinct").between(2, 50) & F.col("single")).alias("deterministic"),
    ).unionByName(skipped)


def target_correlations(
    df: DataFrame, target: str, columns: Sequence[str], threshold: float = 0.95
) -> DataFrame:
    """Pearson r on complete pairs for every column in one aggregate."""
    y = v.finite(F.col(f"`{target}`"))
    stats = []
    for i, c in enumerate(columns):
        x = v.finite(F.col(f"`{c}`"))
        pair = x.isNotNull() & y.isNotNull()
        a, b = F.when(pair, x), F.when(pair, y)
        stats.append(
            F.struct(
                F.count(a).alias("n"),
                (F.min(a) < F.max(a)).alias("varies"),
                F.corr(a, b).alias("r"),
            ).alias(f"c{i}")
        )
    wide = df.agg(*stats)
    long = wide.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}.n"), F.col(f"c{i}.varies"), F.col(f"c{i}.r")) for i, c in enumerate(columns)])
        ).alias("s")
    ).select("s.*")
    usable = (F.col("n") >= 10) & F.col("varies") & ~F.isnan("r")
    return long.select(
        "column", "n", "r",
        F.coalesce(usable & (F.abs("r") >= threshold), F.lit(False)).alias("flagged"),
    )


def catalogue(df: DataFrame, target: str | None = None) -> DataFrame:
    rows = [(i, c) for i, c in enumerate(df.columns) if c != target]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string")


def name_proxies(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule term, alphabetically, contained in each normalised column name."""
    terms = F.array(*[F.lit(r["term"]) for r in rules.select("term").collect()])
    name = v.normalise_name(F.col("column"))
    hit = F.array_min(F.filter(terms, lambda t: name.contains(t)))
    return columns.select("column", hit.alias("term")).filter("term is not null")


def code_columns(df: DataFrame, domain: str, columns: Sequence[str]) -> DataFrame:
    """Share of each column's values that match each diagnosis-code pattern, from one aggregate."""
    patterns = CODE_PATTERNS.get((domain or "").lower(), ())
    cells = [(i, c, p) for i, c in enumerate(columns) for p in patterns]
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, pattern string, share double, flagged boolean")
    shares = [
        F.avg(F.col(f"`{c}`").cast("string").rlike("(?i)" + (p if p.startswith("^") else "^" + p)).cast("double")).alias(f"s{k}")
        for k, (_, c, p) in enumerate(cells)
    ]
    items = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(p).alias("pattern"), F.coalesce(F.col(f"s{k}"), F.lit(0.0)).alias("share"))
        for k, (i, c, p) in enumerate(cells)
    ]
    out = df.agg(*shares).select(F.inline(F.array(*items)))
    # Per pattern only the first matching column is flagged; one row per schema column.
    first = F.min(F.when(F.col("share") > 0.1, F.col("ordinal"))).over(Window.partitionBy("pattern"))
    return out.withColumn("flagged", F.coalesce(F.col("ordinal") == first, F.lit(False))).drop("ordinal")


def temporal_names(columns: DataFrame) -> DataFrame:
    name = v.normalise_name(F.col("column"))
    hit = F.lit(False)
    for word in TEMPORAL_WORDS:
        hit = hit | name.contains(word)
    return columns.filter(hit).select("column")


def screen(
    df: DataFrame,
    target: str,
    domain: str = "generic",
    threshold: float = 0.95,
    maps: bool = False,
    rules: DataFrame | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Whole report. With a ``split`` column present, only its training rows are read."""
    spark = df.sparkSession
    rows = df.filter("split = 'train'").drop("split", "fold") if "split" in df.columns else df
    if target not in rows.columns:
        note = [(target, "note", "note", "target absent; nothing screened")]
        return spark.createDataFrame(note, REPORT)
    features = [c for c in rows.columns if c not in (target, row_id)]
    found: list[tuple[str, str, str, str]] = []
    duplicate = {
        r["column"] for r in exact_duplicates(rows, target, features).filter("duplicate").collect()
    }
    found += [(c, "duplicate", "exclude", "equals the target") for c in sorted(duplicate)]
    left = [c for c in features if c not in duplicate]
    flagged: set[str] = set()
    if maps and left:
        for r in deterministic_maps(rows, target, left).filter("deterministic").collect():
            found.append((r["column"], "deterministic_map", "flag", f"{r['distinct']} values"))
            flagged.add(r["column"])
    if isinstance(rows.schema[target].dataType, (T.NumericType,)):
        numeric = [c for c in left if c in v.numeric_columns(rows)]
        if numeric:
            for r in target_correlations(rows, target, numeric, threshold).filter("flagged").collect():
                found.append((r["column"], "high_correlation", "flag", f"r={r['r']:.3f}"))
                flagged.add(r["column"])
    rules = rules if rules is not None else rule_table(spark, domain)
    names = catalogue(rows.select(*left), None)
    for r in name_proxies(names, rules).collect():
        if r["column"] not in flagged:
            found.append((r["column"], "name_proxy", "flag", f"name contains '{r['term']}'"))
    text = [c for c in left if c in v.categorical_columns(rows)]
    if text and CODE_PATTERNS.get(domain.lower()):
        order = row_id or left[0]
        for r in code_columns(rows, domain, text).filter("flagged").collect():
            found.append((r["column"], "diagnosis_code", "flag", f"matches {r['pattern']}"))
    for r in temporal_names(catalogue(rows.select(*features))).collect():
        found.append((r["column"], "temporal_name", "note", "looks temporal"))
    return spark.createDataFrame(found, REPORT)


def apply_screen(df: DataFrame, report: DataFrame, drop_flagged: bool = False) -> DataFrame:
    actions = ["exclude", "flag"] if drop_flagged else ["exclude"]
    doomed = {r[0] for r in report.filter(F.col("action").isin(actions)).select("column").collect()}
    kept = df.drop(*doomed)
    features = [c for c in kept.columns if c not in ("split", "fold")]
    if len(features) < 3:
        raise ValueError("fewer than two features are left after the leakage screen")
    return kept
