"""Statistical tables: tests, effect sizes, correlations.

Spark reduces the rows to sums, rank sums and counts; p-values are then functions of a
handful of scalars.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.functions import values as v
from tidemark.operators.clean import MAX_CLASSES
from tidemark.operators.ordering import Running, exact_quantiles, running, value_ranks
from tidemark.operators.profile import mode_share
from tidemark.operators.search import fold_moments
from tidemark.session import cut_lineage

# ---------------------------------------------------------------- normality
def moment_normality(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Jarque-Bera test per group from one aggregate, at any size: statistic ``jb`` and ``normal_p``.

    Groups of fewer than three values or without spread have no result.
    """
    x = v.finite(F.col(value))
    moments = long.groupBy(*keys).agg(F.count(x).alias("n"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess"))
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("excess") ** 2 / 4)
    return moments.filter("n >= 3 and sd > 1e-12").select(*keys, jb.alias("jb"), F.exp(-jb / 2).alias("normal_p"))


def normality(df: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "variable", "value")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    return names.join(moment_normality(long, ["variable"], "value"), "variable", "left").withColumn(
        "distribution",
        F.when(F.col("jb").isNull(), "not tested").when(F.col("normal_p") > alpha, "Normal").otherwise("Non-normal"),
    )


# ---------------------------------------------------------------- descriptive table
def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric description; quantiles are exact at any size."""
    clean = df.select(*[v.finite(F.col(c)).alias(c) for c in columns])
    q = exact_quantiles(clean, columns, [0.25, 0.5, 0.75])
    cells = [
        F.struct(
            F.lit(c).alias("variable"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"),
            F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.lit(q[c][1]).alias("median"),
            F.lit(None if q[c][0] is None else q[c][2] - q[c][0]).cast("double").alias("iqr"),
            F.min(c).alias("min"), F.max(c).alias("max"), F.skewness(c).alias("skewness"),
            F.kurtosis(c).alias("kurtosis"),
        )
        for c in columns
    ]
    return clean.agg(F.array(*cells).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Levels, mode and mode percentage."""
    rows = df.count()
    return mode_share(df, columns).select(
        F.col("column").alias("variable"), F.col("present").alias("n"),
        (F.lit(rows) - F.col("present")).alias("missing"), F.col("distinct").alias("levels"), "mode",
        (100 * F.col("mode_share")).alias("mode_pct"),
    )


# ---------------------------------------------------------------- group comparisons
def group_moments(df: DataFrame, group: str, value: str) -> dict[object, tuple[int, float, float]]:
    """n, mean and sample variance per group; groups under two values are left out."""
    x = v.finite(F.col(value))
    rows = (
        df.filter(F.col(group).isNotNull()).groupBy(group)
        .agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("s2"))
        .filter("n >= 2").orderBy(group).limit(MAX_CLASSES + 1).collect()
    )
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"'{group}' has too many groups to compare")
    return {r[group]: (r["n"], r["m"], r["s2"]) for r in rows}


def welch(a: tuple, b: tuple) -> tuple[float, float]:
    (na, ma, va), (nb, mb, vb) = a, b
    se = va / na + vb / nb
    t = (ma - mb) / math.sqrt(se)
    df = se**2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))
    return t, tails.t_two_sided(t, df)


def cohens_d(a: tuple, b: tuple) -> float:
    (na, ma, va), (nb, mb, vb) = a, b
    pooled = math.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    return (ma - mb) / pooled if pooled > 1e-12 else 0.0


def anova(groups: Sequence[tuple]) -> tuple[float, float, float]:
    """F, p and eta squared from group moments."""
    n = sum(g[0] for g in groups)
    grand = sum(g[0] * g[1] for g in groups) / n
    between = sum(g[0] * (g[1] - grand) ** 2 for g in groups)
    within = sum((g[0] - 1) * g[2] for g in groups)
    k = len(groups)
    f = (between / (k - 1)) / (within / (n - k)) if within > 0 else math.inf
    total = between + within
    return f, tails.f_upper(f, k - 1, n - k), between / total if total > 1e-12 else 0.0


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Average-rank sum and size per group, plus the tie term of the whole sample.

    Rows are reduced to counts per (value, group) before the rank table is joined, so a
    value shared by a third of the rows is a few joined rows, not a hot key.
    """
    x = v.finite(F.col(value))
    clean = df.filter(F.col(group).isNotNull() & x.isNotNull()).select(F.col(group).alias("grp"), x.alias("x"))
    cells = clean.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("n"))
    ranks = value_ranks(clean, "x").select("x", "rank", "ties")
    joined = cells.join(ranks, "x")
    ties = F.col("ties").cast("double")
    # Each distinct value's tie term is spread over its cells so that it is summed once.
    term = (ties * ties * ties - ties) * F.col("n") / ties
    return joined.groupBy("grp").agg(
        F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n")).alias("rank_sum"), F.sum(term).alias("tie_term")
    )


def _exact_mann_whitney(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p from the null distribution (no ties, small samples)."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1
    for i in range(1, n1 + 1):
        # Gaussian binomial: multiply by (1 - q^(n2 + i)) and divide by (1 - q^i).
        up = counts.copy()
        if n2 + i < counts.size:
            up[n2 + i :] -= counts[: counts.size - n2 - i]
        for k in range(i, counts.size):
            up[k] += up[k - i]
        counts = up
    tail = counts[int(max(u, n1 * n2 - u)) :].sum() / counts.sum()
    return min(1.0, 2 * tail)


def mann_whitney(sums: Sequence[Mapping]) -> tuple[float, float, str]:
    """U of the first group and p: exact below nine without ties, else tie-corrected."""
    a, b = sums
    n1, n2 = a["n"], b["n"]
    u1 = a["rank_sum"] - n1 * (n1 + 1) / 2
    ties = a["tie_term"] + b["tie_term"]
    if min(n1, n2) <= 8 and ties == 0:
        return u1, _exact_mann_whitney(u1, n1, n2), "exact"
    n = n1 + n2
    variance = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    top = max(u1, n1 * n2 - u1)
    z = (top - n1 * n2 / 2 - 0.5) / math.sqrt(variance) if variance > 0 else 0.0
    return u1, min(1.0, 2 * tails.normal_upper(z)), "asymptotic"


def kruskal(sums: Sequence[Mapping]) -> tuple[float, float]:
    n = sum(s["n"] for s in sums)
    h = 12 / (n * (n + 1)) * sum(s["rank_sum"] ** 2 / s["n"] for s in sums) - 3 * (n + 1)
    correction = 1 - sum(s["tie_term"] for s in sums) / (n**3 - n)
    h = h / correction if correction > 0 else 0.0
    return h, tails.chi2_upper(h, len(sums) - 1)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Non-empty cells with their margins and expected counts."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).alias("a"), F.col(b).alias("b")
    ).agg(F.count(F.lit(1)).alias("n"))
    row = F.sum("n").over(Window.partitionBy("a"))
    col = F.sum("n").over(Window.partitionBy("b"))
    total = cells.agg(F.sum("n")).first()[0] or 0
    return cells.withColumns({"row": row, "col": col}).withColumn(
        "expected", F.col("row") * F.col("col") / F.lit(float(total or 1))
    )


def chi_square(df: DataFrame, a: str, b: str) -> dict:
    """Chi-square (continuity-corrected on 2x2), p and Cramér's V (uncorrected).

    Empty cells only contribute their expected count, and those add up to what the
    non-empty cells lack, so sum(n^2 / E) - N needs no full grid.
    """
    for c in (a, b):
        if df.select(c).distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
            raise ValueError(f"'{c}' has too many levels for a contingency table")
    table = contingency(df, a, b)
    row = table.agg(
        F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n") / F.col("expected")).alias("s"),
        F.max(F.struct("n", "row", "col", "expected")).alias("cell"),
    ).first()
    r, c, n = row["r"], row["c"], row["n"]
    if min(r or 0, c or 0) < 2:
        return {"test": "not run (needs 2x2 or larger)"}
    plain, dof = row["s"] - n, (r - 1) * (c - 1)
    stat = plain
    if r == c == 2:
        # All four cells of a 2x2 table are equally far from their expected counts.
        one = row["cell"]
        gap = abs(one["n"] - one["expected"])
        gap -= min(0.5, gap)
        rows, cols = (one["row"], n - one["row"]), (one["col"], n - one["col"])
        stat = sum(gap * gap * n / (x * y) for x in rows for y in cols)
    return {
        "test": "Chi-square", "statistic": stat, "df": float(dof), "p": tails.chi2_upper(stat, dof),
        "effect": "Cramer's V", "effect_value": math.sqrt(max(0.0, plain) / (n * (min(r, c) - 1))),
    }


COMPARISON = (
    "variable string, groups long, test string, statistic double, df double, p double, p_text string, "
    "stars string, effect string, effect_value double"
)


def compare_groups(df: DataFrame, group: str, columns: Sequence[str], alpha: float = 0.05, test: str = "auto") -> DataFrame:
    """One row per variable: which test ran, its statistic, p and effect size.

    ``test`` is "parametric", "rank", or "auto": rank tests if some group fails the normality
    test at ``alpha``. The choice does not depend on the number of rows.
    """
    if test not in ("auto", "parametric", "rank"):
        raise ValueError(f"unknown test '{test}'")
    numeric = set(v.numeric_columns(df))
    groups = df.select(group).dropna().distinct().count()
    if groups < 2:
        raise ValueError(f"'{group}' has fewer than two groups")
    out = []
    for c in columns:
        entry: dict = {"variable": c, "groups": groups}
        if c in numeric:
            moments = group_moments(df, group, c)
            if len(moments) < 2:
                entry["test"] = "not run (insufficient data)"
                out.append(entry)
                continue
            tested = moment_normality(df.select(group, F.col(c).cast("double").alias("value")).dropna(), [group], "value")
            normal = test == "parametric" or test == "auto" and tested.filter(F.col("normal_p") <= alpha).isEmpty()
            sums = {} if normal else {r["grp"]: r for r in rank_sums(df, group, c).collect()}
            samples = list(moments.values())
            if len(samples) == 2:
                if normal:
                    stat, p = welch(*samples)
                    entry["test"] = "Welch t-test"
                else:
                    stat, p, form = mann_whitney([sums[g] for g in moments])
                    entry["test"] = f"Mann-Whitney U ({form})"
                entry |= {"effect": "Cohen's d", "effect_value": cohens_d(*samples)}
            else:
                f, p, eta = anova(samples)
                stat, entry["test"] = f, "One-way ANOVA"
                if not normal:
                    stat, p = kruskal([sums[g] for g in moments])
                    entry["test"] = "Kruskal-Wallis"
                entry |= {"effect": "eta squared", "effect_value": eta}
            entry |= {"statistic": stat, "p": p}
        else:
            entry |= chi_square(df, c, group)
        if "p" in entry:
            entry |= {"p_text": tails.format_p(entry["p"]), "stars": tails.stars(entry["p"])}
        out.append(entry)
    names = [f.split()[0] for f in COMPARISON.split(", ")]
    rows = [
        tuple(float(e[n]) if n in ("statistic", "df", "p", "effect_value") and e.get(n) is not None else e.get(n) for n in names)
        for e in out
    ]
    return df.sparkSession.createDataFrame(rows, COMPARISON)


# ---------------------------------------------------------------- correlations
def long_form(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """``column`` (its number) and ``value`` of every value that is not missing."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]))
    return df.select(*keep, each.alias("_e")).select(*keep, "_e.column", "_e.value").where("value is not null")


def rank_products(rows: DataFrame, value: str, keys: Sequence[str], other: str) -> DataFrame:
    """Per key: ``n``, and the sums ``ab``, ``aa``, ``bb`` of ranks of ``value`` with ranks that ``other`` holds.

    The cross product only needs, per distinct value, how many rows have it and the sum of
    the other side's ranks. Both kinds of ranks of n rows have the mean (n + 1) / 2.
    """
    table = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"), F.sum(other).alias("_s"), F.sum(F.col(other) * F.col(other)).alias("_q"))
    table = cut_lineage(table)
    upto = running(table, keys, [value], {"upto": Running("sum", F.col("ties"))})
    own = F.col("upto") - (F.col("ties") - 1) / F.lit(2.0)
    sums = upto.groupBy(*keys).agg(
        F.sum("ties").alias("n"), F.sum(own * F.col("_s")).alias("_ab"), F.sum(F.col("ties") * own * own).alias("_aa"), F.sum("_q").alias("_bb")
    )
    n = F.col("n").cast("double")  # the cube of a few million is beyond a long
    mid = n * (n + 1) * (n + 1) / 4
    # What is left of a constant side is rounding.
    return sums.select(*keys, "n", *[F.when(F.abs(F.col(f"_{c}") - mid) > 1e-12 * mid, F.col(f"_{c}") - mid).otherwise(0.0).alias(c) for c in ("ab", "aa", "bb")])


#: Values of more than this part of the rows have their ranks broadcast.
SHARE = 2_000


def with_ranks(rows: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    """Attach the average rank of ``value`` within the keys.

    A value shared by many rows would be a hot join key. Values of more than one in ``SHARE`` of
    the rows are no more than that many and are broadcast; the rest is joined by value.
    """
    ranks = cut_lineage(value_ranks(rows, value, keys).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_v"), F.col("rank").alias(out), "ties"))
    total = ranks.agg(F.sum("ties")).first()[0] or 0
    same = (F.col(value) == F.col("_v"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    often = F.col("ties") > F.lit(total / SHARE)
    held = F.broadcast(ranks.where(often).drop("ties"))
    hot = rows.join(held, same)
    cold = rows.join(held, same, "left_anti").join(ranks.where(~often).drop("ties"), same)
    return hot.unionByName(cold).drop("_v", *[f"_k_{k}" for k in keys])


def _r(ab: float | None, aa: float | None, bb: float | None) -> float | None:
    return ab / math.sqrt(aa * bb) if aa and bb else None


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, float | None]]:
    """Spearman's r of each pair on its own complete rows; all pairs go through the same jobs."""
    if not pairs:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), v.finite(F.col(a)).cast("double").alias("x"), v.finite(F.col(b)).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)]))
    rows = df.select(each.alias("_e")).select("_e.*").where("x is not null and y is not null")
    found = rank_products(with_ranks(rows, "y", ["pair"], "_ry"), "x", ["pair"], "_ry").collect()
    known = {r["pair"]: (r["n"], _r(r["ab"], r["aa"], r["bb"])) for r in found}
    return {pair: known.get(i, (0, None)) for i, pair in enumerate(pairs)}


def spearman(df: DataFrame, column: str, target: str) -> tuple[int, float | None]:
    """On complete pairs."""
    return spearman_pairs(df, [(column, target)])[column, target]


def whole_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those without a missing value."""
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if not gaps[f"g{i}"]]


def spearman_many(df: DataFrame, target: str, columns: Sequence[str]) -> dict[str, tuple[int, float | None]]:
    """Columns never missing beside the target share its one ranking; the others go as pairs of their own."""
    clean = df.select(v.finite(F.col(target)).alias(target), *[v.finite(F.col(c)).alias(c) for c in columns if c != target])
    clean = clean.filter(F.col(target).isNotNull())
    whole = whole_columns(clean, columns)
    out = {a: x for (a, _), x in spearman_pairs(clean, [(c, target) for c in columns if c not in whole]).items()}
    if whole:
        ranked = with_ranks(clean.select(target, *[c for c in whole if c != target]), target, [], "_ry")
        found = {r["column"]: r for r in rank_products(long_form(ranked, whole, "_ry"), "value", ["column"], "_ry").collect()}
        out |= {c: (found[i]["n"], _r(found[i]["ab"], found[i]["aa"], found[i]["bb"])) if i in found else (0, None) for i, c in enumerate(whole)}
    return out


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """All pairs: columns without gaps are ranked in one pass and multiplied as one matrix of ranks."""
    clean = df.select(*[v.finite(F.col(c)).alias(c) for c in columns])
    whole = whole_columns(clean, columns)
    out = {p: r for p, (_, r) in spearman_pairs(clean, [p for p in combinations(columns, 2) if not set(p) <= set(whole)]).items()}
    if len(whole) > 1:
        rows = cut_lineage(clean.select(*whole).withColumn("_id", F.monotonically_increasing_id()))
        ranked = with_ranks(long_form(rows, whole, "_id"), "value", ["column"], "_rank")
        wide = ranked.groupBy("_id").agg(F.lit(0).alias("fold"), *[F.max(F.when(F.col("column") == i, F.col("_rank"))).alias(f"r{i}") for i in range(len(whole))])
        moments = fold_moments(wide, [f"r{i}" for i in range(len(whole))])
        if moments:
            m = moments[0]
            mid = np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
            central = np.where(np.abs(m[1:, 1:] - mid) > 1e-12 * mid, m[1:, 1:] - mid, 0.0)
            out |= {(a, b): _r(float(central[i, j]), float(central[i, i]), float(central[j, j])) for (i, a), (j, b) in combinations(enumerate(whole), 2)}
    return out


CORRELATION = "variable string, n long, r double, ci_low double, ci_high double, p double, p_text string, stars string"


def correlate_with(
    df: DataFrame, target: str, columns: Sequence[str], method: str = "spearman", top: int | None = None
) -> DataFrame:
    """Correlation with the target, Fisher interval and p, strongest first."""
    rows = []
    ranked = spearman_many(df, target, columns) if method == "spearman" else {}
    for c in columns:
        if method == "spearman":
            n, r = ranked[c]
        else:
            x, y = v.finite(F.col(c)), v.finite(F.col(target))
            both = x.isNotNull() & y.isNotNull()
            n, r = df.agg(F.count_if(both), F.corr(F.when(both, x), F.when(both, y))).first()
        if n < 10 or r is None or math.isnan(r):
            continue
        low = high = None
        if abs(r) < 1 and n > 3:
            z, se = math.atanh(r), 1 / math.sqrt(n - 3)
            low, high = math.tanh(z - 1.96 * se), math.tanh(z + 1.96 * se)
        p = tails.t_two_sided(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2)
        rows.append((c, n, float(r), low, high, p, tails.format_p(p), tails.stars(p)))
    rows.sort(key=lambda row: (-abs(row[2]), row[0]))
    return df.sparkSession.createDataFrame(rows[:top], CORRELATION)


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "spearman") -> DataFrame:
    """Pairwise complete correlations as (a, b, r) with a <= b."""
    rows = []
    if method == "pearson":
        exprs = []
        for i, a in enumerate(columns):
            for b in columns[i + 1 :]:
                x, y = v.finite(F.col(a)), v.finite(F.col(b))
                both = x.isNotNull() & y.isNotNull()
                exprs.append(F.corr(F.when(both, x), F.when(both, y)))
        found = df.agg(*exprs).first() if exprs else ()
        rows = [(*pair, r) for pair, r in zip(combinations(columns, 2), found, strict=True)]
    else:
        rows = [(*pair, r) for pair, r in spearman_matrix(df, columns).items()]
    rows += [(c, c, 1.0) for c in columns]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


# ---------------------------------------------------------------- paired tests, corrections
PAIRED = "test string, statistic double, p double, n_pairs long, median_difference double, mean_difference double, dz double, note string"


def _exact_signed_rank(low: float, n: int) -> float:
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k]
    return min(1.0, 2 * counts[: int(low) + 1].sum() / counts.sum())


def paired_tests(df: DataFrame, a: str, b: str) -> DataFrame:
    """Wilcoxon signed-rank (exact to 50 pairs without ties or zeros) and paired t."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d"), (F.abs(F.col(a) - F.col(b)) <= 1e-8 + 1e-5 * F.abs(F.col(b))).alias("close")).filter("d is not null")
    row = d.agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"),
        F.bool_and("close").alias("same"), F.count_if(F.col("d") == 0).alias("zeros"),
    ).first()
    n, mean, sd = row["n"], row["mean"], row["sd"]
    out = []
    if n < 5:
        out.append(("wilcoxon", None, None, n, None, mean, None, f"only {n} pairs"))
    elif row["same"]:
        out.append(("wilcoxon", None, 1.0, n, None, mean, None, "inputs are identical"))
    else:
        nonzero = d.filter("d <> 0").withColumn("m", F.abs("d"))
        cells = nonzero.groupBy("m").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
        ranked = cells.join(value_ranks(nonzero, "m"), "m")
        t = F.col("ties").cast("double")
        s = ranked.agg(
            F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * F.col("down")).alias("minus"),
            F.sum(t * t * t - t).alias("tie_term"), F.sum("ties").alias("m"),
        ).first()
        stat, m = min(s["plus"], s["minus"]), s["m"]
        if m <= 50 and s["tie_term"] == 0 and row["zeros"] == 0:
            p, form = _exact_signed_rank(stat, m), "exact"
        else:
            var = m * (m + 1) * (2 * m + 1) / 24 - s["tie_term"] / 48
            p, form = tails.normal_two_sided((stat - m * (m + 1) / 4) / math.sqrt(var)), "asymptotic"
        median = exact_quantiles(d, ["d"], [0.5])["d"][0]
        out.append(("wilcoxon_signed_rank", stat, p, n, median, mean, None, form))
    if n < 3:
        out.append(("paired_t", None, None, n, None, mean, None, "too few pairs"))
    else:
        t = mean / (sd / math.sqrt(n)) if sd > 0 else math.inf
        out.append(("paired_t", t, tails.t_two_sided(t, n - 1), n, None, mean, mean / sd if sd > 1e-12 else None, ""))
    return df.sparkSession.createDataFrame(out, PAIRED)


def holm(df: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values, capped at one and never decreasing.

    The input has one row per comparison, so one ordered window over it is small.
    """
    valid = df.filter(F.col(p).isNotNull())
    order = Window.partitionBy(F.lit(0)).orderBy(p, name)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    scaled = (m - F.row_number().over(order) + 1) * F.col(p)
    upto = F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return valid.withColumn("_s", scaled).select(
        name, F.col(p).alias("p_raw"), F.least(F.lit(1.0), upto).alias("p_adjusted")
    ).withColumn("significant", F.col("p_adjusted") < alpha)


def p_text(p: Column) -> Column:
    shown = F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))
    return F.when(p.isNull() | F.isnan(p), "-").otherwise(shown)


def p_stars(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def cv_summary(folds: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean, sd and t-based 95 % interval per metric with at least two folds."""
    base = folds.groupBy(metric).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ).filter("n >= 2")

    @F.pandas_udf("double")
    def t_of(n: pd.Series) -> pd.Series:
        return n.map({k: tails.t_quantile(0.975, k - 1) for k in n.unique()})

    t = t_of("n")
    half = t * F.col("sd") / F.sqrt("n")
    return base.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})
