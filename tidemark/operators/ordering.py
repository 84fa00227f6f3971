"""Ordered computations that never put a whole key or table into one task.

Rows are cut into *chunks* along the ordering column at bounds taken from
approximate quantiles (literal numbers once computed, so recomputation after an
executor loss gives the same chunks). A value too frequent for one chunk is cut further
along the next ordering column. A window function then runs per
``(keys, chunk)`` and what earlier chunks contribute is joined in from a table with
one row per ``(keys, chunk)``. A key holding a third of all rows is thereby spread
over a third of the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_CHUNK = 1_000_000
CHUNK = "_chunk"
KEY = "_series"


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on equally named columns, keeping the left side's.

    Plain equality, so a partitioning of the left side on the keys is used again. Series
    keys are never NULL here; see ``keyed_rows``.
    """
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & (left[key] == renamed[f"_r_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def keyed_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that belong to a series; one without an id is no part of any."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())  # reaches the scan, unlike dropna
    return df


@dataclass(frozen=True)
class Cuts:
    """Chunk bounds along a column; ``ties`` cuts a very frequent value by the next one."""

    edges: tuple[float, ...] = ()
    ties: tuple[tuple[float, tuple[float, ...]], ...] = ()
    tie: str | None = None

    def __bool__(self) -> bool:
        return bool(self.edges)

    def __len__(self) -> int:
        return len(self.edges)


MAX_CHUNKS = 20_000  # keeps the bounds and the quantile state small; chunks grow instead


def chunk_edges(
    df: DataFrame, column: str, rows_per_chunk: int | None = None, tie: str | None = None
) -> Cuts:
    """Inner chunk bounds along a numeric column; empty when one chunk is enough.

    A value that fills several chunks by itself (a default timestamp, say) gets its own
    chunks along ``tie``, the next ordering column.
    """
    size = rows_per_chunk or ROWS_PER_CHUNK
    total = df.select(F.count(column)).first()[0]
    pieces = min(MAX_CHUNKS, math.ceil(total / size))
    if pieces <= 1:
        return Cuts()
    x = F.col(column).cast("double")
    cuts = [i / pieces for i in range(1, pieces)]
    found = df.select(F.percentile_approx(x, cuts, max(10_000, 4 * pieces))).first()[0]
    edges = {value for value in found if math.isfinite(value)}
    heavy = sorted({a for a, b in zip(found, found[1:]) if a == b} | {a for a in found if math.isinf(a)})
    if not heavy:
        return Cuts(tuple(sorted(edges)))
    # An infinite value is set apart by the last finite number before it.
    edges |= {math.nextafter(value, math.inf if value < math.inf else -math.inf) for value in heavy}
    if tie is None or not isinstance(df.schema[tie].dataType, T.NumericType):
        return Cuts(tuple(sorted(edges)))
    share = [i / 100 for i in range(1, 100)]
    y = F.percentile_approx(F.col(tie).cast("double"), share, 10_000)
    rows = df.filter(x.isin(heavy)).groupBy(x.alias("x")).agg(y.alias("q")).collect()
    ties = tuple((r["x"], tuple(sorted(set(r["q"])))) for r in rows)
    return Cuts(tuple(sorted(edges)), ties, tie)


def _cut(df: DataFrame, column: str, edges: Sequence[float], out: str) -> DataFrame:
    splits = [float("-inf"), *edges, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="_chunk_on", outputCol=out, handleInvalid="keep")
    numbered = cutter.transform(df.withColumn("_chunk_on", F.col(column).cast("double")))
    return numbered.drop("_chunk_on").withColumn(out, F.col(out).cast("long"))


def with_chunk(df: DataFrame, column: str, cuts: Cuts) -> DataFrame:
    """Number the chunk of every row; numbers ascend with the ordering."""
    if not cuts:
        return df.withColumn(CHUNK, F.lit(0))
    out = _cut(df, column, cuts.edges, CHUNK)
    if not cuts.ties:
        return out
    x, y = F.col(column).cast("double"), F.col(cuts.tie).cast("double")
    part = F.lit(0)
    for value, edges in cuts.ties:
        bounds = F.array(*[F.lit(e) for e in edges])
        part = F.when(x == value, F.size(F.filter(bounds, lambda e: e <= y))).otherwise(part)
    return out.withColumn(CHUNK, F.col(CHUNK) * 1000 + part)


class Running:
    """One running aggregate: ``kind`` is sum, max or min."""

    def __init__(self, kind: str, value: Column, reverse: bool = False, inclusive: bool = True):
        self.kind, self.value = kind, value
        self.reverse, self.inclusive = reverse, inclusive

    def aggregate(self, column: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](column)

    def merge(self, carry: Column, local: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        return (F.greatest if self.kind == "max" else F.least)(carry, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, Running],
    edges: Cuts | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Append running aggregates per key in ascending ``order``.

    ``order[0]`` must be numeric; it is the column the chunks are cut along.
    """
    keys, order = list(keys), list(order)
    if edges is None:
        edges = chunk_edges(df, order[0], rows_per_chunk, next(iter(order[1:]), None))

    def over(by: Sequence[str], columns: Sequence[str], spec: Running, inclusive: bool):
        ordering = [F.col(c).desc() if spec.reverse else F.col(c).asc() for c in columns]
        upper = 0 if inclusive else -1
        return Window.partitionBy(*by).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, upper)

    def local(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.withColumns(
            {n: s.aggregate(s.value).over(over(by, order, s, s.inclusive)) for n, s in specs.items()}
        )

    if not edges:
        out = local(df, keys or [F.lit(0)])
        zero = {n: F.coalesce(F.col(n), F.lit(0)) for n, s in specs.items() if s.kind == "sum"}
        return out.withColumns(zero) if zero else out

    # One struct key: NULL fields compare equal in it, and window, totals and join agree on
    # the partitioning, so rows are exchanged once.
    cut = with_chunk(df, order[0], edges).withColumn(KEY, F.struct(F.lit(0).alias("_"), *keys))
    totals = cut.groupBy(KEY, CHUNK).agg(
        *[spec.aggregate(spec.value).alias(f"_t_{name}") for name, spec in specs.items()]
    )
    carried = totals.select(
        F.col(KEY).alias("_r_key"),
        F.col(CHUNK).alias("_r_chunk"),
        *[
            spec.aggregate(F.col(f"_t_{name}")).over(over([KEY], [CHUNK], spec, False)).alias(f"_c_{name}")
            for name, spec in specs.items()
        ],
    )
    rows = local(cut, [KEY, CHUNK])
    same = (rows[KEY] == carried["_r_key"]) & (rows[CHUNK] == carried["_r_chunk"])
    joined = rows.join(carried, same, "left")
    merged = {name: spec.merge(F.col(f"_c_{name}"), F.col(name)) for name, spec in specs.items()}
    return joined.withColumns(merged).drop(
        KEY, CHUNK, "_r_key", "_r_chunk", *[f"_c_{name}" for name in specs]
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    prefix: str = "prev_",
    edges: Cuts | None = None,
    rows_per_chunk: int | None = None,
    following: bool = False,
) -> DataFrame:
    """Values of the neighbouring row of the same key (lag, or lead if ``following``)."""
    order, columns = list(order), list(columns)
    if edges is None:
        edges = chunk_edges(df, order[0], rows_per_chunk, next(iter(order[1:]), None))
    if not edges:
        over = Window.partitionBy(*keys).orderBy(*order)
        move = F.lead if following else F.lag
        return df.withColumns({prefix + c: move(c).over(over) for c in columns})
    row = F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in columns])
    spec = Running("min" if following else "max", row, reverse=following, inclusive=False)
    out = running(df, keys, order, {"_neighbour": spec}, edges)
    return out.withColumns({prefix + c: F.col(f"_neighbour._v_{c}") for c in columns}).drop(
        "_neighbour"
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    edges: Cuts | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """1-based position within the key."""
    spec = Running("sum", F.lit(1).cast("long"))
    return running(df, keys, order, {name: spec}, edges, rows_per_chunk)


def value_ranks(
    df: DataFrame, value: str, keys: Sequence[str] = (), rows_per_chunk: int | None = None,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per (keys, distinct value): its count, rows at or below, average rank.

    ``extra`` adds aggregates of the rows sharing a value. Chunks are cut on the rows, so
    a chunk never has more distinct values than a chunk of rows.
    """
    edges = chunk_edges(df, value, rows_per_chunk)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("ties"), *[c.alias(n) for n, c in (extra or {}).items()])
    )
    ranked = running(counts, keys, [value], {"upto": Running("sum", F.col("ties"))}, edges)
    return ranked.withColumn("rank", F.col("upto") - (F.col("ties") - 1) / F.lit(2.0))


# ---------------------------------------------------------------- order statistics
EXACT_AGGREGATE_ROWS = 2_000_000


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    limit: int | None = None,
    accuracy: int = 10_000,
) -> dict[tuple[str, int], float]:
    """Exact k-th smallest values (0-based) of several numeric columns.

    Each wanted rank is bracketed by approximate quantiles, the bracket is narrowed by
    whole-table passes of fixed-size aggregation state, and only the counts of the
    distinct values left inside a bracket are ordered.
    """
    limit = limit or EXACT_AGGREGATE_ROWS
    names = list(ranks)
    totals = df.select(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)])
    total = dict(zip(names, totals.first()))
    states = [
        {"col": c, "k": k, "lo": None, "hi": None, "below": 0, "inside": total[c], "done": False}
        for c in names
        for k in sorted(set(ranks[c]))
        if 0 <= k < total[c]
    ]

    def within(s):
        x = F.col(f"`{s['col']}`")
        inside = x.isNotNull()
        if s["lo"] is not None:
            inside = inside & (x >= F.lit(s["lo"])) & (x <= F.lit(s["hi"]))
        return inside, x

    while True:
        wide = [s for s in states if not s["done"] and s["inside"] > limit]
        if not wide:
            break
        probes = []
        for i, s in enumerate(wide):
            inside, x = within(s)
            share = (s["k"] - s["below"]) / s["inside"]
            bounds = [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)]
            probes.append(F.percentile_approx(F.when(inside, x), bounds, accuracy).alias(f"b{i}"))
        bounds = df.select(*probes).first()
        counts = []
        for i, s in enumerate(wide):
            x = F.col(f"`{s['col']}`")
            lo, hi = F.lit(bounds[i][0]), F.lit(bounds[i][1])
            counts.append(F.count_if(x < lo).alias(f"u{i}"))
            counts.append(F.count_if((x >= lo) & (x <= hi)).alias(f"i{i}"))
        found = df.select(*counts).first()
        for i, s in enumerate(wide):
            below, inside = found[2 * i], found[2 * i + 1]
            if not below <= s["k"] < below + inside or inside > s["inside"] / 2:
                s["done"] = True  # heavy ties: the counting step below takes over
                if not below <= s["k"] < below + inside:
                    continue
            s.update(lo=bounds[i][0], hi=bounds[i][1], below=below, inside=inside)

    if not states:
        return {}
    parts = [
        F.when(within(s)[0], F.struct(F.lit(i).alias("state"), within(s)[1].cast("double").alias("x")))
        for i, s in enumerate(states)
    ]
    kept = df.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
    counted = kept.groupBy("p.state", "p.x").agg(F.count(F.lit(1)).alias("n"))
    small = max(s["inside"] for s in states) <= limit
    placed = running(
        counted, ["state"], ["x"], {"upto": Running("sum", F.col("n"))}, Cuts() if small else None
    )
    local = F.element_at(
        F.array(*[F.lit(s["k"] - s["below"]).cast("long") for s in states]), F.col("state") + 1
    )
    hit = placed.filter((F.col("upto") > local) & (F.col("upto") - F.col("n") <= local))
    return {
        (states[r["state"]]["col"], states[r["state"]]["k"]): r["x"]
        for r in hit.select("state", "x").collect()
    }


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], limit: int | None = None
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column (NULLs ignored)."""
    columns, limit = list(columns), limit or EXACT_AGGREGATE_ROWS
    if not columns:
        return {}
    counts = df.select(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])
    n = dict(zip(columns, counts.first()))
    if max(n.values()) <= limit:
        picked = df.select(
            *[
                F.percentile(F.col(f"`{c}`"), F.array(*[F.lit(p) for p in probs])).alias(f"q{i}")
                for i, c in enumerate(columns)
            ]
        ).first()
        return {c: list(v) if v is not None else [None] * len(probs) for c, v in zip(columns, picked)}
    wanted = {
        c: sorted({f((n[c] - 1) * p) for p in probs for f in (math.floor, math.ceil)})
        for c in columns
        if n[c]
    }
    stats = order_statistics(df, wanted, limit)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        row: list[float | None] = []
        for p in probs:
            if not n[c]:
                row.append(None)
                continue
            h = (n[c] - 1) * p
            low, high = stats[c, math.floor(h)], stats[c, math.ceil(h)]
            row.append(low + (high - low) * (h - math.floor(h)))
        out[c] = row
    return out


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Exact quantiles per group; a huge group is ordered in chunks like any other."""
    spread = value_ranks(df, value, keys, rows_per_chunk)
    sizes = spread.groupBy(*keys).agg(F.sum("ties").alias("_n"))
    placed = join_on(spread, sizes, keys, "inner")
    aggregates = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        for tag, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("upto") > k) & (F.col("upto") - F.col("ties") <= k)
            aggregates.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{tag}"))
        aggregates.append(F.max(h - F.floor(h)).alias(f"_{name}_w"))
    picked = placed.groupBy(*keys).agg(*aggregates)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")
            ).alias(name)
            for name in probs
        ],
    )


# ---------------------------------------------------------------- hash-order cutoffs
PREFIX_DIGITS = 3
TOP_HASH = "g"  # above every hexadecimal text


def hash_cutoffs(
    df: DataFrame,
    hash_column: str,
    wanted: Mapping[object, Sequence[int]],
    by: str | None = None,
    limit: int = 200_000,
) -> dict[object, list[str]]:
    """For each class and count k: the hash below which exactly its first k rows lie.

    Radix selection on hexadecimal text: count by prefix, keep the one prefix each count
    falls into, repeat with a longer prefix, and order only what is left. No row is moved;
    the caller turns the cutoffs into a comparison.
    """
    spark = df.sparkSession
    base = df.select(
        (F.col(by).cast("string") if by else F.lit("all")).alias("cls"),
        F.col(hash_column).alias("h"),
    )
    result: dict[tuple[str, int], str] = {}
    open_targets = []
    for cls, ks in wanted.items():
        for k in sorted(set(ks)):
            if k <= 0:
                result[str(cls), k] = ""
            else:
                open_targets.append((str(cls), int(k), "", 0))  # class, k, prefix, rows before

    def target_frame(rows):
        return F.broadcast(
            spark.createDataFrame(rows, "cls string, k long, prefix string, before long")
        )

    digits = 0
    while open_targets:
        digits += PREFIX_DIGITS
        parent = F.substring("h", 1, digits - PREFIX_DIGITS)
        counts = (
            base.select("cls", parent.alias("prefix"), F.substring("h", 1, digits).alias("bucket"))
            .groupBy("cls", "prefix", "bucket")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        over = (
            Window.partitionBy("cls", "k")
            .orderBy("bucket")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        crossed = (
            counts.join(target_frame(open_targets), ["cls", "prefix"])
            .withColumn("upto", F.sum("n").over(over) + F.col("before"))
            .filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
            .select("cls", "k", "bucket", (F.col("upto") - F.col("n")).alias("before"), "n")
            .collect()
        )
        seen = {(r["cls"], r["k"]) for r in crossed}
        for cls, k, *_ in open_targets:
            if (cls, k) not in seen:
                result[cls, k] = TOP_HASH  # k is the class size or more
        open_targets = [(r["cls"], r["k"], r["bucket"], r["before"]) for r in crossed]
        if not crossed:
            break
        if sum(r["n"] for r in crossed) > limit and digits < 12:
            continue
        picked = (
            base.withColumn("prefix", F.substring("h", 1, digits))
            .join(target_frame(open_targets), ["cls", "prefix"])
            .withColumn("rn", F.row_number().over(Window.partitionBy("cls", "k").orderBy("h")))
            .filter(F.col("rn") == F.col("k") - F.col("before") + 1)
            .collect()
        )
        result.update({(r["cls"], r["k"]): r["h"] for r in picked})
        break
    return {cls: [result[str(cls), k] for k in ks] for cls, ks in wanted.items()}
