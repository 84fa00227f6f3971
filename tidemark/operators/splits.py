"""Train/test splits and inner folds as columns on the row.

Shuffles are orders of ``md5(seed | id)``, so a split depends on the seed and the ids
only. Every cut is a comparison with an exact cutoff found by selection; rows are not
moved to be split.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as v
from tidemark.operators.clean import class_labels
from tidemark.operators.ordering import hash_cutoffs, order_statistics
from tidemark.session import cut_lineage

KINDS = ("time_series", "group", "stratified", "random")


def resolve(requested: str | None, classification: bool, groups: bool) -> tuple[str, list[str]]:
    """Workable split kind plus a note for every downgrade."""
    kind, notes = (requested or "random").lower(), []
    if kind not in KINDS:
        notes.append(f"unknown split '{requested}', using random")
        kind = "random"
    if kind == "group" and not groups:
        notes.append("group split without groups, using random")
        kind = "random"
    if kind == "stratified" and not classification:
        notes.append("stratified split needs classes, using random")
        kind = "random"
    return kind, notes


def fold_count(folds: int, rows: int) -> int:
    return max(2, min(int(folds), rows // 2))


def row_key(df: DataFrame, row_id: str, seed: int) -> Column:
    """Place of a row in the shuffle: the hash of its id, then of its content.

    Rows that share an id are thereby told apart, so a cut leaves exactly as many on a side as
    asked; only rows equal in every column stay together.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.concat(v.hash_text(seed, F.col(row_id)), F.lpad(F.lower(F.hex(F.xxhash64(*plain))), 16, "0"))


def _check(rows: int) -> None:
    if rows < 5:
        raise ValueError(f"need at least 5 rows to split, got {rows}")


def random_split(df: DataFrame, row_id: str, size: float = 0.2, seed: int = 42) -> DataFrame:
    rows = df.count()
    _check(rows)
    keyed = df.withColumn("_h", row_key(df, row_id, seed))
    cut = hash_cutoffs(keyed, "_h", {"all": [math.ceil(size * rows)]})["all"][0]
    side = F.when(F.col("_h") < cut, "test").otherwise("train")
    return keyed.withColumn("split", side).drop("_h")


def group_split(df: DataFrame, group: str, size: float = 0.2, seed: int = 42) -> DataFrame:
    groups = cut_lineage(df.select(group).distinct())
    keyed = groups.withColumn("_h", v.hash_text(seed, F.col(group)))
    n = groups.count()
    if n < 2:
        raise ValueError("group split needs at least two groups")
    cut = hash_cutoffs(keyed, "_h", {"all": [math.ceil(size * n)]})["all"][0]
    hashed = v.hash_text(seed, F.col(group))
    return df.withColumn("split", F.when(hashed < cut, "test").otherwise("train"))


def class_quotas(counts: Mapping[object, int], size: float) -> dict[object, int]:
    """Largest remainder, so the class quotas add up to the overall test size."""
    total = sum(counts.values())
    wanted = math.ceil(size * total)
    exact = {c: n * wanted / total for c, n in counts.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    short = wanted - sum(quota.values())
    for c in sorted(counts, key=lambda c: (-(exact[c] - quota[c]), str(c)))[:short]:
        quota[c] += 1
    return quota


def _class_sizes(df: DataFrame, target: str) -> dict[object, int]:
    class_labels(df, target)
    return {r[0]: r[1] for r in df.groupBy(target).count().collect()}


def _by_class(target: str, cases: Mapping[object, Column], default: Column) -> Column:
    out = None
    for label, value in cases.items():
        hit = F.col(target).eqNullSafe(F.lit(label))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def stratified_split(
    df: DataFrame, row_id: str, target: str, size: float = 0.2, seed: int = 42
) -> DataFrame:
    sizes = _class_sizes(df, target)
    _check(sum(sizes.values()))
    quota = class_quotas(sizes, size)
    keyed = df.withColumn("_h", row_key(df, row_id, seed))
    cuts = hash_cutoffs(keyed, "_h", {str(c): [k] for c, k in quota.items()}, by=target)
    bound = _by_class(target, {c: F.lit(cuts[str(c)][0]) for c in sizes}, F.lit(""))
    side = F.when(F.col("_h") < bound, "test").otherwise("train")
    return keyed.withColumn("split", side).drop("_h")


def _time_cutoffs(df: DataFrame, ts: str, row_id: str, ranks: Sequence[int]) -> list[tuple]:
    """(time, id) of the row at each 0-based rank in (time, id) order."""
    us = df.select(v.epoch_micros(F.col(ts)).alias("t"), F.col(row_id).cast("long").alias("id"))
    found = order_statistics(us, {"t": list(ranks)})
    at = [int(found["t", k]) for k in ranks]
    below = us.select(*[F.count_if(F.col("t") < t).alias(f"b{i}") for i, t in enumerate(at)]).first()
    # Rows sharing a cut's time are ranked by id, all cuts in one selection.
    tied = us.select(*[F.when(F.col("t") == t, F.col("id")).alias(f"id{i}") for i, t in enumerate(at)])
    wanted = {f"id{i}": [k - below[i]] for i, k in enumerate(ranks)}
    ids = order_statistics(tied, wanted)
    return [(t, int(ids[f"id{i}", ranks[i] - below[i]])) for i, t in enumerate(at)]


def _at_or_after(ts: str, row_id: str, cutoff: tuple) -> Column:
    t, tie = v.epoch_micros(F.col(ts)), F.col(row_id).cast("long")
    return (t > cutoff[0]) | ((t == cutoff[0]) & (tie >= cutoff[1]))


def time_split(
    df: DataFrame, ts: str, row_id: str, size: float = 0.2, gap: int = 0
) -> DataFrame:
    """Last rows are the test side, ``gap`` rows before them belong to neither."""
    rows = df.count()
    _check(rows)
    test = max(1, int(round(rows * size)))
    train = rows - test - gap
    if train < 2:
        raise ValueError(f"time split leaves {train} training rows")
    cuts = _time_cutoffs(df, ts, row_id, sorted({train, train + gap}))
    side = F.when(_at_or_after(ts, row_id, cuts[-1]), "test")
    if gap:
        side = side.when(_at_or_after(ts, row_id, cuts[0]), "gap")
    return df.withColumn("split", side.otherwise("train"))


# ---------------------------------------------------------------- inner folds
def _fold_sizes(rows: int, folds: int) -> list[int]:
    return [rows // folds + (1 if i < rows % folds else 0) for i in range(folds)]


def random_folds(df: DataFrame, row_id: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Consecutive blocks of the hash order, sizes differing by at most one."""
    rows = df.count()
    folds = fold_count(folds, rows)
    ends, upto = [], 0
    for size in _fold_sizes(rows, folds)[:-1]:
        upto += size
        ends.append(upto)
    keyed = df.withColumn("_h", row_key(df, row_id, seed))
    cuts = hash_cutoffs(keyed, "_h", {"all": ends})["all"]
    fold = sum([(F.col("_h") >= c).cast("int") for c in cuts], F.lit(0))
    return keyed.withColumn("fold", fold).drop("_h")


def stratified_folds(
    df: DataFrame, row_id: str, target: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Class counts per fold as dealing the class-sorted rows round robin would give."""
    sizes = _class_sizes(df, target)
    folds = max(2, min(fold_count(folds, sum(sizes.values())), min(sizes.values())))
    start, ends = 0, {}
    for label in sorted(sizes, key=lambda c: (str(type(c)), c)):
        stop = start + sizes[label]
        share = [len(range(start + (i - start) % folds, stop, folds)) for i in range(folds)]
        ends[label] = [sum(share[: i + 1]) for i in range(folds - 1)]
        start = stop
    keyed = df.withColumn("_h", row_key(df, row_id, seed))
    cuts = hash_cutoffs(keyed, "_h", {str(c): e for c, e in ends.items()}, by=target)
    cases = {
        c: sum([(F.col("_h") >= cut).cast("int") for cut in cuts[str(c)]], F.lit(0))
        for c in sizes
    }
    return keyed.withColumn("fold", _by_class(target, cases, F.lit(0))).drop("_h")


def _deal(size: int, count: int, loads: list[int]) -> list[int]:
    """How many of ``count`` equal groups each fold gets, lightest fold first."""
    given = [0] * len(loads)
    while count > 0:
        order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
        low = loads[order[0]]
        level = [i for i in order if loads[i] == low]
        above = loads[order[len(level)]] if len(level) < len(order) else None
        rounds = 1 if above is None else max(1, (above - low) // size)
        if above is None:
            rounds = max(1, count // len(level))
        for i in level:
            take = min(count, rounds)
            given[i] += take
            loads[i] += take * size
            count -= take
            if count == 0:
                break
    return given


def group_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Whole groups, largest first, into the lightest fold.

    The driver sees the histogram of group sizes, never the groups: groups of one size
    are interchangeable, so each fold gets a quota per size and the hash order within a
    size decides which groups fill it.
    """
    sizes = cut_lineage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")))
    histogram = {
        r["_size"]: r["n"]
        for r in sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    folds = max(2, min(folds, sum(histogram.values())))
    loads, ends = [0] * folds, {}
    for size in sorted(histogram, reverse=True):
        given = _deal(size, histogram[size], loads)
        ends[size] = [sum(given[: i + 1]) for i in range(folds - 1)]
    keyed = sizes.withColumn("_h", v.hash_text(seed, F.col(group)))
    cuts = hash_cutoffs(keyed, "_h", {str(s): e for s, e in ends.items()}, by="_size")
    table = df.sparkSession.createDataFrame(
        [(s, cuts[str(s)]) for s in ends], "_size long, _cuts array<string>"
    )
    placed = keyed.join(F.broadcast(table), "_size").select(
        F.col(group).alias("_g"),
        F.size(F.filter("_cuts", lambda c: c <= F.col("_h"))).alias("fold"),
    )
    return df.join(placed, F.col(group) == F.col("_g"), "left").drop("_g")


def time_folds(
    df: DataFrame, ts: str, row_id: str, folds: int = 5, gap: int = 0
) -> DataFrame:
    """Expanding-window folds: one row per (row, fold) with its side.

    Test block i has n // (folds + 1) rows; training is everything earlier, less ``gap``.
    """
    rows = df.count()
    folds = fold_count(folds, rows)
    size = rows // (folds + 1)
    starts = [rows - (folds - i) * size for i in range(folds)]
    if starts[0] - gap <= 0:
        raise ValueError("gap leaves no training rows in the first fold")
    ranks = sorted({s for s in starts} | {s - gap for s in starts})
    cut = dict(zip(ranks, _time_cutoffs(df, ts, row_id, ranks)))
    pieces = []
    for i, s in enumerate(starts):
        after_train = _at_or_after(ts, row_id, cut[s - gap])
        in_test = _at_or_after(ts, row_id, cut[s])
        if i + 1 < folds:
            in_test = in_test & ~_at_or_after(ts, row_id, cut[starts[i + 1]])
        side = F.when(~after_train, "train").when(in_test, "test")
        pieces.append(F.when(side.isNotNull(), F.struct(F.lit(i).alias("fold"), side.alias("side"))))
    tagged = F.filter(F.array(*pieces), lambda p: p.isNotNull())
    return df.withColumn("_f", F.explode(tagged)).select(*df.columns, "_f.fold", "_f.side")


def nested_split(
    df: DataFrame, row_id: str, size: float = 0.2, inner: float = 0.2, seed: int = 42
) -> DataFrame:
    """Random test split, then a validation split of the training rows."""
    outer = random_split(df, row_id, size, seed)
    rows = outer.filter("split = 'train'").count()
    keyed = outer.withColumn("_h", row_key(df, row_id, seed + 1))
    wanted = {"train": [math.ceil(inner * rows)]}
    cut = hash_cutoffs(keyed, "_h", wanted, by="split")["train"][0]
    held = (F.col("split") == "train") & (F.col("_h") < cut)
    return keyed.withColumn("split", F.when(held, "validation").otherwise(F.col("split"))).drop("_h")


def group_overlap(df: DataFrame, group: str) -> DataFrame:
    """Groups that occur on both sides of the split."""
    sides = df.filter(F.col("split").isin("train", "test")).groupBy(group).agg(
        F.min("split").alias("a"), F.max("split").alias("b")
    )
    return sides.filter(F.col("a") != F.col("b")).select(group)


def split_summary(df: DataFrame, group: str | None = None) -> DataFrame:
    groups = F.count_distinct(group) if group else F.lit(None).cast("long")
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), groups.alias("groups"))
