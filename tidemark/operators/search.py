"""Feature-subset search: Spark scores a whole generation of masks, the driver keeps the
few masks that an iterative optimiser carries between jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from threading import Condition

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import neighbours

MAX_FEATURES = 2_000
Scorer = Callable[[list[np.ndarray]], list[float]]


# ---------------------------------------------------------------- moments
def fold_moments(
    df: DataFrame, columns: Sequence[str], fold: str = "fold"
) -> dict[int, np.ndarray]:
    """Second-moment matrix of [1, columns] per fold, in one pass.

    Each task multiplies its own rows and sends one matrix per fold, so nothing but
    folds * columns^2 numbers reaches the driver.
    """
    columns = list(columns)
    if len(columns) > MAX_FEATURES:
        raise ValueError(f"moment matrices are limited to {MAX_FEATURES} columns")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            a = np.column_stack([np.ones(len(batch)), batch[columns].to_numpy(dtype=float)])
            folds = batch["_fold"].to_numpy()
            for f in np.unique(folds):
                part = a[folds == f]
                sums[int(f)] = sums.get(int(f), 0.0) + part.T @ part
        for f, m in sums.items():
            yield pd.DataFrame({"fold": f, "row": range(len(m)), "entries": list(m)})

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for f, i, x in zip(batch["fold"], batch["row"], batch["entries"]):
                sums[f, i] = sums.get((f, i), 0.0) + np.asarray(x)
        if sums:
            yield pd.DataFrame({"fold": [k[0] for k in sums], "row": [k[1] for k in sums], "entries": list(sums.values())})

    narrow = df.select(F.col(fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(c) for c in columns])
    kind = "fold int, row int, entries array<double>"
    # Rows of the matrix are summed as arrays, streaming, on the task that owns them.
    summed = narrow.mapInPandas(partial, kind).repartition("fold", "row").mapInPandas(combine, kind)
    size = len(columns) + 1
    out: dict[int, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["fold"], np.zeros((size, size)))[r["row"]] = r["entries"]
    return dict(sorted(out.items()))


def solve_linear(m: np.ndarray, inputs: Sequence[int], outputs: Sequence[int], penalty: float = 1e-8) -> np.ndarray:
    """Least-squares weights of outputs on [1, inputs] from a moment matrix."""
    at = [0, *inputs]
    gram = m[np.ix_(at, at)].copy()
    scale = np.trace(gram) / len(at)
    gram[np.arange(1, len(at)), np.arange(1, len(at))] += penalty * max(scale, 1e-300)
    right = m[np.ix_(at, list(outputs))]
    try:
        found = np.linalg.solve(gram, right)
    except np.linalg.LinAlgError:
        found = np.full(right.shape, np.nan)
    return found if np.isfinite(found).all() else np.linalg.lstsq(gram, right, rcond=None)[0]


def mask_errors(mask: np.ndarray, moments: Mapping[int, np.ndarray], total: np.ndarray, y: int) -> list[float]:
    """Held-out RMSE of each fold; the error of a weight vector is a quadratic form in the fold's moments."""
    inputs = (np.flatnonzero(mask) + 1).tolist()
    at, errors = [0, *inputs, y], []
    for held in moments.values():
        u = np.append(-solve_linear(total - held, inputs, [y])[:, 0], 1.0)
        errors.append(float(np.sqrt(max(0.0, u @ held[np.ix_(at, at)] @ u) / held[0, 0])))
    return errors


#: Multiplications beyond which masks are solved on executors. This settles only where.
WORK = 200_000_000


def on_executors(spark, masks: Sequence[np.ndarray], measure: Callable[[np.ndarray], float]) -> list[float]:
    """``measure`` of every mask; masks are rows, dealt over all tasks."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"i": batch["i"], "value": [measure(np.frombuffer(bytes(b), bool)) for b in batch["mask"]]})

    rows = spark.createDataFrame([(i, bytearray(np.asarray(m, bool).tobytes())) for i, m in enumerate(masks)], "i int, mask binary")
    parts = min(len(masks), 4 * spark.sparkContext.defaultParallelism)
    found = rows.repartition(parts).mapInPandas(work, "i int, value double").collect()
    return [r.value for r in sorted(found)]


def linear_regression_scorer(df: DataFrame, features: Sequence[str], target: str) -> Scorer:
    """1 - mean fold RMSE / sd(y) for any mask, from one data pass in all.

    Training moments are total minus fold; the held-out error of a weight vector is a
    quadratic form in the fold's own moments.
    """
    moments = fold_moments(df, [*features, target])
    total = sum(moments.values())
    y = len(features) + 1
    n = total[0, 0]
    sd = np.sqrt(max(0.0, total[y, y] / n - (total[0, y] / n) ** 2))
    if sd < 1e-12:
        raise ValueError("target has zero variance")

    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((moments, total))

    def score(masks: list[np.ndarray]) -> list[float]:
        work = len(moments) * sum(float(np.sum(m) + 1) ** 3 for m in masks)
        if work > WORK:
            errors = on_executors(spark, masks, lambda mask: float(np.mean(mask_errors(mask, *shared.value, y))))
        else:
            errors = [float(np.mean(mask_errors(mask, moments, total, y))) for mask in masks]
        return [float(np.clip(1 - e / sd, 0, 1)) for e in errors]

    return score


def _balanced(counts: np.ndarray) -> float:
    support = counts.sum(axis=1)
    seen = support > 0
    return float(np.mean(np.diag(counts)[seen] / support[seen]))


def _fold_confusions(df: DataFrame, masks: int, classes: int, predict) -> np.ndarray:
    """Sum (mask, fold, truth, called) counts that ``predict`` yields per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, int] = {}
        for batch in batches:
            for key, n in predict(batch).items():
                total[key] = total.get(key, 0) + n
        if total:
            frame = pd.DataFrame(list(total), columns=["mask", "fold", "y", "p"])
            yield frame.assign(n=list(total.values()))

    cells = df.mapInPandas(run, "mask int, fold int, y int, p int, n long")
    return cells.groupBy("mask", "fold", "y", "p").agg(F.sum("n").alias("n")).toPandas()


def _class_scores(cells: pd.DataFrame, masks: int, classes: int) -> list[float]:
    out = []
    for i in range(masks):
        mine = cells[cells["mask"] == i]
        folds = []
        for _, part in mine.groupby("fold"):
            counts = np.zeros((classes, classes))
            counts[part["y"].to_numpy(), part["p"].to_numpy()] = part["n"].to_numpy()
            folds.append(_balanced(counts))
        out.append(float(np.clip(np.mean(folds), 0, 1)) if folds else 0.0)
    return out


def linear_class_scorer(df: DataFrame, features: Sequence[str], label: str, classes: int) -> Scorer:
    """Mean balanced accuracy of least-squares class scores.

    One pass for the moments, then one pass per generation in which every row is scored
    by all masks' weight vectors of its fold.
    """
    features = list(features)
    indicators = [f"_is_{k}" for k in range(classes)]
    wide = df.select("fold", label, *features, *[(F.col(label) == k).cast("double").alias(c) for k, c in enumerate(indicators)])
    moments = fold_moments(wide, [*features, *indicators])
    total = sum(moments.values())
    p = len(features)
    outputs = list(range(p + 1, p + 1 + classes))
    narrow = df.select(F.col("fold").cast("int").alias("fold"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])

    def score(masks: list[np.ndarray]) -> list[float]:
        weights = {f: np.zeros((p + 1, len(masks), classes)) for f in moments}
        for f, held in moments.items():
            for i, mask in enumerate(masks):
                inputs = (np.flatnonzero(mask) + 1).tolist()
                weights[f][[0, *inputs], i, :] = solve_linear(total - held, inputs, outputs)

        def predict(batch: pd.DataFrame) -> dict:
            out: dict[tuple, int] = {}
            for f, part in batch.groupby("fold"):
                a = np.column_stack([np.ones(len(part)), part[features].to_numpy()])
                called = np.tensordot(a, weights[int(f)], axes=1).argmax(axis=2)
                y = part["y"].to_numpy()
                for i in range(called.shape[1]):
                    flat = np.bincount(y * classes + called[:, i], minlength=classes * classes)
                    for cell in np.flatnonzero(flat):
                        out[i, int(f), int(cell // classes), int(cell % classes)] = int(flat[cell])
            return out

        return _class_scores(_fold_confusions(narrow, len(masks), classes, predict), len(masks), classes)

    return score


def neighbour_scorer(df: DataFrame, features: Sequence[str], target: str, classes: int = 0, count: int = 5) -> Scorer:
    """Distance-weighted nearest neighbours of the other folds, exact, for tables of any size.

    One space-partitioned join serves all masks of a generation. Equal rows are one with a count;
    of training rows at equal distances those with the smallest targets count.
    """
    join = neighbours.Join(df, features, target, k=count)
    sd = df.agg(F.stddev_pop(F.col(target).cast("double"))).first()[0] or 1.0

    def score(masks: list[np.ndarray]) -> list[float]:
        found = neighbours.predicted(join.nearest(masks), classes)
        if classes:
            cells = found.select("mask", "fold", F.col("y").cast("int").alias("y"), F.col("p").cast("int").alias("p"), "copies")
            return _class_scores(cells.groupBy("mask", "fold", "y", "p").agg(F.sum("copies").alias("n")).toPandas(), len(masks), classes)
        error = F.col("p") - F.col("y")
        folds = found.groupBy("mask", "fold").agg(F.sqrt(F.sum(F.col("copies") * error * error) / F.sum("copies")).alias("rmse"))
        rmse = {r["mask"]: r["rmse"] for r in folds.groupBy("mask").agg(F.avg("rmse").alias("rmse")).collect()}
        return [float(np.clip(1 - rmse[i] / sd, 0, 1)) if i in rmse else 0.0 for i in range(len(masks))]

    return score


def forest_scorer(df: DataFrame, features: Sequence[str], target: str, classes: int = 0, trees: int = 60, seed: int = 42) -> Scorer:
    """Random forests per mask and fold; the costliest scorer."""
    folds = [r[0] for r in df.select("fold").distinct().orderBy("fold").collect()]
    sd = df.agg(F.stddev_pop(target)).first()[0] or 1.0
    kind = RandomForestClassifier if classes else RandomForestRegressor

    def score(masks: list[np.ndarray]) -> list[float]:
        out = []
        for mask in masks:
            columns = [f for f, on in zip(features, mask) if on]
            wide = VectorAssembler(inputCols=columns, outputCol="_x").transform(df)
            values = []
            for f in folds:
                model = kind(featuresCol="_x", labelCol=target, numTrees=trees, seed=seed).fit(wide.filter(F.col("fold") != f))
                scored = model.transform(wide.filter(F.col("fold") == f))
                if classes:
                    hit = F.avg((F.col("prediction") == F.col(target)).cast("double"))
                    values.append(scored.groupBy(target).agg(hit.alias("r")).agg(F.avg("r")).first()[0])
                else:
                    e = F.col("prediction") - F.col(target)
                    values.append(scored.agg(F.sqrt(F.avg(e * e))).first()[0])
            mean = float(np.mean(values))
            out.append(float(np.clip(mean if classes else 1 - mean / sd, 0, 1)))
        return out

    return score


SCORERS = {"linear": None, "knn": neighbour_scorer, "forest": forest_scorer}


def make_scorer(name: str, df: DataFrame, features: Sequence[str], target: str, classes: int = 0) -> Scorer:
    if name == "linear":
        return linear_class_scorer(df, features, target, classes) if classes else linear_regression_scorer(df, features, target)
    return SCORERS[name](df, features, target, classes)


# ---------------------------------------------------------------- the search
@dataclass(frozen=True)
class SearchSettings:
    population: int = 30
    generations: int = 40
    alpha: float = 0.85
    sensing: float = 0.5
    smoothing: float = 0.7
    decay: float = 0.97
    strong_percentile: float = 85.0
    min_fraction: float = 0.05
    max_fraction: float = 0.5
    use_field: bool = True
    use_archive: bool = True
    use_elite: bool = True
    stagnation: int = 12
    injection: float = 0.25
    patience: int | None = None
    seed: int = 42

    def bounds(self, p: int) -> tuple[int, int]:
        low = max(1, int(self.min_fraction * p))
        high = min(p, max(low + 1, int(self.max_fraction * p)))
        return min(low, high), high


@dataclass
class SearchResult:
    features: list[str]
    mask: np.ndarray
    fitness: float
    score: float
    evaluations: int
    history: list[tuple] = field(default_factory=list)
    stopped_at: int | None = None

    @property
    def selected(self) -> list[str]:
        return [f for f, on in zip(self.features, self.mask) if on]


HISTORY = "generation int, best_fitness double, mean_fitness double, n_selected int, archive_size int, field_entropy double"


@dataclass(frozen=True)
class Masks:
    """Masks of one generation, a row each, with fitness (after penalties) and score."""

    on: np.ndarray
    fitness: np.ndarray
    score: np.ndarray

    def with_rows(self, at: np.ndarray, other: Masks) -> Masks:
        on, fitness, score = self.on.copy(), self.fitness.copy(), self.score.copy()
        on[at], fitness[at], score[at] = other.on, other.fitness, other.score
        return Masks(on, fitness, score)

    def take(self, at) -> Masks:
        return Masks(self.on[at], self.fitness[at], self.score[at])


@dataclass(frozen=True)
class State:
    """What one generation hands to the next. ``weak`` holds the penalty of each weak mask,
    ``guide`` how much strong masks agree on each feature."""

    generation: int
    people: Masks
    best: Masks
    weak: dict[bytes, float]
    guide: np.ndarray | None
    since_best: int
    since_new: int


class Judge:
    """Fitness of masks: score and lightness; each mask is scored once, unseen ones in one call."""

    def __init__(self, scorer: Scorer, alpha: float):
        self.scorer, self.alpha, self.known = scorer, alpha, {}

    def __call__(self, on: np.ndarray, weak: Mapping[bytes, float]) -> Masks:
        keys = [m.tobytes() for m in on]
        unseen = {k: m for k, m in zip(keys, on) if k not in self.known}
        if unseen:
            self.known |= zip(unseen, self.scorer(list(unseen.values())))
        score = np.array([self.known[k] for k in keys])
        raw = self.alpha * score + (1 - self.alpha) * (1 - on.mean(axis=1))
        penalty = np.array([weak.get(k, 0.0) for k in keys])
        return Masks(on, np.where(penalty > 0, np.maximum(0.0, raw - penalty), raw), score)


def random_masks(count: int, p: int, sizes: tuple[int, int], rng) -> np.ndarray:
    """Masks of random size within bounds: the features with the smallest random ranks."""
    size = rng.integers(sizes[0], sizes[1] + 1, (count, 1))
    return rng.random((count, p)).argsort(axis=1).argsort(axis=1) < size


def resized(on: np.ndarray, sizes: tuple[int, int], rng) -> np.ndarray:
    """The same masks with random features switched on or off until their size is within bounds.

    Ranked with features that are on first, in random order, the first ones up to the size stay.
    """
    rank = (rng.random(on.shape) - on).argsort(axis=1).argsort(axis=1)
    return rank < np.clip(on.sum(axis=1), *sizes)[:, None]


def penalties(state: State, s: SearchSettings, bar: float) -> dict[bytes, float]:
    """Earlier penalties and those of masks below the bar, one decay later."""
    if not s.use_archive:
        return {}
    below = {m.tobytes(): float(bar - f) for m, f in zip(state.people.on, state.people.fitness) if f < bar}
    merged = {k: max(below.get(k, 0.0), state.weak.get(k, 0.0)) * s.decay for k in {**state.weak, **below}}
    return {k: x for k, x in merged.items() if x > 1e-6}


def guidance(state: State, s: SearchSettings, bar: float, rng) -> np.ndarray:
    """Strongest noisy vote of a strong mask for each feature, smoothed over generations."""
    if not s.use_field:
        return np.zeros(state.people.on.shape[1])
    strong = state.people.take(state.people.fitness >= bar)
    above = strong.fitness - strong.fitness.min()
    weight = above / above.max() if above.max() >= 1e-9 else np.ones_like(above)
    votes = s.sensing * weight[:, None] + (1 - s.sensing) * rng.random(strong.on.shape)
    now = (votes * strong.on).max(axis=0)
    return now if state.guide is None else s.smoothing * now + (1 - s.smoothing) * state.guide


def offspring(state: State, guide: np.ndarray, s: SearchSettings, sizes: tuple[int, int], rng) -> np.ndarray:
    """Children of weaker than average parents take features from the best mask where the guide says
    so, else from the parent or a coin; children of the others seldom change one feature."""
    parents = state.people.take(slice(0, len(state.people.fitness) - s.use_elite))
    draw, keep, coin = rng.random((3, *parents.on.shape))
    own = keep < s.sensing * parents.fitness[:, None]
    mixed = np.select([draw < guide, own], [np.broadcast_to(state.best.on, own.shape), parents.on], coin < 0.5)
    chance = np.full(own.shape, np.inf)
    chance[np.arange(len(own)), rng.integers(own.shape[1], size=len(own))] = rng.random(len(own))
    weaker = parents.fitness < state.people.fitness.mean()
    children = resized(np.where(weaker[:, None], mixed, parents.on ^ (chance < 0.05)), sizes, rng)
    return np.vstack([state.best.on, children]) if s.use_elite else children


def next_state(state: State, judge: Judge, s: SearchSettings, sizes: tuple[int, int]) -> State:
    """The generation after ``state``; its random numbers depend on the seed and its number only."""
    rng = np.random.default_rng([s.seed, state.generation + 1])
    bar = np.percentile(state.people.fitness, s.strong_percentile)
    weak, guide = penalties(state, s, bar), guidance(state, s, bar, rng)
    people = judge(offspring(state, guide, s, sizes, rng), weak)
    is_best = (people.on == state.best.on).all(axis=1)
    if s.use_elite:
        # The best mask keeps its place and, whatever its penalty, its fitness.
        people = people.with_rows(np.flatnonzero(is_best)[:1], state.best)
    since_new = state.since_new + 1
    if since_new >= s.stagnation:
        replaceable = np.flatnonzero(~is_best) if s.use_elite else np.arange(len(is_best))
        count = min(len(replaceable), max(1, int(len(is_best) * s.injection)))
        at = replaceable[people.fitness[replaceable].argsort()[:count]]
        people, since_new = people.with_rows(at, judge(random_masks(count, len(guide), sizes, rng), weak)), 0
    lead = people.take([int(people.fitness.argmax())])
    better = bool(lead.fitness[0] > state.best.fitness[0])
    return State(
        state.generation + 1, people, lead if better else state.best, weak, guide,
        0 if better else state.since_best + 1, 0 if better else since_new,
    )


def entropy(guide: np.ndarray) -> float:
    """Evenness of the guide over the features, 0 to 1."""
    share = np.clip(guide, 1e-12, 1)
    share = share / share.sum()
    return float(-(share @ np.log(share)) / np.log(guide.size)) if guide.size > 1 else 0.0


def search(features: Sequence[str], scorer: Scorer, settings: SearchSettings = SearchSettings()) -> SearchResult:
    """Evolve masks: agreement among strong masks guides mutation, weak masks are
    penalised on revisits for a while."""
    s, p = settings, len(features)
    if p < 2:
        raise ValueError("the search needs at least two features")
    sizes, judge = s.bounds(p), Judge(scorer, s.alpha)
    first = judge(random_masks(max(4, s.population), p, sizes, np.random.default_rng([s.seed, 0])), {})
    state = State(0, first, first.take([int(first.fitness.argmax())]), {}, None, 0, 0)
    history: list[tuple] = []
    stopped_at = None
    for generation in range(s.generations):
        state = next_state(state, judge, s, sizes)
        history.append((
            generation, float(state.best.fitness[0]), float(state.people.fitness.mean()), int(state.best.on.sum()),
            len(state.weak), entropy(state.guide),
        ))
        if s.patience and state.since_best >= s.patience:
            stopped_at = generation
            break
    return SearchResult(
        list(features), state.best.on[0], float(state.best.fitness[0]), float(state.best.score[0]), len(judge.known), history, stopped_at
    )


def history_table(spark, result: SearchResult) -> DataFrame:
    return spark.createDataFrame(result.history, HISTORY)


# Names and settings of the ablation variants.
VARIANTS = {
    "full": {},
    "no_quorum_sensing": {"use_field": False},
    "no_quorum_quenching": {"use_archive": False},
    "no_elitism": {"use_elite": False},
    "no_sensing_no_quenching": {"use_field": False, "use_archive": False},
    "random_search": {"use_field": False, "use_archive": False, "use_elite": False},
}


def side_by_side(jobs: Sequence[Callable[[Scorer], SearchResult]], scorer: Scorer) -> list[SearchResult]:
    """Run searches at once; masks they wait for at the same time are scored in one call."""
    waiting: dict[int, tuple[list[np.ndarray], Future]] = {}
    active, ready = len(jobs), Condition()

    def run(k: int) -> SearchResult:
        def ask(masks: list[np.ndarray]) -> list[float]:
            answer: Future = Future()
            with ready:
                waiting[k] = (list(masks), answer)
                ready.notify()
            return answer.result()

        nonlocal active
        try:
            return jobs[k](ask)
        finally:
            with ready:
                active -= 1
                ready.notify()

    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        results = [pool.submit(run, k) for k in range(len(jobs))]
        while True:
            with ready:
                ready.wait_for(lambda: len(waiting) >= active)
                if not active:
                    break
                batch, order = dict(waiting), sorted(waiting)
                waiting.clear()
            try:
                values = iter(scorer([m for k in order for m in batch[k][0]]))
                for k in order:
                    batch[k][1].set_result([next(values) for _ in batch[k][0]])
            except BaseException as problem:
                for k in order:
                    batch[k][1].set_exception(problem)
        return [r.result() for r in results]


def ablation_runs(
    spark, features: Sequence[str], scorer: Scorer, settings: SearchSettings = SearchSettings(),
    seeds: Sequence[int] = (42, 52, 62), variants: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (variant, seed, feature); the runs go side by side and share one scorer's data pass."""
    plans = [(name, seed, replace(settings, seed=seed, **VARIANTS[name])) for name in variants or VARIANTS for seed in seeds]
    found = side_by_side([lambda ask, own=own: search(features, ask, own) for _, _, own in plans], scorer)
    rows = [
        (name, seed, run.fitness, run.score, f, bool(on))
        for (name, seed, _), run in zip(plans, found, strict=True) for f, on in zip(features, run.mask)
    ]
    return spark.createDataFrame(rows, "variant string, seed int, fitness double, score double, feature string, selected boolean")


def ablation_table(runs: DataFrame) -> DataFrame:
    """Mean and sd of fitness and score per variant and the change against ``full``."""
    each = runs.groupBy("variant", "seed").agg(
        F.first("fitness").alias("fitness"), F.first("score").alias("score"),
        F.sum(F.col("selected").cast("int")).alias("k"),
    )
    stats = each.groupBy("variant").agg(
        F.avg("fitness").alias("fitness_mean"), F.coalesce(F.stddev_samp("fitness"), F.lit(0.0)).alias("fitness_std"),
        F.avg("score").alias("score_mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("score_std"),
        F.avg("k").alias("selected_mean"),
    )
    on = runs.filter("selected").select("variant", "seed", "feature")
    size = each.select("variant", "seed", "k")
    a, b = on.withColumnRenamed("seed", "a"), on.withColumnRenamed("seed", "b")
    shared = a.join(b, ["variant", "feature"]).filter("a < b").groupBy("variant", "a", "b").agg(F.count(F.lit(1)).alias("both"))
    pairs = size.toDF("variant", "a", "ka").join(size.toDF("variant", "b", "kb"), "variant").filter("a < b")
    jaccard = pairs.join(shared, ["variant", "a", "b"], "left").groupBy("variant").agg(
        F.avg(F.coalesce("both", F.lit(0)) / (F.col("ka") + F.col("kb") - F.coalesce("both", F.lit(0)))).alias("mean_jaccard")
    )
    full = stats.filter("variant = 'full'").select("fitness_mean").first()
    joined = stats.join(jaccard, "variant", "left")
    return joined.withColumn("delta_vs_full", F.round(F.col("fitness_mean") - F.lit(full[0] if full else None), 6))


# Budgets a caller can ask for by name, as (settings, folds, scorer). The
# size of a table chooses none of them.
BUDGETS: dict[str, tuple[SearchSettings, int, str]] = {
    "large": (SearchSettings(population=16, generations=15), 3, "linear"),
    "medium": (SearchSettings(population=24, generations=30), 5, "knn"),
    "small": (SearchSettings(population=30, generations=50), 5, "forest"),
}
