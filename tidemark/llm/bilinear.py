"""Log-bilinear language model trained by noise-contrastive estimation.

Tokens are the words of a text, A-Z lower-cased, and one end. Words are counted over all training
texts. The ``SINGLES`` most frequent (ties by their bytes) are classes of their own; any other
word belongs to one of ``TAILS`` classes by its last four bytes, within which it has its count
less a discount, and words never seen share what the discounts leave. A word's probability is that of its
class after the two classes before it, from the model, times its share of the class, so the
probabilities of all known words and of an unseen one of every class sum to one.

The score of a class is the product of its vector with the sum of the vectors of the two classes
before, one table for each place, plus a bias that starts as its logarithmic frequency. Each
round learns from another part of the training texts, so that all are read once: tasks take
gradient steps on their own rows against classes drawn as noise, and what they arrive at is
averaged by tokens, block by block, in Spark. As the score is a sum over places, the normalisers
of all pairs of classes are one product of two matrices.

Most words are looked up in a table of at most ``LOOKUP`` counted words; the others of a text are
joined with the counts. A null text is empty and has only its end. Repeated rows are scored, and learnt from,
as often as they occur; rows without an id are never held out. Without training rows
everything is unseen. Long texts are read whole. Other columns pass by untouched.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import settle
from tidemark.llm.texts import slices

#: Classes of one word (one is the end) and of many; numbers of a vector; rounds.
SINGLES, TAILS, WIDTH, ROUNDS = 1_536, 512, 16, 4
#: Tokens of a gradient step, classes drawn as noise for it, and first step size.
STEP, NOISE, RATE = 4_096, 64, 0.05
#: Words looked up in a task, and the longest of them in bytes, which bounds what is sent out.
LOOKUP, LOOKUP_BYTES = 1 << 18, 64
#: Counted words a task holds before it hands them on; numbers of a block when models are averaged.
HELD, BLOCK = 250_000, 4_096
#: Characters of text scored at once, but for a longer one.
CHARS = 2_000_000
#: Rows of normalisers worked out at once.
NORMS = 128
#: Stands for the end of a text among the words; no word holds a blank.
END = b" "


def held_out(key: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def bodies(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (bytes) and ``c`` of every distinct token of the only column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for text in bodies(batch.column(0)):
                held.update(words_of(text))
                held[END] += 1
                if len(held) > HELD:
                    yield hand_on()
        yield hand_on()

    return texts.mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def tail_classes(words: list[bytes], singles: int, tails: int) -> np.ndarray:
    """Class of words that have none of their own, by their endings."""
    return singles + np.fromiter((zlib.crc32(w[-4:]) for w in words), np.int64, len(words)) % tails


@dataclass
class Vocabulary:
    """Looked-up words by falling count; the first ``singles`` are classes. ``sizes`` (tokens, words, discount) is by tail class."""

    words: list[bytes]
    counts: np.ndarray
    singles: int
    tails: int
    tokens: int
    distinct: int
    frequency: np.ndarray
    sizes: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))

    @property
    def classes(self) -> int:
        return self.singles + self.tails

    def share(self, cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's part of its tail class, of count 0 if unseen; a class without words is all unseen."""
        tokens, words, discount = self.sizes[cls - self.singles].T
        left = np.where(tokens > 0, discount * words, 1.0)
        return np.log10(np.where(counts > 0, counts - discount, left) / np.maximum(tokens, 1))


def lookup_words(counts: DataFrame, limit: int) -> list:
    """Rows of the most frequent words, as many whole steps of the count as ``limit`` allows."""
    step = F.floor(F.log2("c") * 64).alias("step")
    short = counts.where((F.octet_length("word") <= LOOKUP_BYTES) & (F.col("word") != F.lit(END)))
    total, cut = 0, None
    for r in sorted(short.groupBy(step).count().collect(), reverse=True):
        total += r["count"]
        if total > limit:
            break
        cut = r.step
    if cut is None:
        return []
    return short.where(step >= cut).collect()


def vocabulary(counts: DataFrame, singles: int = SINGLES, tails: int = TAILS, lookup: int = LOOKUP) -> Vocabulary:
    """What tasks need to know of the counted words; bounded by ``lookup`` words."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    rows = sorted(lookup_words(counts, lookup), key=lambda r: (-r.c, bytes(r.word)))
    words, found = [END, *(bytes(r.word) for r in rows)], np.array([total.ends or 0, *(r.c for r in rows)], np.int64)
    singles = min(singles, len(words))
    own = set(words[:singles])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).to_numpy()
            names = bodies(batch.column(0))
            at = np.array([i for i, w in enumerate(names) if w not in own], np.int64)
            cls = tail_classes([names[i] for i in at.tolist()], singles, tails) - singles
            held = [np.bincount(cls, weights, tails).astype(np.int64) for weights in (c[at], None, c[at] == 1, c[at] == 2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(tails)), *map(pa.array, held)], ["cls", "n", "v", "once", "twice"])

    sizes, kinds = np.zeros((tails, 3)), np.zeros(2)
    rows = counts.mapInArrow(work, "cls long, n long, v long, once long, twice long").groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("n", "v", "once", "twice")]).collect()
    for r in rows:
        sizes[r.cls, :2] = r.n, r.v
        kinds += r.once, r.twice
    sizes[:, 2] = min(max(kinds[0] / (kinds[0] + 2 * kinds[1]), 0.05), 0.95) if kinds.all() else 0.5
    frequency = np.concatenate([found[:singles], sizes[:, 0]]) + 0.5
    return Vocabulary(words, found, singles, tails, total.n, total.v, frequency / frequency.sum(), sizes)


class Tokens:
    """Turns texts into numbers of looked-up words (-1 for others) and classes; built once in a worker."""

    def __init__(self, known: Vocabulary):
        self.known = known
        self.number = dict(zip(known.words, range(len(known.words)), strict=True))
        cls = np.arange(len(known.words))
        cls[known.singles :] = tail_classes(known.words[known.singles :], known.singles, known.tails)
        self.cls = cls
        self.base = np.log10(known.counts + 1)
        self.share = np.zeros(len(cls))
        self.share[known.singles :] = known.share(cls[known.singles :], known.counts[known.singles :])

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Numbers and classes of all tokens, first token of each text, the words not looked up and their places."""
        words: list[bytes] = []
        starts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            starts[i] = len(words)
            words += words_of(text)
            words.append(END)
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        cls = self.cls[number]
        at = np.flatnonzero(number < 0)
        rest = [words[i] for i in at.tolist()]
        cls[at] = tail_classes(rest, self.known.singles, self.known.tails)
        return number, cls, starts, rest, at


def before(cls: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places before each token; ``begin`` stands before a text."""
    last, far = np.roll(cls, 1), np.roll(cls, 2)
    last[starts] = far[starts] = begin
    second = starts[np.diff(np.append(starts, len(cls))) > 1] + 1
    far[second] = begin
    return last, far


@dataclass
class Model:
    """Vectors of classes one and two places before, vectors and biases of the class itself."""

    last: np.ndarray
    far: np.ndarray
    own: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, frequency: np.ndarray, width: int) -> Model:
        rng, n = np.random.default_rng(7), len(frequency)
        small = lambda rows: (rng.standard_normal((rows, width)) * 0.1).astype(np.float32)
        return cls(small(n + 1), small(n + 1), small(n), np.log(frequency).astype(np.float32))

    @classmethod
    def of(cls, flat: np.ndarray, classes: int, width: int) -> Model:
        size = (classes + 1) * width
        return cls(flat[:size].reshape(-1, width), flat[size : 2 * size].reshape(-1, width), flat[2 * size : -classes].reshape(-1, width), flat[-classes:])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.last.ravel(), self.far.ravel(), self.own.ravel(), self.bias])

    def log_probabilities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by class before and class, for both places, and the normaliser of each pair before.

        The probability of w after (u, v) has the logarithm last[v, w] + far[u, w] - norm[v, u].
        """
        last, far = self.last @ self.own.T + self.bias, self.far @ self.own.T
        top, high = last.max(axis=1), far.max(axis=1)
        right = (far - high[:, None]).astype(np.float64)
        right = np.exp(right, out=right).T
        norm = np.empty((len(last), len(far)), np.float32)
        for at in range(0, len(last), NORMS):
            some = slice(at, at + NORMS)
            norm[some] = np.log(np.exp((last[some] - top[some, None]).astype(np.float64)) @ right) + top[some, None] + high[None]
        return last, far, norm


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by their number."""
    return np.stack([np.bincount(at, column, size) for column in rows.T], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Learner:
    """Steps of noise-contrastive estimation with step sizes that fall with the gradients seen."""

    def __init__(self, model: Model, frequency: np.ndarray, noise: int, rate: float, seed: int):
        self.model, self.rate, self.noise = model, rate, noise
        self.odds = (np.log(frequency) + np.log(noise)).astype(np.float32)
        self.sum, self.rng = np.cumsum(frequency), np.random.default_rng(seed)
        self.seen = [np.full_like(a, 1e-8) for a in (model.last, model.far, model.own, model.bias)]

    def step(self, last: np.ndarray, far: np.ndarray, cls: np.ndarray) -> None:
        m = self.model
        drawn = np.minimum(np.searchsorted(self.sum, self.rng.random(self.noise) * self.sum[-1]), len(m.bias) - 1)
        query, own, other = m.last[last] + m.far[far], m.own[cls], m.own[drawn]
        true = sigmoid((query * own).sum(axis=1) + m.bias[cls] - self.odds[cls]) - 1
        false = sigmoid(query @ other.T + (m.bias - self.odds)[drawn])
        back = true[:, None] * own + false @ other
        n = len(m.bias)
        vectors = summed(cls, true[:, None] * query, n) + summed(drawn, false.T @ query, n)
        bias = np.bincount(cls, true, n) + np.bincount(drawn, false.sum(axis=0), n)
        for held, seen, slope in zip((m.last, m.far, m.own, m.bias), self.seen, (summed(last, back, n + 1), summed(far, back, n + 1), vectors, bias), strict=True):
            slope = (slope / len(cls)).astype(np.float32)
            seen += slope * slope
            held -= self.rate * slope / np.sqrt(seen)


WORKER: dict = {}


def in_worker(name: str, token: str, make):
    """What a worker keeps of a broadcast between its tasks; all that it kept of an earlier run goes before anything is made."""
    if WORKER.get("token") != token:
        WORKER.clear()
        WORKER["token"] = token
    if name not in WORKER:
        WORKER[name] = make()
    return WORKER[name]


def learned(texts: DataFrame, known, token: str, model: Model, rounds: int = ROUNDS, step: int = STEP, noise: int = NOISE, rate: float = RATE) -> Model:
    """The model after each round's share of the training texts (``text``, ``share``)."""
    classes, width = len(model.bias), model.own.shape[1]

    for k in range(rounds):
        flat = model.flat()

        def work(batches: Iterator[pa.RecordBatch], flat=flat, k=k) -> Iterator[pa.RecordBatch]:
            tokens = in_worker("tokens", token, lambda: Tokens(known.value))
            learner = Learner(Model.of(flat.copy(), classes, width), known.value.frequency, noise, rate / (k + 1) ** 0.5, k)
            done = 0
            for batch in batches:
                texts = bodies(batch.column(0))
                for part in slices([t or b"" for t in texts], CHARS):
                    _, cls, starts, _, _ = tokens.read(texts[part])
                    last, far = before(cls, starts, classes)
                    for at in range(0, len(cls), step):
                        learner.step(last[at : at + step], far[at : at + step], cls[at : at + step])
                    done += len(cls)
            if done:
                parts = np.split(learner.model.flat().astype(np.float64) * done, range(BLOCK, len(flat), BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), zlib.crc32(flat[:1].tobytes() + learner.model.bias.tobytes()))), pa.array(np.full(len(parts), float(done))), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "part", "n", "body"])

        def added(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b.as_py()) for b in table.column("body"))
            n = float(np.sum(table.column("n").to_numpy()))
            return pa.table({"block": [key[0].as_py()], "part": [0], "n": [n], "body": pa.array([total.tobytes()], pa.binary())})

        schema = "block long, part long, n double, body binary"
        parts = texts.where(F.col("share") == k).select("text").mapInArrow(work, schema).withColumn("part", F.col("part") % 32)
        sums = parts.groupBy("block", "part").applyInArrow(added, schema).groupBy("block").applyInArrow(added, schema).collect()
        if sums:
            model = Model.of(np.concatenate([np.frombuffer(r.body) / r.n for r in sorted(sums, key=lambda r: r.block)]).astype(np.float32), classes, width)
    return model


class Scorer:
    """The model as tables of log10 probabilities."""

    def __init__(self, model: Model):
        self.last, self.far, self.norm = model.log_probabilities()
        self.begin = len(model.bias)

    def score(self, cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
        last, far = before(cls, starts, self.begin)
        return (self.last[last, cls] + self.far[far, cls] - self.norm[last, far]).astype(np.float64) / np.log(10)


def scored_heads(rows: DataFrame, known, model, token: str) -> DataFrame:
    """Tokens, known tokens and sums of looked-up words for every row, and the other words with class and count."""
    head = [f.dataType.simpleString() for f in rows.schema][0]
    schema = f"key {head}, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, cls: int, n: int>>"
    kind = pa.list_(pa.struct([("word", pa.binary()), ("cls", pa.int32()), ("n", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = in_worker("tokens", token, lambda: Tokens(known.value))
        scorer = in_worker("scorer", token, lambda: Scorer(model.value))
        for batch in batches:
            texts = bodies(batch.column(2))
            for part in slices([t or b"" for t in texts], CHARS):
                number, cls, starts, rest, at = tokens.read(texts[part])
                seen = np.where(number >= 0, tokens.known.counts[number] > 0, False)
                base = np.where(number >= 0, tokens.base[number], 0.0)
                score = scorer.score(cls, starts) + np.where(number >= 0, tokens.share[number], 0.0)
                ends = np.append(starts[1:], len(cls))
                of = np.searchsorted(at, np.append(starts, len(cls)))
                tails = [[{"word": w, "cls": int(c), "n": n} for (w, c), n in Counter(zip(rest[a:b], cls[at[a:b]].tolist(), strict=True)).items()] for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, len(starts)), batch.column(1).slice(part.start, len(starts)), pa.array(ends - starts),
                        pa.array(np.add.reduceat(seen.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts)), pa.array(tails, kind),
                    ],
                    ["key", "held_out", "n_tokens", "n_known", "base", "score", "tail"],
                )

    return rows.mapInArrow(work, schema)


def scores(
    docs: DataFrame, key: str = "doc_id", text: str = "text", out: Column | None = None, singles: int = SINGLES, tails: int = TAILS, width: int = WIDTH, rounds: int = ROUNDS, lookup: int = LOOKUP, step: int = STEP
) -> DataFrame:
    """The key of every row with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``out`` says which rows are held out from training. ``base_score`` is the log10 probability under
    counts that are one too high, ``score`` that of the model.
    """
    spark = docs.sparkSession
    out = held_out(key) if out is None else out
    rows = docs.select(F.col(key).alias("key"), out.alias("held_out"), F.col(text).alias("text"))
    training = rows.where("not held_out").select("text", F.pmod(F.xxhash64("key", "text"), F.lit(rounds)).alias("share"))
    counts = settle(word_counts(training.select("text")), "words")
    own = vocabulary(counts, singles, tails, lookup)
    known, token = spark.sparkContext.broadcast(own), f"{id(own)}-{np.random.default_rng().integers(1 << 62)}"
    model = learned(training, known, token, Model.start(own.frequency, width), rounds, step)
    sent = spark.sparkContext.broadcast(model)
    heads = settle(scored_heads(rows, known, sent, token).withColumn("row", F.monotonically_increasing_id()), "heads")
    # The rows are written, and workers are reused: what was sent to them goes.
    known.destroy()
    sent.destroy()

    tail = heads.select("row", F.inline("tail")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sizes = spark.createDataFrame([(own.singles + i, *map(float, s)) for i, s in enumerate(own.sizes)], "cls int, tokens double, words double, discount double")
    left = F.when(F.col("tokens") > 0, F.col("discount") * F.col("words")).otherwise(1.0)
    share = F.log10(F.when(F.col("c") > 0, F.col("c") - F.col("discount")).otherwise(left) / F.greatest("tokens", F.lit(1.0)))
    sums = tail.join(F.broadcast(sizes), "cls").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"), F.sum(F.col("n") * share).alias("shares")
    )
    norm = float(np.log10(own.tokens + own.distinct + 1))
    whole = heads.drop("tail").join(sums, "row", "left")
    return whole.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(own.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), (F.col("score") + F.coalesce("shares", F.lit(0.0))).alias("score"),
    )
