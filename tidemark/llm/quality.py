"""Quality scores from weak labels.

Heuristic labellers vote good, poor or nothing on a text, from counts over the whole of it. How
often each pattern of votes occurs is counted over all documents; on these counts
expectation-maximisation estimates how accurate each labeller is on good and on poor texts, and
so the probability that a pattern belongs to a good one. These posterior labels train a linear
scorer over hashed words and shares, by batch gradient steps on a bounded sample: at most
``SAMPLE`` different rows, those with the lowest hashes of id and text, of at most
``SAMPLE_CHARS`` characters. Every whole text is scored.

Null and empty texts get the votes of a text without words. Repeated rows get repeated scores.
An empty table gives an empty one. Rows without an id are scored and teach as the others do.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import whole

SAMPLE, BUCKETS, SAMPLE_CHARS = 6_000, 1 << 15, 20_000
WORD, MARK = re.compile(r"[^\W\d_]+"), re.compile(r"[^\w\s.,;:!?'\"()-]")
GOOD, POOR, ABSTAIN = 1, 0, -1
#: Weight of the prior as a share of the rows, and how often it says that a good text gets a poor vote.
PRIOR_ROWS, FALSE_ALARM = 1.0, 0.005


@dataclass(frozen=True)
class Counts:
    """What the labellers look at."""

    words: int
    letters: int
    capitals: int
    marks: int
    tokens: int
    distinct: int
    most: int
    repeats: int
    sentences: int
    chars: int


def counts_of(text: str) -> tuple[Counts, Counter]:
    words, tokens = WORD.findall(text), text.split()
    seen = Counter(WORD.findall(text.lower()))
    capitals = sum(map(str.isupper, words)) - sum(1 for w in words if len(w) == 1 and w.isupper())
    sentences = text.count(". ") + text.count(".\n") + text.endswith(".")
    repeats = sum(map(eq, tokens, tokens[1:]))
    return Counts(len(words), sum(map(len, words)), capitals, len(MARK.findall(text)), len(tokens), len(seen), max(seen.values(), default=0), repeats, sentences, len(text)), seen


def band(value: float, poor_below: float, good_from: float, good_to: float, poor_above: float) -> int:
    """Good inside, poor outside, nothing in between."""
    if value < poor_below or value > poor_above:
        return POOR
    return GOOD if good_from <= value <= good_to else ABSTAIN


#: The labellers, and the bands of what they look at.
LABELLERS = {
    "length": lambda c: band(c.words, 5, 30, 50_000, math.inf),
    "word_length": lambda c: band(c.letters / max(c.words, 1), 2, 3, 8, 14),
    "marks": lambda c: band(c.marks / max(c.tokens, 1), 0, 0, 0.02, 0.2),
    "capitals": lambda c: band(c.capitals / max(c.words, 1), 0, 0, 0.05, 0.3),
    "repetition": lambda c: band(c.most / max(c.words, 1), 0, 0, 0.15, 0.3),
    "repeats": lambda c: band(c.repeats / max(c.tokens, 1), 0, 0, 0.02, 0.1),
    "variety": lambda c: band(c.distinct / max(c.words, 1) * math.log(c.words + 2), 0.6, 1.5, math.inf, math.inf),
    "sentences": lambda c: band(c.words / max(c.sentences, 1), 0, 3, 30, 100),
    "letters": lambda c: band(c.letters / max(c.chars, 1), 0.55, 0.7, 0.95, 1.1),
}
#: Labellers in order; a pattern is their votes plus one, as digits to base three.
POWERS = 3 ** np.arange(len(LABELLERS))


def votes_of(counts: Counts) -> np.ndarray:
    return np.array([vote(counts) for vote in LABELLERS.values()], np.int64)


def posterior(patterns: np.ndarray, numbers: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good for each pattern, table of ``P(vote | class)`` by labeller, and share of good.

    Votes are taken as independent given the class; the start says each labeller is right in
    seven of ten votes, which also tells which of the two classes is the good one. A prior worth
    ``PRIOR_ROWS`` of the rows says that good texts seldom get a poor vote: without it the two
    classes may become the two commonest kinds of poor text.
    """
    votes = patterns[:, None] // POWERS[None, :] % 3 - 1
    table = np.empty((2, len(POWERS), 3))
    for j in range(len(POWERS)):
        spread = [(numbers * (votes[:, j] == v)).sum() / numbers.sum() for v in (ABSTAIN, POOR, GOOD)]
        for label, right in ((POOR, [0.7, 0.3]), (GOOD, [0.3, 0.7])):
            table[label, j] = [spread[0], *((1 - spread[0]) * np.array(right))]
    share = 0.5
    table = np.clip(table, 1e-4, 1)
    prior = np.stack([table[GOOD][:, 0], (1 - table[GOOD][:, 0]) * FALSE_ALARM, (1 - table[GOOD][:, 0]) * (1 - FALSE_ALARM)], axis=1)
    for _ in range(steps):
        logs = np.log(table)[:, np.arange(len(POWERS))[None, :], votes + 1].sum(axis=2)
        odds = logs[GOOD] - logs[POOR] + math.log(share / (1 - share))
        good = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        before, share = share, float(np.clip((numbers * good).sum() / numbers.sum(), 0.01, 0.99))
        for label, weight in ((GOOD, numbers * good), (POOR, numbers * (1 - good))):
            for v in range(3):
                table[label, :, v] = ((weight[:, None] * (votes + 1 == v)).sum(axis=0) + 0.5) / (weight.sum() + 1.5)
        believed = PRIOR_ROWS * numbers.sum()
        table[GOOD] = (table[GOOD] * (numbers * good).sum() + prior * believed) / ((numbers * good).sum() + believed)
        if abs(share - before) < 1e-9:
            break
    return good, table, share


@dataclass(frozen=True)
class Model:
    good: dict[int, float]
    accuracy: dict[str, tuple[float, float]]
    weights: np.ndarray


def shares(c: Counts) -> dict[str, float]:
    """Dense features, each of the order of one."""
    words, tokens = max(c.words, 1), max(c.tokens, 1)
    return {
        "bias": 1.0,
        "letters": c.letters / max(c.chars, 1),
        "capitals": 4 * c.capitals / words,
        "marks": 4 * min(c.marks / tokens, 1.0),
        "repeats": 4 * c.repeats / tokens,
        "most": 4 * c.most / words,
        "variety": min(c.distinct / words * math.log(c.words + 2) / 4, 2.0),
        "run": min(words / max(c.sentences, 1), 100) / 25,
        "size": math.log1p(c.chars) / 10,
    }


@lru_cache(maxsize=300_000)
def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def hashed(c: Counts, seen: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values: words by the logarithm of their count, and the shares; a bucket may come twice."""
    dense = shares(c)
    amount = np.log1p(np.fromiter(seen.values(), np.float64, len(seen)))
    at = np.fromiter(map(bucket, seen), np.int64, len(seen))
    own = np.array([bucket(f"share {name}") for name in dense], np.int64)
    return np.concatenate([own, at]), np.concatenate([list(dense.values()), amount / (math.sqrt((amount**2).sum()) or 1.0)])


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights by gradient steps scaled per bucket, all rows at once."""
    at = np.concatenate([b for b, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * value, len(rows)), -30, 30)))
        slope = np.bincount(at, value * (p - target)[row], BUCKETS) / len(rows) + ridge * w
        seen += slope**2
        w -= rate * 0.1 * slope / np.sqrt(seen)
    return w


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Vote patterns over all rows, and a scorer from the posterior labels of a sample."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(int(((votes_of(counts_of(t)[0]) + 1) * POWERS).sum()) for t in whole(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    counted = sorted(rows.select("body").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    if not counted:
        return Model({}, {}, np.zeros(BUCKETS))
    numbers = np.array([r.n for r in counted], np.float64)
    good, table, _ = posterior(np.array([r.pattern for r in counted]), numbers)
    by_pattern = {r.pattern: float(g) for r, g in zip(counted, good, strict=True)}
    # The hashes' lowest share holds about SAMPLE rows; only these leave the executors.
    lowest = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, SAMPLE / numbers.sum())))
    hashed_rows = rows.withColumn("h", F.xxhash64("key", "body")).where(f"h <= {lowest} and (body is null or length(body) <= {SAMPLE_CHARS})")
    sample = sorted(hashed_rows.groupBy("h").agg(F.min("body").alias("body")).collect(), key=lambda r: r.h)[:SAMPLE]
    seen = [counts_of(r.body or "") for r in sample]
    target = np.array([by_pattern.get(int(((votes_of(c) + 1) * POWERS).sum()), 0.5) for c, _ in seen])
    weights = train([hashed(c, words) for c, words in seen], target) if seen else np.zeros(BUCKETS)
    accuracy = {name: (float(table[GOOD, j, 2]), float(table[POOR, j, 1])) for j, name in enumerate(LABELLERS)}
    return Model(by_pattern, accuracy, weights)


def score_text(model: Model, text: str) -> tuple[float, float]:
    """Score of the linear model, and the posterior of the text's votes."""
    counts, seen = counts_of(text)
    at, value = hashed(counts, seen)
    z = float(np.clip((model.weights[at] * value).sum(), -30, 30))
    return 1 / (1 + math.exp(-z)), model.good.get(int(((votes_of(counts) + 1) * POWERS).sum()), 0.5)


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` (0 to 1, higher: better), ``posterior`` of the votes and ``keep`` (score of one half or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(key).schema.add("score", "double").add("posterior", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            found = [score_text(shared.value, t) for t in whole(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), *(pa.array(x, pa.float64()) for x in (zip(*found, strict=True) if found else ([], [])))], schema=out)

    return docs.select(key, F.col(text)).mapInArrow(work, schema).withColumn("keep", F.col("score") >= 0.5)
