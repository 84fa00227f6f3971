"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text: each holds the
words and beginnings of words whose contexts set its class apart most from the other, the most
telling last. A window of text is compressed with either; the bytes that the toxic dictionary
saves are its distance (against the ordinary one or blanks, as a match can cost more than it saves). Windows are single words, coded so that they match a dictionary as far as they begin alike, in a
fixed frame of blanks; workers compress each word once. A document's score is a logistic function of
its largest saving, of its second largest, and of how many windows save a threshold or more;
dictionary size, threshold and coefficients are calibrated on labelled rows that the
dictionaries have not seen.

Learning takes a bounded sample: at most ``SAMPLE`` rows of either label of at most
``SAMPLE_CHARS`` characters, in hash order of their ids. Scoring reads every whole text. Texts
without a word (null, empty, digits only) score as a text without savings. Without rows of both
labels every score is the share of toxic rows (0 without any). Rows with null ids or labels
teach nothing; repeated rows get repeated scores. Only id, text and label are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.texts import slices, whole

SAMPLE, SAMPLE_CHARS = 2_000, 50_000
#: Pieces per dictionary to choose from, letters of a beginning, contexts a piece needs, compression level, blanks behind a window.
DICTIONARY_PIECES, SHORTEST, LONGEST, MIN_CONTEXTS, LEVEL, FRAME = (8, 16, 32, 64), 4, 6, 4, 6, 40
#: Windows whose distance a worker keeps.
KEPT_WINDOWS = 500_000
#: Blanks behind a dictionary, whose last bytes the compressor does not index.
TAIL = 16
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Dictionary bodies, window threshold, logistic coefficients, and the score where nothing was learnt."""

    toxic: bytes = b""
    ordinary: bytes = b""
    threshold: float = 0.0
    weights: tuple[float, ...] = ()
    base: float = 0.0


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def coded(word: str) -> bytes:
    """Two bytes for each character, drawn from the word up to there: common bytes are a common beginning."""
    out, sum_so_far = bytearray(), 0
    for character in word:
        sum_so_far = zlib.crc32(character.encode(), sum_so_far)
        out += sum_so_far.to_bytes(4)[2:]
    return bytes(out)


def contexts(texts: list[str]) -> tuple[dict[str, int], int]:
    """How many different neighbour pairs each word and each beginning of a word has, and the number of words.

    Short words count whole too, with the blank behind them. Copies of a text add nothing.
    """
    around, total = defaultdict(set), 0
    for text in texts:
        words = ["", *words_of(text), ""]
        total += len(words)
        for before, word, after in zip(words, words[1:], words[2:], strict=False):
            around[word].add((before, after))
    counts: dict[str, int] = defaultdict(int)
    for word, pairs in around.items():
        if len(word) < LONGEST:
            counts[word + " "] += len(pairs)
        for size in range(SHORTEST, min(len(word), LONGEST) + 1):
            counts[word[:size]] += len(pairs)
    return counts, total


def telling(own: dict[str, int], n_own: int, other: dict[str, int], n_other: int) -> list[str]:
    """Pieces of a class by how surely they tell it from the other; of pieces within each other only the first stays."""

    def strength(piece: str) -> float:
        return math.sqrt(own[piece]) * math.log((own[piece] + 0.5) * n_other / ((other.get(piece, 0) + 0.5) * n_own))

    ranked = sorted(((strength(w), len(w), w) for w in own if own[w] >= MIN_CONTEXTS), reverse=True)
    chosen: list[str] = []
    for strong, _, piece in ranked:
        if strong <= 0 or len(chosen) == max(DICTIONARY_PIECES):
            break
        if not any(piece.startswith(c) or c.startswith(piece) for c in chosen):
            chosen.append(piece)
    return chosen


@dataclass
class Distances:
    """Savings of windows under the two dictionaries of a model."""

    toxic: zstandard.ZstdCompressor
    ordinary: zstandard.ZstdCompressor
    plain: zstandard.ZstdCompressor
    known: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, toxic: bytes, ordinary: bytes) -> Distances:
        def compressor(body: bytes) -> zstandard.ZstdCompressor:
            content = zstandard.ZstdCompressionDict(body + b" " * TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)

        size = max(len(toxic), len(ordinary), 8)
        return cls(compressor(toxic.rjust(size)), compressor(ordinary.rjust(size)), compressor(b" " * size))

    def saving(self, word: str) -> int:
        saved = self.known.get(word)
        if saved is None:
            window = coded(word + " ") + b" " * FRAME
            saved = len(self.ordinary.compress(window)) - len(self.toxic.compress(window)) 
            if len(self.known) > KEPT_WINDOWS:
                self.known = {}
            self.known[word] = saved
        return saved

    def profile(self, text: str) -> np.ndarray:
        """Savings of all windows, largest first; two at least."""
        saved = [*map(self.saving, words_of(text)), 0, 0]
        return np.sort(np.array(saved))[::-1]


def features(profile: np.ndarray, threshold: float) -> list[float]:
    return [1.0, profile[0], profile[1], math.log1p(float((profile >= threshold).sum()))]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients by Newton steps on the weighted, lightly penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(rows: list[tuple[str, int]], toxic_share: float) -> Model:
    """Model from labelled texts: every other one for the dictionaries, the rest for calibration."""
    by_label = {y: [t for t, label in rows if label == y] for y in (0, 1)}
    if min(map(len, by_label.values())) < 2:
        return Model(base=toxic_share)
    counted = {y: contexts(texts[::2]) for y, texts in by_label.items()}
    pieces = {y: telling(*counted[y], *counted[1 - y]) for y in (0, 1)}
    held = [(t, y) for y, texts in by_label.items() for t in texts[1::2]]
    y = np.array([label for _, label in held])
    weight = np.where(y == 1, toxic_share / (y == 1).sum(), (1 - toxic_share) / (y == 0).sum()) * len(y)
    best: tuple[float, Model] | None = None
    for size in DICTIONARY_PIECES:
        toxic, ordinary = (b"".join(map(coded, reversed(pieces[label][:size]))) for label in (1, 0))
        distances = Distances.of(toxic, ordinary)
        profiles = [distances.profile(t) for t, _ in held]
        largest = np.array([p[0] for p in profiles])
        steps = np.unique(largest)
        right = [(weight * np.where(y == 1, largest >= t, largest < t)).sum() for t in steps]
        threshold = float(steps[int(np.argmax(right))])
        x = np.array([features(p, threshold) for p in profiles])
        w = logistic(x, y, weight)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum()
        if best is None or loss < best[0]:
            best = loss, Model(toxic, ordinary, threshold, tuple(w.tolist()), toxic_share)
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model from the texts of ``docs`` whose keys ``labels`` holds with a label.

    The sample is drawn from the labels alone, so at most ``2 * SAMPLE`` keys are sent to where
    the texts are and only their texts move. Of rows that share a key one text is taken.
    """
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    drawn = [rows.where(F.col("label") == y).orderBy(F.xxhash64("key"), "key").limit(SAMPLE) for y in (0, 1)]
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).where(f"body is not null and length(body) <= {SAMPLE_CHARS}")
    sample = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "key").groupBy("key", "label").agg(F.min("body").alias("body"))
    return learn([(r.body, r.label) for r in sample.orderBy(F.xxhash64("key"), "key", "label").collect()], toxic / total if total else 0.0)


@lru_cache(maxsize=2)
def distances_of(model: Model) -> Distances:
    return Distances.of(model.toxic, model.ordinary)


def score_text(model: Model, text: str) -> float:
    if not model.weights:
        return model.base
    z = float(np.dot(features(distances_of(model).profile(text), model.threshold), model.weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row."""
    return scored(docs.select(key, text), model, text).drop(text)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs``, and their score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index(text), StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            texts = whole(batch.column(at))
            found = [score_text(shared.value, t) for part in slices(texts) for t in texts[part]]
            columns = [c.cast(f.type) for c, f in zip(batch.columns, out, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], schema=out)

    return docs.mapInArrow(work, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows no label is learnt from: CRC-32 of the id as text leaves 0 modulo 5; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of rows that are not held out."""
    return labels.where("doc_id is not null").where(~held_out())
