"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams of one to three characters, most frequent first, ties
by code points. Words are runs of letters, lower-cased, with a blank on either side; n-grams do
not cross words. A text goes to the language whose profile is least out of place: the sum, over
the text's own profile, of how far each n-gram stands from its rank there, or of the profile
length where it is missing. Ties go to the smaller language name. The score is one minus that
sum's share of the largest possible one.

Profiles are counted over all training rows. Rows without text or language teach nothing; a text
without a letter, or with no profile to compare with, is ``und`` with score 0. Repeated rows get
repeated results, long texts are counted piece by piece, other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.texts import SLICE_CHARS, whole
from tidemark.llm.transducer import LETTER, character_kinds

#: N-grams of a profile.
PROFILE = 400
#: Counted n-grams a task holds before it hands them on.
HELD = 400_000
UNKNOWN = "und"


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys (code points in 21 bits each, ordered as the n-grams are) and counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    letters = np.pad(np.where(character_kinds()[codes] == LETTER, codes, 32), (1, 2), constant_values=32)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(codes) + 1, SLICE_CHARS):
        a, b, c = (letters[at + k : min(at + SLICE_CHARS, len(codes) + 1) + k] for k in range(3))
        one, two, three = a != 32, (a != 32) | (b != 32), b != 32
        found = np.concatenate([a[one] << 42, (a << 42 | b << 21)[two], (a << 42 | b << 21 | c)[three]])
        more, n = np.unique(found, return_counts=True)
        keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys of the profile, most frequent first."""
    return keys[np.argsort(-counts, kind="stable")[:PROFILE]]


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Profile of each language, counted over all ``rows``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), whole(batch.column(1)), strict=True):
                keys, counts = gram_counts(body)
                held.setdefault(name, []).append((keys, counts))
                size += len(keys)
                if size > HELD:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    texts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("body")).where("lang is not null and body is not null")
    counted = texts.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(f"rank <= {PROFILE}").select("lang", "rank", "gram").collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(top):
        profiles.setdefault(row.lang, []).append(row.gram)
    return {name: np.array(grams, np.int64) for name, grams in profiles.items()}


class Profiles:
    """Ranks of all n-grams of all profiles side by side."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.keys = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.int64)]))
        self.ranks = np.full((len(self.keys), len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str) -> tuple[str, float]:
        own = ranked(*gram_counts(text))
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        ranks = np.where((self.keys[at] == own)[:, None], self.ranks[at], -1)
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.names[best], 1 - float(away[best]) / (PROFILE * len(own))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = docs.select(key).schema.add("lang_pred", "string").add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, known = to_arrow_schema(schema), Profiles(shared.value)
        for batch in batches:
            found = [known.predict(body) for body in whole(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(out.field(0).type), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], schema=out
            )

    return docs.select(key, F.col(text)).mapInArrow(work, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows no language is learnt from: CRC-32 of the id as text leaves 1 modulo 3; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
