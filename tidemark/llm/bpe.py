"""BPE encoding and decoding in batched numpy merge rounds.

The words of a batch that were not seen before lie as byte symbols in one flat array. In each
round every adjacent pair is looked up by binary search over the sorted pair keys, each word
takes its lowest-ranked pair, and all its places in that word merge at once. Words with no
pair left leave the array. Decoding goes through the ids again, not through the input.

Nulls count as empty texts and give no token. Repeated rows give repeated results. Texts are
whole whatever their length; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.llm import vocabulary
from tidemark.llm.texts import slices, whole

#: Ids and words a worker keeps from batch to batch; past either, it starts afresh with the next slice.
KEPT_IDS, KEPT_WORDS = 4_000_000, 400_000


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + sizes[i] - 1`` of all i, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Encoder:
    """Merge rounds over the words of a batch; the ids of known words lie in one flat array."""

    def __init__(self, path: str):
        self.vocab = vocabulary.load(path)
        merges = self.vocab.merges
        keys = merges[:, 0] << 32 | merges[:, 1]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merged = merges[:, 2]
        self.none = len(merges)
        self.words = regex.compile(vocabulary.WORDS)
        self.ascii_words = re.compile(vocabulary.ASCII_WORDS)
        self.special = self.vocab.special_pattern()
        sizes = np.fromiter(map(len, self.vocab.token_bytes), np.int64)
        self.token_size, self.token_start = sizes, np.cumsum(sizes) - sizes
        self.token_data = np.frombuffer(b"".join(self.vocab.token_bytes), np.uint8)
        self.forget()

    def forget(self) -> None:
        special = self.vocab.special
        self.known = {s: i for i, s in enumerate(special)}
        self.ids = np.array(list(special.values()), np.int64)
        self.start, self.size = np.arange(len(special)), np.ones(len(special), np.int64)

    def split(self, text: str) -> list[str]:
        """Special strings and the words between them."""
        if self.special is None or not self.special.search(text):
            return (self.ascii_words if text.isascii() else self.words).findall(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += self.words.findall(text[at : found.start()])
            out.append(found.group())
            at = found.end()
        return out + self.words.findall(text[at:])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.order[at], self.none)

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has (no word is empty)."""
        raw = [w.encode() for w in words]
        symbols = self.vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
        rank = np.full(len(symbols), self.none)
        at = np.flatnonzero(word[1:] == word[:-1])
        rank[at] = self.ranks(symbols[at], symbols[at + 1])
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            lowest = np.minimum.reduceat(rank, starts)
            done = np.repeat(lowest == self.none, sizes)
            finished.append((word[done], symbols[done]))
            hit = np.flatnonzero((rank == np.repeat(lowest, sizes)) & ~done)
            # In a run of overlapping hits every second one, counted from the run's start, merges.
            run = np.append(True, np.diff(hit) != 1)[: len(hit)]
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = ~done
            keep[hit + 1] = False
            moved = (np.cumsum(keep) - 1)[hit]
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            touched = np.zeros(len(rank) + 1, bool)
            touched[moved] = touched[moved - 1] = True
            stale = np.flatnonzero(touched[:-1])
            rank[stale] = self.none
            inner = stale[stale + 1 < len(word)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        of, ids = (np.concatenate(x) for x in zip(*finished, strict=True))
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(raw))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        split = [self.split(t) for t in texts]
        if len(self.ids) > KEPT_IDS or len(self.known) > KEPT_WORDS:
            self.forget()
        new = list(set(chain.from_iterable(split)).difference(self.known))
        if new:
            ids, sizes = self.merge_rounds(new)
            self.known.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
            self.start = np.append(self.start, len(self.ids) + np.cumsum(sizes) - sizes)
            self.size = np.append(self.size, sizes)
            self.ids = np.append(self.ids, ids)
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        counts = np.bincount(text, self.size[words], len(texts)).astype(np.int64)
        return self.ids[ranges(self.start[words], self.size[words])], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text behind each run of ``counts[i]`` ids; bytes that form no character become U+FFFD."""
        sizes = self.token_size[ids]
        data = self.token_data[ranges(self.token_start[ids], sizes)].tobytes()
        ends = np.cumsum(np.append(0, sizes))[np.cumsum(np.append(0, counts))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` (text) of every row."""
    schema = docs.select(key).schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        code, out = encoder(path), to_arrow_schema(schema)
        for batch in batches:
            texts = whole(batch.column(1))
            for part in slices(texts):
                ids, counts = code.encode(texts[part])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                key_part = batch.column(0).slice(part.start, part.stop - part.start).cast(out.field(0).type)
                yield pa.RecordBatch.from_arrays([key_part, lists.cast(out.field(1).type), pa.array(code.decode(ids, counts), pa.string())], schema=out)

    return docs.select(key, F.col(text)).mapInArrow(work, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text, from :func:`encode`."""
    ids = F.col("ids")
    return encode(docs, path).select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
