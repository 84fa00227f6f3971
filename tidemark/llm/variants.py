"""Spelling variants by asymmetric q-chunks.

Words are runs of letters, A-Z lower-cased, counted over all texts. A word of length n gives two
disjoint chunks of n // 2 letters, its beginning and its end; every word gives, for each length
a partner may have, its positional grams of the partner's chunk length. One inserted, deleted or
replaced letter leaves one of the two chunks whole and moves it by one place at most, so near
words meet where chunk and gram are equal and begin within one place; an edit distance with a
cutoff then decides. Where a chunk is so common that its pairs would crowd one key, both sides
also give the chunks and grams of the rest of the word, which again keeps one of two chunks whole.

Null and empty texts have no words. Repeated rows count as often as they occur; in rows without
an id no letter is dropped. Words of equal counts are ordered by code points. An empty table gives
an empty one. Texts are counted whole, whatever their length; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import settle

#: Code points and occurrences a word needs; how much more frequent a form has to be.
LENGTH, LEAST, TIMES = 6, 5, 5
#: A letter is dropped from runs whose hash this number divides.
DROP = 199
#: Pairs of a key beyond which both sides are told apart by the rest of the word too.
CROWDED = 100_000
#: Counted words a task holds before it hands them on.
HELD = 400_000
#: The letters of a run, A-Z already lower-cased, in UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def altered(run: bytes, key: int | None, drop: int = DROP) -> str:
    """The run, short of one letter if ``drop`` divides the hash of key and run."""
    word = run.decode()
    if key is not None and (h := zlib.crc32(b"%d:%s" % (key, run))) % drop == 0:
        word = word[: h % len(word)] + word[h % len(word) + 1 :]
    return word


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, drop: int = DROP) -> DataFrame:
    """``word`` and ``n`` of every word long and frequent enough, over all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for run, n in Counter(RUN.findall(body.lower())).items():
                    if len(run) >= length and len(word := altered(run, row, drop)) >= length:
                        held[word] += n
                if len(held) > HELD:
                    yield hand_on()
        yield hand_on()

    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long"), text)
    return texts.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def pieces(word: Column, start: Column | int, size: Column) -> Column:
    return F.substring(word, F.lit(start) + 1, size)


def chunks(words: DataFrame, word: str = "word") -> DataFrame:
    """``gram``, ``size`` (letters of the word), ``place`` of the two disjoint chunks of every word; other columns stay."""
    size = F.char_length(word)
    half = F.floor(size / 2).cast("int")
    two = F.array(*[F.struct(pieces(F.col(word), at, half).alias("gram"), at.cast("int").alias("place")) for at in (F.lit(0), size - half)])
    return words.withColumn("piece", F.explode(two)).select(*words.columns, size.alias("size"), "piece.gram", "piece.place")


def grams(words: DataFrame, word: str = "word") -> DataFrame:
    """``gram``, ``size`` (letters a partner has) and ``place`` of the positional grams that a partner's chunk can equal."""
    own = F.char_length(word)
    sizes = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: own + d)

    def of(size: Column) -> Column:
        half = F.floor(size / 2).cast("int")
        near = F.array_distinct(F.array(*[F.greatest(at + d, F.lit(0)) for at in (F.lit(0), size - half) for d in (-1, 0, 1)]))
        inside = F.filter(near, lambda p: p + half <= own)
        return F.transform(inside, lambda p: F.struct(size.alias("size"), p.cast("int").alias("place"), pieces(F.col(word), p, half).alias("gram")))

    each = F.explode(F.flatten(F.transform(sizes, of)))
    return words.withColumn("piece", each).select(*words.columns, "piece.size", "piece.gram", "piece.place")


def without(word: str, place: Column, letters: Column) -> Column:
    """The word without the chunk at a place."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + letters + 1, F.char_length(word)))


def finer(side: DataFrame, pieces_of) -> DataFrame:
    """A crowded side by chunk and by the pieces of the rest of the word."""
    rest = side.withColumnsRenamed({"gram": "gram1", "size": "size1", "place": "place1"}).withColumn("rest", without("word", F.col("place1"), F.char_length("gram1")))
    return pieces_of(rest, "rest").withColumnsRenamed({"gram": "gram2", "size": "size2", "place": "place2"}).drop("rest")


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``word`` and ``other`` of all ordered pairs that differ by exactly one edit, once each."""
    left = chunks(words.select("word"))
    right = grams(words.select(F.col("word").alias("word")))
    many = left.groupBy("size", "gram").agg(F.count("*").alias("a")).join(right.groupBy("size", "gram").agg(F.count("*").alias("b")), ["size", "gram"])
    many = settle(many.where(F.col("a") * F.col("b") > crowded).select("size", "gram"), "crowded")
    same = F.abs(F.col("l.place") - F.col("r.place")) <= 1
    edit = F.levenshtein("l.word", "r.word", 1) == 1
    plain = left.join(many, ["size", "gram"], "left_anti").alias("l").join(right.join(many, ["size", "gram"], "left_anti").alias("r"), ["size", "gram"])
    found = plain.where(same & edit).select("l.word", F.col("r.word").alias("other"))
    first, second = finer(left.join(many, ["size", "gram"], "left_semi"), chunks), finer(right.join(many, ["size", "gram"], "left_semi"), grams)
    keys = ["size1", "gram1", "size2", "gram2"]
    both = (F.abs(F.col("l.place1") - F.col("r.place1")) <= 1) & (F.abs(F.col("l.place2") - F.col("r.place2")) <= 1)
    rest = first.alias("l").join(second.alias("r"), keys).where(both & edit).select("l.word", F.col("r.word").alias("other"))
    return found.unionByName(rest).distinct()


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` and ``form_n`` of every word."""
    counted = pairs.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    out = words.join(best, "word", "left")
    much = -F.col("best.less") >= times * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"))


def roots(rows: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """The rows with ``root``, the last of the forms followed from each word.

    A form is ``times`` as frequent as its word, so chains are as short as the logarithm of the
    largest count; every round follows twice as many of them.
    """
    most = rows.agg(F.max("n")).first()[0] or least
    steps = max(1, math.ceil(math.log(max(most / least, 1), times)) + 1)
    links = rows.select("word", F.coalesce("form", "word").alias("to"))
    for k in range(math.ceil(math.log2(steps + 1))):
        if k:
            links = settle(links, "links")
        links = links.join(links.select(F.col("word").alias("to"), F.col("to").alias("next")), "to").select("word", F.col("next").alias("to"))
    return rows.join(links.withColumnRenamed("to", "root"), "word")


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, times: int = TIMES, drop: int = DROP, crowded: int = CROWDED
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word long and frequent enough."""
    words = settle(word_counts(docs, key, text, length, least, drop), "words")
    rows = settle(forms(words, near_pairs(words, crowded), times), "forms")
    return roots(rows, times, least).select("word", "form", "root", "n", "n_near", "form_n")
