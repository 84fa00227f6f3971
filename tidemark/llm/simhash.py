"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within ``radius`` bits of each other are linked. Of ``blocks`` blocks of bits such
a pair agrees in ``blocks - radius`` at least, so fingerprints that agree in those blocks are
brought together, sorted by population count and cut into tiles; tile pairs whose counts differ
by more than the radius are skipped, the others compared by exclusive-or and bit count. Equal
fingerprints are one row from the start. A bucket of more than ``TILE`` fingerprints is dealt
out as pairs of salted parts, each pair a group of its own, so no task holds a whole large bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.components import components, settle

RADIUS, BLOCKS = 4, 6
#: Fingerprints a part of a bucket holds on average at most, and rows of one comparison.
TILE, ROWS = 2048, 128
#: One in so many fingerprints tells which buckets are large. This settles only how many tasks share a bucket.
SAMPLED = 16
#: Rows of whole groups compared at once.
BUFFER = 65_536
#: Shingles whose bits are counted at once.
SHINGLES = 65_536


def fingerprint(text: str | None, words_each: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = max(1, len(words) - words_each + 1)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    first = [0, *ends.tolist()]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, count, SHINGLES):
        upto = min(at + SHINGLES, count)
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(first[at:upto], first[at + words_each : upto + words_each] or [first[-1]], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 4) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of every row; null texts have no words."""
    schema = docs.select(key).schema.add("fp", LongType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py(), words_each) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), pa.array(bits.view(np.int64))], schema=out)

    return docs.select(key, F.col(text)).mapInArrow(work, schema)


def agreeing(blocks: int, radius: int) -> list[int]:
    """Masks of the blocks that a pair within the radius can agree in, one for each choice."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def dealt(prints: DataFrame, radius: int, blocks: int, key: str = "fp") -> DataFrame:
    """``bucket``, ``choice``, ``pair`` and the columns of ``prints``, a row for each place of comparison.

    ``key`` tells the rows of ``prints`` apart and deals a large bucket's rows to its parts.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(agreeing(blocks, radius))])
    rows = prints.withColumn("at", F.explode(masks)).withColumn("bucket", F.xxhash64("at.choice", "at.bits")).withColumn("choice", F.col("at.choice")).drop("at")
    return spread(rows, key)


def large_buckets(rows: DataFrame, key: str) -> DataFrame:
    """``bucket`` and ``parts`` of the large ones."""
    sampled = rows.where(F.pmod(F.xxhash64(F.lit("large"), key), F.lit(SAMPLED)) == 0).groupBy("bucket").count().where(F.col("count") > TILE // SAMPLED)
    return settle(sampled.select("bucket", F.ceil(F.col("count") * SAMPLED / TILE).cast("int").alias("parts")), "large")


def spread(rows: DataFrame, key: str, large: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``pair``: a ``large`` bucket is dealt out as pairs of parts, any other is one pair."""
    own = F.pmod(F.xxhash64(key), F.col("parts").cast("long")).cast("int")
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(own, other) * F.col("parts") + F.greatest(own, other))
    )
    return rows.join(large_buckets(rows, key) if large is None else large, "bucket", "left").withColumn("pair", F.explode(pairs)).drop("parts")


def grouped(rows: DataFrame, work: Callable, schema: str, *order: Column) -> DataFrame:
    """Apply ``work`` to whole (bucket, pair) groups lying side by side, sorted by ``order``."""
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return rows.repartition(int(n), "bucket", "pair").sortWithinPartitions("bucket", "pair", *order).mapInArrow(work, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], buffer: int = BUFFER) -> Iterator[pa.Table]:
    """Tables of about ``buffer`` rows that end where a (bucket, pair) group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < buffer:
            continue
        table = pa.Table.from_batches(held)
        group = group_numbers(table)
        end = int(np.searchsorted(group, group[-1]))
        if end:
            yield table.slice(0, end)
        held = table.slice(end).combine_chunks().to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table


def group_numbers(table: pa.Table) -> np.ndarray:
    bucket, pair = table.column("bucket").to_numpy(), table.column("pair").to_numpy()
    return np.append(0, np.cumsum((bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])))


def close_pairs(group: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one group within the radius, tile by tile.

    Rows are sorted by group and population count, so once a later tile shares no group with
    this one, or within a group its counts are out of reach, no further tile is looked at.
    """
    together = np.flatnonzero(np.bincount(group)[group] > 1)
    group, prints = group[together], prints[together].view(np.uint64)
    counts = np.bitwise_count(prints).astype(np.int64)
    for a in range(0, len(prints), ROWS):
        a_end = min(a + ROWS, len(prints)) - 1
        for b in range(a, len(prints), ROWS):
            b_end = min(b + ROWS, len(prints)) - 1
            if group[b] > group[a_end] or (group[a] == group[a_end] == group[b] and counts[b] - counts[a_end] > radius):
                break
            left, right = slice(a, a_end + 1), slice(b, b_end + 1)
            near = np.bitwise_count(prints[left, None] ^ prints[None, right]) <= radius
            near &= group[left, None] == group[None, right]
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            if len(i):
                yield together[i + a], together[j + b]


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hang the labels of linked rows on the smaller label, in place, until they agree."""
    while True:
        x, y = labels[i], labels[j]
        if (x == y).all():
            return
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while (up := labels[labels] != labels).any():
            labels[up] = labels[labels[up]]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges ``a``, ``b`` between distinct ``fp`` that join all fingerprints reachable within the radius.

    A group of linked fingerprints leaves a task as a spanning forest, not as all its pairs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            group, bits = group_numbers(table), table.column("fp").to_numpy()
            labels = np.arange(len(bits))
            for i, j in close_pairs(group, bits, radius):
                join_labels(labels, i, j)
            child = np.flatnonzero(labels != np.arange(len(bits)))
            yield pa.RecordBatch.from_arrays([pa.array(bits[child]), pa.array(bits[labels[child]])], ["a", "b"])

    rows = dealt(prints.select("fp"), radius, blocks).drop("choice")
    return grouped(rows, work, "a long, b long", F.bit_count("fp")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest key among all rows reachable over links, the row's own
    included; rows without a key are linked but lend none, and a group of such rows only has
    a null id. Rows without words share the fingerprint zero. Repeated rows stay repeated.
    """
    rows = settle(fingerprints(docs, key), "prints")
    distinct = settle(rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    roots = settle(components(links(distinct, radius, blocks)).withColumnRenamed("node", "fp"), "roots")
    firsts = settle(roots.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    linked = settle(roots.join(firsts, "root").select("fp", "component_id"), "linked")
    named = settle(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "named")
    return rows.join(named, "fp", "left").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Rows and columns of ``docs`` that stay: of each group of near copies the one with the smallest key.

    Of rows that share this key one stays. Rows without a key are no one's copies and stay.
    """
    groups = near_duplicates(docs, key, **options).where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__key")).distinct()
    first = docs.join(groups, F.col(key) == F.col("__key"), "left_semi").dropDuplicates([key])
    return first.unionByName(docs.where(F.col(key).isNull()))
