"""Text and sequence features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

BUCKETS = 4096


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), F.lit(1))


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    """First four digest bytes, little-endian, modulo the bucket count."""
    digest = F.md5(token)
    swapped = F.concat(*[F.substring(digest, i, 2) for i in (7, 5, 3, 1)])
    return F.pmod(F.conv(swapped, 16, 10).cast("long"), F.lit(buckets)).cast("int")


def hashed_words(df: DataFrame, row_id: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(row, bucket, log1p count) for whole texts.

    Hashing stays in compiled code on exploded words, and since a text is read by one
    task the partial aggregate already holds its final counts: only distinct
    (row, bucket) pairs are exchanged.
    """
    words = spread(df.select(row_id, text)).select(row_id, F.explode(tokens(F.col(text))).alias("token"))
    counts = words.groupBy(row_id, bucket(F.col("token"), buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(row_id, "bucket", F.log1p(F.col("n").cast("double")).alias("weight"))


def join_text(columns: Sequence[str]) -> tuple[Column, Column]:
    """Present parts joined by a space, and whether there is any."""
    parts = [F.col(c).cast("string") for c in columns]
    present = F.lit(False)
    for p in parts:
        present = present | p.isNotNull()
    return F.concat_ws(" ", *parts), present


def kmers(df: DataFrame, sequence: str, k: int = 3, size: int = 1024, out: str = "kmers") -> DataFrame:
    """Hashed counts of overlapping k-letter words of a sequence."""
    letters = df.withColumn("_letters", F.split(F.upper(F.col(sequence)), ""))
    letters = letters.withColumn("_letters", F.filter("_letters", lambda c: c != ""))
    grams = NGram(n=k, inputCol="_letters", outputCol="_grams").transform(letters)
    return HashingTF(numFeatures=size, inputCol="_grams", outputCol=out).transform(grams).drop("_letters", "_grams")
