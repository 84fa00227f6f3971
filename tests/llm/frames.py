"""Small tables for the corpus operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, row string, bucket int, key string"


def docs(spark, texts, first: int = 0):
    """Texts numbered from ``first``, with columns whose names the operators use inside."""
    return spark.createDataFrame([(first + i, t, "x", 1, "y") for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(rng: random.Random, count: int, letters: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(count))


#: Nothing, blanks, one character, special strings, many scripts, one very long word.
ODD = [
    None, "", " ", "\n", "a", "a" * 5_000, " x  y\n\n z \t", "don't we'll 're '' 's", "<|endoftext|>", " <|endoftext|> a<|endoftext|>",
    "\x00\x1c\x1d \x85 ﻿​", "'" * 9 + "s", "日本語のテキスト", "naïve Ünïcödé ß", "😀!?é½9", "the" * 3_000,
]
