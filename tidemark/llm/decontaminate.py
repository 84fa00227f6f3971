"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is the hash of the tokens at the positions a fixed mask selects in a window; the masks
skip different positions, so a few changed words leave some seed of a copied passage as it was.
Seeds of training texts meet those of the benchmark; each meeting names a diagonal (where the
item would begin in the text). There the item and the text are compared token by token, and the
item counts as contained if some ``WINDOW`` consecutive tokens of it (the whole item, if
shorter) agree with the text in four fifths of their places.

Null texts have no tokens. Items shorter than a mask say too little to be told from chance and
match nothing. Rows equal in id and text count once. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token positions that make up a seed.
MASKS = ("1110110101", "1101011011", "1011101101")
SPAN = len(MASKS[0])
#: Tokens of an item that have to agree with the text, but for a fifth of them.
WINDOW = 20
#: Most benchmark seeds sent to every executor (24 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def token_hashes(text: str) -> Column:
    """Hashes of the lower-cased runs of letters and digits; empty for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def evaluated(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """``rows`` with a column that is computed once per row, also where a lambda further up reads it again and again."""
    return rows.select("*", F.inline(F.array(F.struct(column.alias(name)))))


def seeds(tokens: DataFrame, *keep: str) -> DataFrame:
    """``mask``, ``at`` and ``seed`` for every window of ``tokens.hashes``, with the columns to keep."""

    def of(mask: str) -> Column:
        starts = F.when(F.size("hashes") >= SPAN, F.sequence(F.lit(0), F.size("hashes") - SPAN)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + p) for p, used in enumerate(mask) if used == "1"]))

    each = tokens.select(*keep, F.posexplode(F.array(*map(of, MASKS))).alias("mask", "of_mask"))
    return each.select(*keep, "mask", F.posexplode("of_mask").alias("at", "seed"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``key``, ``item``, ``matched`` and ``window`` for every item contained in a text.

    ``matched`` is the largest number of agreeing tokens in ``window`` consecutive ones.
    """
    items = benchmark.select(F.col(item).alias("item"), token_hashes(text).alias("item_hashes")).distinct().where(F.size("item_hashes") >= SPAN)
    items = items.withColumn("item_row", F.xxhash64("item", "item_hashes"))
    texts = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("body")).where("body is not null")
    wanted = seeds(items.select("item_row", F.col("item_hashes").alias("hashes")), "item_row").select("mask", "seed", F.col("at").alias("item_at"), "item_row")
    if wanted.count() <= BROADCAST_SEEDS:
        wanted = F.broadcast(wanted)
    found = seeds(texts.select("row", token_hashes("body").alias("hashes")), "row").join(wanted, ["mask", "seed"])
    diagonals = found.select("row", "item_row", (F.col("at") - F.col("item_at")).alias("begins")).distinct()
    places = diagonals.join(items, "item_row").groupBy("row").agg(F.collect_set(F.struct("item", "item_hashes", "begins")).alias("places"))
    contained_in = texts.join(places, "row").dropDuplicates(["row"])
    tokenised = evaluated(contained_in.select("key", "body", "places"), "hashes", token_hashes("body"))
    lined_up = tokenised.select("key", "hashes", F.explode("places").alias("place")).select("key", "hashes", "place.*")
    size = F.size("item_hashes")
    window = F.least(F.lit(WINDOW), size)
    agrees = F.transform("item_hashes", lambda h, i: F.when((i + F.col("begins") >= 0) & (F.get("hashes", i + F.col("begins")) == h), 1).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(1), size - window + 1), lambda s: F.aggregate(F.slice("agrees", s, window), F.lit(0), lambda a, x: a + x)))
    scored = evaluated(lined_up, "agrees", agrees).select("key", "item", best.alias("matched"), window.alias("window")).where("5 * matched >= 4 * window")
    return scored.groupBy("key", "item", "window").agg(F.max("matched").alias("matched")).select(F.col("key").alias(key), F.col("item").alias(item), "matched", "window")


#: The same over the tables ``documents`` and ``benchmark``, with tokens in place of hashes.
LEAKS_SQL = f"""
WITH masks(mask, picks) AS (VALUES {", ".join(f"({i}, {[p + 1 for p, used in enumerate(m) if used == '1']})" for i, m in enumerate(MASKS))}),
doc AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM benchmark WHERE text IS NOT NULL),
doc_at AS (SELECT doc_id, unnest(range(0, len(words) - {SPAN - 1})) AS pos, words FROM doc WHERE len(words) >= {SPAN}),
item_at AS (SELECT item_id, unnest(range(0, len(words) - {SPAN - 1})) AS pos, words FROM item WHERE len(words) >= {SPAN}),
doc_seed AS (SELECT doc_id, pos, mask, array_to_string(list_transform(picks, lambda p: words[pos + p]), ' ') AS seed FROM doc_at, masks),
item_seed AS (SELECT item_id, pos, mask, array_to_string(list_transform(picks, lambda p: words[pos + p]), ' ') AS seed FROM item_at, masks),
diagonal AS (SELECT DISTINCT d.doc_id, i.item_id, d.pos - i.pos AS begins FROM doc_seed d JOIN item_seed i USING (mask, seed)),
agree AS (
  SELECT g.doc_id, g.item_id, least({WINDOW}, len(i.words)) AS win,
         list_transform(range(1, len(i.words) + 1), lambda j: CASE WHEN begins + j >= 1 AND d.words[begins + j] = i.words[j] THEN 1 ELSE 0 END) AS agrees
  FROM diagonal g JOIN doc d USING (doc_id) JOIN item i USING (item_id)),
scored AS (SELECT doc_id, item_id, win, list_max(list_transform(range(1, len(agrees) - win + 2), lambda s: list_sum(agrees[s : s + win - 1]))) AS matched FROM agree)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(win AS INTEGER) AS "window"
FROM scored WHERE 5 * matched >= 4 * win GROUP BY doc_id, item_id, win
"""
