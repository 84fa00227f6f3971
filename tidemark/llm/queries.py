"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bilinear, bpe, centroids, decontaminate, langid, lines, quality, simhash, suffixes, topk, toxicity, transducer, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op1_spaced_seed_leaks"] = decontaminate.LEAKS_SQL


@query
def op2_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where("doc_id is not null").where(~langid.held_out()))
    return langid.predict(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op3_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


@query
def op4_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return kept.select(
        "doc_id",
        "n_bytes",
        removed.cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scores = toxicity.scores(docs, model)
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicated(docs, report="removed_lines", least_words=1).select("doc_id", "removed_lines", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
ORACLES["op7_uniform_threshold_topk"] = TOPK_SQL


@query
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs))


@query
def op10_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_scalar_table_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.clustered(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def clusters_sql(rounds: int = centroids.ROUNDS, clusters: int = centroids.CLUSTERS) -> str:
    """The rounds one after another: pairs of vectors and centroids by dimension, nearest, floor of the mean."""
    parts = [
        """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS INTEGER) AS c, x AS m FROM v QUALIFY c < {clusters}),",
    ]
    for k in range(rounds + 1):
        parts.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT r, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS BIGINT) AS d FROM v, c{k}) GROUP BY r),""")
        if k < rounds:
            parts.append(f"""
e{k} AS (SELECT c, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (
    SELECT a{k}.c, unnest(range(1, 65)) AS i, unnest(x) AS y FROM v JOIN a{k} USING (r)) GROUP BY c, i),
m{k} AS (SELECT c, list(y ORDER BY i) AS m FROM e{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} ON m{k}.c = c{k}.c),""")
    parts.append(f"""
s AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a{rounds} GROUP BY c)
SELECT vec_id, a.c AS cluster, a.d AS distance, s.s AS cluster_inertia, CAST((SELECT sum(s) FROM s) AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.m, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN s ON s.c = a.c JOIN c{rounds} ON c{rounds}.c = a.c
""")
    return "".join(parts)


ORACLES["op13_scalar_table_clusters"] = clusters_sql()


@query
def op12_chunk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


#: DuckDB measures edits in bytes, so letters of two bytes are given others of one for that.
WIDE, NARROW = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(0x21, 0x61))).replace("'", "''")


def crc_step(c: int) -> int:
    """What eight steps of the reflected polynomial make of a byte."""
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


#: The hash of an altered run is folded over its bytes.
CRC_STEPS = list(map(crc_step, range(256)))
VARIANTS_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, CAST(count(*) AS BIGINT) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, {CRC_STEPS}[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN doc_id IS NOT NULL AND h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
flat AS MATERIALIZED (SELECT *, translate(word, '{WIDE}', '{NARROW}') AS f FROM words),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM flat a JOIN flat b ON length(b.f) BETWEEN length(a.f) - 1 AND length(a.f) + 1
  WHERE a.word <> b.word AND levenshtein(a.f, b.f) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.last WHERE forms.form IS NOT NULL),
roots AS (SELECT chain.word, arg_max(last, k.n) AS root FROM chain JOIN words k ON k.word = chain.last GROUP BY chain.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
ORACLES["op12_chunk_variants"] = VARIANTS_SQL


@query
def op11_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
