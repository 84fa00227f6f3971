"""Language, toxicity and quality: held-out accuracy, plain versions of the measures, odd inputs."""

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import ODD, docs, empty, words
from tidemark.llm import langid, quality, toxicity

SMALL = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables not present")


def plain_profile(text):
    counts = Counter()
    word = ""
    for c in [*text.lower(), " "]:
        if c.isalpha():
            word += c
            continue
        if word:
            padded = f" {word} "
            counts.update(word)
            counts.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
        word = ""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [*map(ord, x[0]), -1]))][: langid.PROFILE]


def key(gram):
    codes = [*map(ord, gram), 0, 0]
    return codes[0] << 42 | codes[1] << 21 | codes[2]


def test_profiles_and_distances_equal_plain_ones():
    rng = random.Random(1)
    own = {"aa": words(rng, 300, "abcde"), "bb": words(rng, 300, "defgh"), "cc": "É ß naïve x.y z"}
    profiles = {n: langid.ranked(*langid.gram_counts(t)) for n, t in own.items()}
    for name, text in own.items():
        assert profiles[name].tolist() == [key(g) for g in plain_profile(text)]
    known = langid.Profiles(profiles)
    for text in [words(rng, 40, "abcd"), words(rng, 40, "fghe"), "a b", "ß"]:
        ranks = plain_profile(text)
        away = {}
        for name, other in own.items():
            at = {g: i for i, g in enumerate(plain_profile(other))}
            away[name] = sum(abs(at[g] - i) if g in at else langid.PROFILE for i, g in enumerate(ranks))
        best = min(away, key=lambda n: (away[n], n))
        assert known.predict(text) == (best, 1 - away[best] / (langid.PROFILE * len(ranks)))


def test_pieces_of_a_long_text_count_as_the_whole(monkeypatch):
    text = words(random.Random(2), 200)
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "SLICE_CHARS", 7)
    assert all((a == b).all() for a, b in zip(whole, langid.gram_counts(text), strict=True))


def test_language_of_odd_rows(spark):
    rows = [(1, "abc abc abd", "aa"), (2, "xyz xyw", "bb"), (None, "xyz", None), (3, None, "aa"), (4, "123 !", "aa"), (5, "abc", "aa"), (5, "abc", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(table, langid.learn(table)).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "aa"), ("2", "bb"), ("3", "und"), ("4", "und"), ("5", "aa"), ("5", "aa"), ("None", "bb")]
    assert all(0 <= r.score <= 1 for r in got)
    none = table.limit(0)
    assert langid.learn(none) == {} and langid.predict(none, {}).count() == 0
    assert {r.lang_pred for r in langid.predict(table, {}).collect()} == {"und"}


@needs_tables
def test_languages_held_out(spark):
    from tidemark.llm.queries import QUERIES

    got = QUERIES["op2_rank_order_language"](spark, SMALL)
    both = got.join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert {r.doc_id for r in got.where("held_out").collect()} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}


@needs_tables
def test_toxicity_held_out(spark):
    from tidemark.llm.queries import QUERIES

    tables = Path(SMALL).parent / "sf0.1"
    got = QUERIES["op5_compression_toxicity"](spark, str(tables)).join(spark.read.parquet(f"{tables}/labels.parquet").where("toxic is not null"), "doc_id").where("held_out").collect()
    right = Counter((r.toxic, r.predicted) for r in got)
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.9 and right[0, 0] / (right[0, 0] + right[0, 1]) > 0.99
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got)


def labelled(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        text = words(rng, 40)
        rows.append((i, text + " vilest " + text if i % 4 == 0 else text, int(i % 4 == 0)))
    return spark.createDataFrame(rows + [(None, "vilest", 1), (999, "x", None), (998, None, 1)], "doc_id long, text string, toxic int")


def test_toxicity_of_odd_rows(spark):
    model = toxicity.fit(labelled(spark), labelled(spark))
    rows = docs(spark, [*ODD, *ODD[:2], "vilest vilest", "Vilest!"])
    got = toxicity.scores(rows, model).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(ODD) + 4 and all(0 <= s <= 1 for s in score.values())
    assert score[0] == score[1] == score[2] < 0.5 < min(score[len(ODD) + 2], score[len(ODD) + 3])
    assert toxicity.scored(rows, model, name="s").columns == [*rows.columns, "s"]
    assert toxicity.scores(empty(spark), model).count() == 0


def test_toxicity_without_both_labels(spark):
    table = labelled(spark)
    assert toxicity.fit(table, table.limit(0)).base == 0.0
    only = toxicity.fit(table, table.where("toxic = 1"))
    assert {r.score for r in toxicity.scores(docs(spark, ["a", None]), only).collect()} == {1.0}


def test_savings_follow_common_beginnings():
    distances = toxicity.Distances.of(b"".join(map(toxicity.coded, ["insult", "slur "])), toxicity.coded("common"))
    assert distances.saving("insulting") >= 5 and distances.saving("slur") >= 4
    assert distances.saving("consult") <= 2 and distances.saving("common") <= 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.8
    caught = [0.9, 0.6, 0.4, 0.7, 0.5, 0.8, 0.3, 0.5, 0.6]
    votes = np.stack([np.where(truth, 2, np.where(rng.random(len(truth)) < c, 1, 2)) for c in caught], axis=1)
    patterns, numbers = np.unique((votes * quality.POWERS).sum(axis=1), return_counts=True)
    good, table, share = quality.posterior(patterns, numbers.astype(float))
    found = dict(zip(patterns.tolist(), good, strict=True))
    believed = np.array([found[p] for p in (votes * quality.POWERS).sum(axis=1).tolist()])
    assert abs(share - 0.8) < 0.03 and ((believed > 0.5) == truth).mean() > 0.98
    assert np.abs(table[quality.POOR, :, 1] - caught).max() < 0.05


@needs_tables
def test_quality_against_labels(spark):
    from tidemark.llm.queries import QUERIES

    got = QUERIES["op9_weak_label_quality"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    good, poor = ([r.score for r in got if r.quality == q] for q in (1, 0))
    above = np.mean([[(g > p) + 0.5 * (g == p) for p in poor] for g in good])
    assert above > 0.95 and np.mean([s >= 0.5 for s in good]) > 0.97


def test_quality_of_odd_rows(spark):
    rng = random.Random(5)
    table = docs(spark, [*ODD, *ODD[:2], *[". ".join(words(rng, 12) for _ in range(4)) + "." for _ in range(60)], *["$$ ## %% " * 30] * 20])
    got = quality.scores(table, quality.fit(table)).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
    assert quality.scores(empty(spark), quality.fit(empty(spark))).count() == 0
