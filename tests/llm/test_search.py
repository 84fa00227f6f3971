"""Benchmark passages, exact top-k and the pipeline."""

import random
from pathlib import Path

import pytest

from tests.llm.frames import ODD, docs, empty, words
from tidemark.llm import decontaminate, queries, topk
from tools.check_oracles import compare

SMALL = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables not present")


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_changed_passages_are_found(spark):
    rng = random.Random(1)
    passages = [words(rng, n) for n in (10, 14, 25, 60, 9)]
    texts, want = [], set()
    for i in range(40):
        number = i % 5
        parts = passages[number].split()
        for at in rng.sample(range(len(parts)), min(i // 5 % 3, (len(parts) - 6) // 8)):
            parts[at] = "changed"
        texts.append(f"{words(rng, 30)} {' '.join(parts).upper()}, {words(rng, 30)}")
        if number != 4:
            want.add((i, number))
    texts += [words(rng, 80) for _ in range(20)] + ODD
    got = decontaminate.leaks(docs(spark, texts), items(spark, [*passages, None, ""])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(5 * r.matched >= 4 * r.window for r in got)


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    passages = [words(rng, 30) for _ in range(3)]
    texts = docs(spark, [f"{words(rng, 5)} {p}" for p in passages] * 2 + [passages[0]])
    sent = {tuple(r) for r in decontaminate.leaks(texts, items(spark, passages)).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert {tuple(r) for r in decontaminate.leaks(texts, items(spark, passages)).collect()} == sent and len(sent) == 7


def test_passages_of_no_rows_and_of_repeated_rows(spark):
    passage = words(random.Random(3), 20)
    assert decontaminate.leaks(empty(spark), items(spark, [passage])).count() == 0
    assert decontaminate.leaks(docs(spark, [passage]), items(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, passage), (1, passage), (None, passage)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.leaks(rows, items(spark, [passage])).collect()) == ["1", "None"]


def plain_top(rows, k=5, every=50):
    import math

    best = {}
    for i, x in rows:
        if i is not None and x and all(v is not None and math.isfinite(v) for v in x):
            own = [math.floor(256 * v) for v in x]
            best[i] = min(best.get(i, own), own)
    out = []
    for q in best:
        if q % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(best[q], x)))), v) for v, x in best.items() if v != q)
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_top_k(spark, scale):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * scale for _ in range(7)]) for i in range(230)]
    rows += [(i + 300, rows[i % 9][1]) for i in range(40)]
    rows += [(50, rows[3][1]), (None, rows[0][1]), (400, None), (401, []), (402, [1.0, None]), (450, [float("nan")]), (451, [float("inf")]), (500, [scale, scale])]
    table = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<double>, id string")
    assert sorted(tuple(r) for r in topk.top_k(table).collect()) == plain_top(rows)


def test_top_k_in_blocks_and_with_few_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(table, every=5).collect()) == plain_top(rows, every=5)
    few = table.where("vec_id < 3")
    assert sorted(tuple(r) for r in topk.top_k(few).collect()) == plain_top(rows[:3])
    assert topk.top_k(table.limit(0)).count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    status, detail, _ = compare(spark, SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert status == "ok", detail


@needs_tables
def test_pipeline(spark, tmp_path):
    """Every stage does to the rows it gets what its operator says of them."""
    import corpus_pipeline
    from tidemark.llm import lines, simhash, toxicity

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(None, None, "en", "s", 0), (None, "null id here", None, None, None), (5000, "", "en", "s", 0)], table.schema)
    before, names = table.unionByName(extra), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe_round_trip"]
    columns, steps = before.columns, {"": before}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SMALL).write.parquet(str(tmp_path / name))
        before = steps[name] = spark.read.parquet(str(tmp_path / name))
        assert name == names[-1] or before.columns == columns
    ids = {n: sorted(str(r.doc_id) for r in s.select("doc_id").collect()) for n, s in steps.items()}
    model = toxicity.fit(steps[""], toxicity.training_labels(spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert ids["toxicity"] == sorted(str(r.doc_id) for r in toxicity.scores(steps[""], model).where("score < 0.5").collect())
    assert ids["line_dedup"] == ids["toxicity"]
    assert lines.deduplicated(steps["line_dedup"], report="gone").where("size(gone) > 0").count() == 0
    assert ids["simhash_near_dedup"].count("None") == 2
    groups = simhash.near_duplicates(steps["line_dedup"]).where("doc_id = component_id")
    assert [i for i in ids["simhash_near_dedup"] if i != "None"] == sorted(str(r.doc_id) for r in groups.collect())
    leaks = decontaminate.leaks(steps["simhash_near_dedup"], spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert set(ids["simhash_near_dedup"]) - set(ids["decontamination"]) == {str(r.doc_id) for r in leaks.collect()}
    assert ids["bpe_round_trip"] == ids["decontamination"]
