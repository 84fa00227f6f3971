"""Log-bilinear scores: counts and base against a plain version, normalised model, held-out gain."""

import math
import random
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.frames import ODD, docs, empty
from tidemark.llm import bilinear


def plain_tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def plain(rows):
    """doc_id to held_out, n_tokens, n_known, train_tokens, base_score."""
    out = [key is not None and zlib.crc32(str(key).encode()) % 7 == 2 for key, _ in rows]
    counts = Counter(t for (_, text), held in zip(rows, out, strict=True) if not held for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [
        (key, held, len(ts := plain_tokens(text)), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts))
        for (key, text), held in zip(rows, out, strict=True)
    ]


def agree(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    off = [(a, b) for a, b in zip(got, want, strict=True) if not math.isclose(a[5], b[5], rel_tol=1e-11)]
    assert not off, off[:3]


def sentences(rng, count, languages=3):
    """Texts of one of a few languages, in each of which a word of a kind follows one of another."""
    stock = [[["".join(rng.choice("abcdefghij") for _ in range(5)) + s for _ in range(40)] for s in "xyz"] for _ in range(languages)]
    out = []
    for _ in range(count):
        kinds = rng.choice(stock)
        out.append(" ".join(rng.choice(kinds[i % 3]) if rng.random() > 0.05 else f"rare{rng.randrange(500)}" for i in range(rng.randint(5, 90))))
    return out


@pytest.mark.parametrize(("singles", "lookup", "least"), [(50, 60, 0.01), (400, 1 << 18, 0.4)])
def test_counts_base_and_gain(spark, singles, lookup, least):
    texts = sentences(random.Random(3), 2_500) + ["The the THE\tthe\x0bthe", "é É", "a\x85b a b"]
    rows = list(enumerate(texts))
    got = bilinear.scores(docs(spark, texts).repartition(3), singles=singles, tails=16, width=8, lookup=lookup, rounds=2, step=32).collect()
    agree(got, plain(rows))
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert len(held) > 50 and gain > least


def test_what_is_not_looked_up_scores_the_same(spark):
    texts = sentences(random.Random(4), 200)
    one, other = ({r.doc_id: r.score for r in bilinear.scores(docs(spark, texts).coalesce(1), singles=40, tails=8, width=4, rounds=0, lookup=n).collect()} for n in (120, 1 << 18))
    assert all(math.isclose(one[k], other[k], rel_tol=1e-9) for k in one)


def test_probabilities_sum_to_one(spark):
    texts = sentences(random.Random(5), 150)
    rows = docs(spark, texts).select("doc_id", "text")
    counts = bilinear.word_counts(rows.select("text"))
    own = bilinear.vocabulary(counts, singles=30, tails=8, lookup=60)
    assert len(own.words) <= 61 and own.tokens == sum(len(plain_tokens(t)) for t in texts)
    rng = np.random.default_rng(1)
    model = bilinear.Model.start(own.frequency, 5)
    model.last, model.far = rng.normal(0, 2, model.last.shape), rng.normal(0, 2, model.far.shape)
    last, far, norm = bilinear.Model.log_probabilities(model)
    for u, v in [(0, 0), (3, 30), (own.classes, own.classes), (37, own.classes)]:
        p = np.exp(last[v] + far[u] - norm[v, u])
        assert math.isclose(p.sum(), 1, rel_tol=1e-4)
    found = {bytes(r.word): r.c for r in counts.collect()}
    tail = [w for w in found if w not in set(own.words[: own.singles])]
    cls = bilinear.tail_classes(tail, own.singles, own.tails)
    share = 10 ** own.share(cls, np.array([found[w] for w in tail]))
    unseen = 10 ** own.share(np.arange(own.singles, own.classes), np.zeros(own.tails))
    assert np.allclose(np.bincount(cls - own.singles, share, own.tails) + unseen, 1)


def test_tokens_see_those_before_them():
    cls, starts = np.array([5, 0, 0, 7, 8, 9, 0]), np.array([0, 2, 3])
    last, far = bilinear.before(cls, starts, 99)
    assert last.tolist() == [99, 5, 99, 99, 7, 8, 9] and far.tolist() == [99, 99, 99, 99, 99, 7, 8]


def test_odd_texts_repeated_rows_and_rows_without_id(spark):
    texts = [*ODD, "word " * 60_000, "x" * 300_000]
    table = docs(spark, texts)
    null = table.withColumn("doc_id", table.doc_id * None)
    rows = list(enumerate(texts))
    got = bilinear.scores(table.unionByName(table).unionByName(null), singles=8, tails=4, width=4, lookup=9, step=512).collect()
    agree(got, plain(rows + rows + [(None, t) for t in texts]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_no_rows_and_no_training_rows(spark):
    assert bilinear.scores(empty(spark)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = bilinear.scores(docs(spark, ["a b"], held), singles=4, tails=4, width=2).collect()
    agree(got, plain([(held, "a b")]))


def test_a_worker_lets_go_of_an_earlier_run_before_it_makes_anything():
    class Table:
        pass

    bilinear.WORKER.clear()
    old = [weakref.ref(bilinear.in_worker(name, "first", Table)) for name in ("tokens", "scorer")]
    seen = []
    bilinear.in_worker("tokens", "second", lambda: seen.append([r() for r in old]))
    bilinear.WORKER.clear()
    assert seen == [[None, None]]
