"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.frames import ODD, docs, empty
from tidemark.llm import variants


def plain_words(rows, length, least, drop):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def plain(rows, length=6, least=5, times=5, drop=199):
    counts = plain_words(rows, length, least, drop)
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= times * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def result(table, **options):
    return sorted(map(tuple, variants.variants(table, **options).collect()))


def crowd(rng, count, letters="ab"):
    """Texts of words that share most of their halves, some far more frequent than others."""
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(count)]
    return [" ".join(w for w in base for _ in range(rng.choice((0, 1, 1, 6, 40)))) for _ in range(4)]


@pytest.mark.parametrize("crowded", [0, 40, variants.CROWDED])
def test_pairs_of_crowded_and_other_chunks_equal_all_pairs(spark, crowded):
    texts = crowd(random.Random(4), 240)
    rows = list(enumerate(texts))
    want = plain(rows, drop=7)
    assert result(docs(spark, texts), drop=7, crowded=crowded) == want
    assert sum(w[4] for w in want) > 200 and any(w[1] for w in want)


def test_every_edit_of_a_word_is_found(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghijéÿ") for _ in range(n)) for n in (6, 7, 8, 13)]
    texts = []
    for w in base:
        edits = {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in ("", "z", "é")} - {w}
        texts.append(" ".join([w] * 60 + [e for e in edits for _ in range(7)]))
    assert result(docs(spark, texts)) == plain(list(enumerate(texts)))


def test_odd_texts_repeated_rows_and_rows_without_id(spark):
    texts = [*ODD, "Straße STRASSE straße " * 9, "straßen " * 2, "İstanbul Kelvin " * 9, "a" * 40_000 + " " + "naïveté " * 5_000]
    table = docs(spark, texts)
    null = table.withColumn("doc_id", table.doc_id * None)
    rows = list(enumerate(texts))
    assert result(table.unionByName(table).unionByName(null)) == plain(rows + rows + [(None, t) for t in texts])


def test_empty_table_gives_no_rows(spark):
    got = variants.variants(empty(spark))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0
