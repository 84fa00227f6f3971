"""Encoding and counting equal the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.frames import ODD, docs, empty

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tidemark.llm import bpe, transducer  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    parts = ["a", "b", "'", " ", "  ", "\n", "s", "re", "ll", "9", "½", "é", "日", "😀", "!", "́", "\xa0", "\x1f", "\x85", "\r", "th", "İ", "ß"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    ascii_ = ["".join(rng.choice([chr(c) for c in range(128)] + ["'s", "'re", "  "]) for _ in range(60)) for _ in range(300)]
    every = ["".join(chr(c) for c in range(a, a + 512) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 512)]
    spaced = [" ".join(chr(c) for c in range(a, a + 512) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3000, 512)]
    return [t or "" for t in ODD] + mixed + ascii_ + every + spaced


def test_ids_and_decoding_equal_the_library(library):
    batch = texts()
    ids, counts = bpe.encoder(PATH).encode(batch)
    want = [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert bpe.encoder(PATH).decode(ids, counts) == library.decode_batch(want, skip_special_tokens=False)


def test_counts_equal_the_library(library):
    batch = texts()
    want = [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]
    assert transducer.counter(PATH).count(batch).tolist() == want


def test_a_full_transducer_starts_afresh(monkeypatch, library):
    monkeypatch.setattr(transducer, "KEPT_STATES", 50)
    counter = transducer.Counter(PATH)
    batch = texts()[:300]
    assert counter.count(batch).tolist() == [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]


def test_forgetting_words_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    encoder = bpe.Encoder(PATH)
    for text in texts()[:200]:
        ids, _ = encoder.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables(spark, library):
    odd = ODD + ODD[:3]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in odd]
    rows = {r.doc_id: r for r in bpe.round_trip_digests(docs(spark, odd), PATH).collect()}
    counts = {r.doc_id: r for r in transducer.token_counts(docs(spark, odd), PATH, limit=5).collect()}
    for i, ids in enumerate(want):
        assert rows[i].n_tokens == counts[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((odd[i] or "").encode()).hexdigest()
        assert counts[i].n_bytes == len((odd[i] or "").encode()) and counts[i].over_limit == (len(ids) > 5)
    assert bpe.round_trip_digests(empty(spark), PATH).count() == transducer.token_counts(empty(spark), PATH, 5).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(P.path("word_bpe_49k.json"))
