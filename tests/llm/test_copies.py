"""Near copies, fuzzy lines and repeated strings against brute force."""

import random
import re
from collections import Counter

import numpy as np
import xxhash

from tests.llm.frames import ODD, docs, empty, words
from tidemark.llm import components, lines, simhash, suffixes


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_print(text):
    found = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(2)
    base = [words(rng, 120) for _ in range(40)]
    changed = []
    for _ in range(160):
        parts = rng.choice(base[:12]).split()
        for _ in range(rng.randint(0, 3)):
            parts[rng.randrange(len(parts))] = "new"
        changed.append(" ".join(parts))
    return base + changed + ODD + ODD[:2] + ["one", "ONE ", "one two"]


def test_near_copies(spark):
    texts = near_texts()
    prints = np.array([plain_print(t) for t in texts], np.uint64)
    assert prints.tolist() == [simhash.fingerprint(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= 4):
            a, b = find(parent, i), find(parent, int(j))
            parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (f"{int(p):016x}", find(parent, i)) for i, p in enumerate(prints)}
    kept = simhash.one_of_each(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(parent, i) for i in range(len(texts))})
    assert kept.columns == docs(spark, []).columns


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    texts = near_texts()
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    monkeypatch.setattr(simhash, "TILE", 2048)
    assert got == {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}


def test_near_copies_without_ids_or_rows(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (None, "q r s t u v"), (5, "a b c d e"), (9, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(table).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (None, None), (5, 5), (9, 9)], key=str)
    assert sorted((r.doc_id or -1 for r in simhash.one_of_each(table).collect())) == [-1, -1, 5, 9]
    assert simhash.near_duplicates(empty(spark)).count() == simhash.one_of_each(empty(spark)).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(2_000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain_distance(a, b)


def line_texts():
    rng = random.Random(4)
    common = [words(rng, rng.randint(4, 30)) for _ in range(12)]
    texts = []
    for _ in range(80):
        own = [words(rng, rng.randint(1, 20)) for _ in range(rng.randint(0, 3))]
        for line in rng.sample(common, rng.randint(0, 3)):
            parts = line.split()
            if rng.random() < 0.5:
                parts[rng.randrange(len(parts))] = rng.choice(["x", "yz", "other"])
            own.append(rng.choice([" ".join(parts), "  " + " ".join(parts).upper()]))
        rng.shuffle(own)
        texts.append("\n".join(own))
    return texts + ODD


def test_fuzzy_lines(spark):
    texts = line_texts()
    places = {}
    for i, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            if (normal := lines.normalised(line)).count(" ") >= lines.MIN_WORDS - 1:
                places.setdefault(normal, []).append((i, k))
    distinct = list(places)
    _, prints = lines.prints_of(distinct)
    parent = list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= lines.RADIUS):
            if lines.alike(distinct[i], distinct[j], lines.SIMILARITY):
                a, b = find(parent, i), find(parent, int(j))
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, normal in enumerate(distinct):
        groups.setdefault(find(parent, i), []).extend(places[normal])
    going = {p for group in groups.values() for p in sorted(group)[1:]}
    want = {i: None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in going) for i, t in enumerate(texts)}
    got = lines.deduplicated(docs(spark, texts))
    assert got.columns == docs(spark, []).columns
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert any(len(g) > 1 for g in groups.values()) and len(groups) < len(distinct)


def test_lines_of_no_rows_and_of_repeated_rows(spark):
    assert lines.deduplicated(empty(spark)).count() == 0
    rows = [(1, "one two three four\nmine alone it is"), (1, "one two three four\nmine alone it is"), (2, "one two three four"), (None, "one two three four")]
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), report="gone").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "mine alone it is")] * 2 + [("2", ""), ("None", "one two three four")]


def plain_spans(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for text in texts:
        covered = np.zeros(len(text) + 2, np.int8)
        for i in range(len(text) - length + 1):
            if counts[text[i : i + length]] > 1:
                covered[i + 1 : i + 1 + length] = 1
        edge = np.diff(covered)
        yield list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def repeat_texts():
    rng = random.Random(5)

    def some(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passages = [some(rng.randint(20, 120)) for _ in range(6)]
    texts = [None, "", "a" * 200, "ab" * 90]
    for _ in range(100):
        text = ""
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                j = rng.randrange(len(p))
                p = p[:j] + rng.choice("xyz") + p[j + 1 :]
            text += some(rng.randint(0, 60)) + p
        texts.append(text)
    return texts + texts[20:30] + [t + some(5) for t in texts[30:60]]


def check_repeats(spark, texts, length, reach):
    got = {r.doc_id: r for r in suffixes.deduplicated(docs(spark, texts), length=length, reach=reach).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (text, spans) in enumerate(zip(raw, plain_spans(raw, length), strict=True)):
        assert [(s.begin, s.end) for s in got[i].spans] == spans
        kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(b for b, _ in spans), len(text)], strict=True))
        assert bytes(got[i].kept) == kept and got[i].n_bytes == len(text)


def test_repeated_strings(spark):
    check_repeats(spark, repeat_texts(), 40, 16)


def test_repeated_strings_of_crowded_cores(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 5)
    monkeypatch.setattr(suffixes, "STEP", 4)
    check_repeats(spark, repeat_texts(), 40, 16)


def test_repeated_strings_of_no_rows(spark):
    assert suffixes.deduplicated(empty(spark)).count() == 0


def test_pieces_change_no_anchor():
    rng = random.Random(6)
    text = bytes(rng.choice(b"abcd") for _ in range(3_000))

    def windows(piece):
        suffixes.PIECE = piece
        found = set()
        for data, valid, _, offset in suffixes.pieces([b"xyz", text], 40):
            for a, p, q in zip(*suffixes.anchors(np.frombuffer(data, np.uint8), valid, 16), strict=True):
                found |= {(int(offset[w]), int(offset[a])) for w in range(p, q + 1)}
        return found

    whole = windows(1_000_000)
    assert len(whole) == 3_000 - 39 and windows(50) == whole
    suffixes.PIECE = 1_000_000


def test_merge_gives_sorted_suffixes_and_what_neighbours_share():
    rng = random.Random(7)
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    for count in (1, 2, 3, 7):
        runs = []
        for part in (sorted(rows[i::count]) for i in range(count)):
            common = [0, *(suffixes.shared(a, b) for a, b in zip(part, part[1:], strict=False))]
            rest = [p[c:] for p, c in zip(part, common, strict=True)]
            n = len(part)
            runs.append(suffixes.Run({"shared": common, "sizes": [len(r) for r in rest], "rest": b"".join(rest), "left_sizes": [0] * n, "left": b"", "core": [0] * n, "content": [0] * n, "least": [0] * n, "most": [0] * n}))
        merged = list(suffixes.merge(runs))
        texts = [entry[5] for _, entry in merged]
        assert texts == sorted(rows)
        assert [known for known, _ in merged][1:] == [suffixes.shared(a, b) for a, b in zip(texts, texts[1:], strict=False)]


def test_pairs_and_groups_agree(monkeypatch):
    rng = random.Random(8)
    for _ in range(200):
        block = sorted(((0, i, rng.randint(0, 3), rng.randint(4, 9), bytes(rng.choice(b"ab") for _ in range(10)), b"cc" + bytes(rng.choice(b"ab") for _ in range(18))) for i in range(rng.randint(2, 8))), key=lambda b: b[5])
        block = [(*b[:4], b[4][-b[3] :], b[5][: 20 - b[2]]) for b in block]
        block.sort(key=lambda b: b[5])
        common = [0, *(suffixes.shared(a[5], b[5]) for a, b in zip(block, block[1:], strict=False))]
        by_pairs = suffixes.repeated(block, common, 20)
        monkeypatch.setattr(suffixes, "PAIRS", 0)
        by_groups = suffixes.repeated(block, common, 20)
        monkeypatch.setattr(suffixes, "PAIRS", 8)
        assert [{o for a, z in m for o in range(a, z + 1)} for m in by_pairs] == [{o for a, z in m for o in range(a, z + 1)} for m in by_groups]
