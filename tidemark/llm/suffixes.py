"""Removal of long repeated strings by a distributed merge sort of suffixes.

Every byte covered by a ``length``-byte string that also starts anywhere else goes.

Which suffixes are sorted. Each such string (a window) is named by one place in it, its anchor:
the leftmost of the smallest hashed 8-grams among its first ``reach`` ones. Equal windows have
their anchors at equal offsets, and the anchor is shared by a run of neighbouring windows, so
the suffixes that begin at anchors, each with the bytes before it that its windows need, stand
for all windows: one in about ``reach / 2`` bytes. All windows of an anchor hold the same core,
the first ``length - reach + 1`` bytes of its suffix. A core that occurs once repeats nowhere;
anchors equal in all their windows are one row with a count from then on.

How they are sorted. Tasks cut the remaining suffixes out of the texts, sort them into runs and
front-code the runs: each suffix is the length it shares with the one before, and the rest.
Runs are exchanged by core and merged by a loser tree that knows for every waiting suffix how
much it shares with the last one put out; unequal lengths settle a comparison without reading,
equal ones let it start behind what is shared. The merge yields the shared lengths of
neighbours, and these, with those of the bytes before the anchors, tell which windows repeat.

A core with more than ``BLOCK`` different suffixes (the edge of a passage that very many texts
share) is not sorted in one task: its windows are compared by counted hashes, all of them.

Nulls count as empty texts. Rows equal in id and text are copies of each other like any two
rows. Texts of any length are cut into pieces of ``PIECE`` window starts for finding anchors,
which changes no result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import settle

LENGTH, REACH, GRAM = 400, 128, 8
BLOCK, STEP = 256, 16
#: Window starts looked at in one pass, and bytes of suffixes sorted into one run.
PIECE, RUN_BYTES = 1_000_000, 8_000_000
#: Suffixes of a merge task on average.
MERGED = 20_000
#: Up to so many suffixes of a core are compared pair by pair.
PAIRS = 8


def anchors(data: np.ndarray, valid: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each run of valid window starts that share an anchor."""
    starts = np.flatnonzero(valid)
    if not len(starts):
        return starts, starts, starts
    count = len(data) - GRAM + 1
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)).view(np.uint64).ravel()
    keys = (grams * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFF000000)
    keys ^= keys >> np.uint64(29) & np.uint64(0xFF000000)
    keys |= np.arange(count, dtype=np.uint64)
    # Smallest key of every ``reach`` neighbours: the end of one block and the beginning of the next.
    blocks = -(-count // reach) + 1
    padded = np.full(blocks * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:count] = keys
    ahead = np.minimum.accumulate(padded.reshape(blocks, reach), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(blocks, reach)[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[starts], ahead[starts + reach - 1]) & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)))
    return anchor[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes of about ``PIECE`` window starts, which of them are valid, and the text and offset of each byte."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for _, _, p in held])
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        valid = at + length <= np.repeat(sizes, sizes)
        return b"".join(p for _, _, p in held), valid, np.repeat([i for i, _, _ in held], sizes), at + np.repeat([o for _, o, _ in held], sizes)

    for i, text in enumerate(texts):
        for begin in range(0, max(len(text) - length + 1, 0), PIECE):
            piece = text[begin : begin + PIECE + length - 1]
            held.append((i, begin, piece))
            size += len(piece)
            if size >= PIECE:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def found_anchors(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """``row``, ``at`` (byte of the anchor), ``least`` and ``most`` (offsets of its windows), ``core`` and ``content`` (hashes)."""
    core_size = length - reach + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for data, valid, text, offset in pieces(texts, length):
                anchor, first, last = anchors(np.frombuffer(data, np.uint8), valid, reach)
                digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
                core = np.fromiter((digest(view[a : a + core_size]) for a in anchor.tolist()), np.uint64, len(anchor))
                content = np.fromiter((digest(view[p : q + length], a - p) for a, p, q in zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(anchor))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[text[anchor]]),
                        pa.array(offset[anchor], pa.int64()),
                        pa.array(anchor - last, pa.int32()),
                        pa.array(anchor - first, pa.int32()),
                        pa.array(core.view(np.int64)),
                        pa.array(content.view(np.int64)),
                    ],
                    ["row", "at", "least", "most", "core", "content"],
                )

    return docs.select("row", "body").mapInArrow(work, "row long, at long, least int, most int, core long, content long")


STRING = "core long, content long, n long, least int, most int, left binary, right binary"


def cut_strings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """For each wanted anchor the bytes its windows need before it (``left``) and from it on (``right``)."""
    places = wanted.groupBy("row").agg(F.collect_list(F.struct("at", "least", "most", "core", "content", "n")).alias("places"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for body, found in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                text = body.as_py()
                for p in found.as_py():
                    at, least, most = p["at"], p["least"], p["most"]
                    out.append((p["core"], p["content"], p["n"], least, most, text[at - most : at], text[at : at + length - least]))
            columns = zip(*out, strict=True) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["core", "content", "n", "least", "most", "left", "right"])

    return docs.select("row", "body").dropDuplicates(["row"]).join(places, "row").select("body", "places").mapInArrow(work, STRING)


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(a), len(b))
    step = 32
    while known < end:
        x, y = a[known : min(known + step, end)], b[known : min(known + step, end)]
        if x != y:
            differing = int.from_bytes(x) ^ int.from_bytes(y)
            return known + (8 * len(x) - differing.bit_length()) // 8
        known += len(x)
        step *= 2
    return end


RUN = "bucket int, shared array<int>, sizes array<int>, rest binary, left_sizes array<int>, left binary, core array<long>, content array<long>, least array<int>, most array<int>"


def sorted_runs(strings: DataFrame, buckets: int) -> DataFrame:
    """Front-coded sorted runs of suffixes, a row for each run and bucket of cores."""

    def front_coded(bucket: int, rows: list[tuple]) -> tuple:
        rows.sort(key=lambda r: r[5])
        common = [0, *(shared(a[5], b[5]) for a, b in zip(rows, rows[1:], strict=False))]
        rest = [r[5][c:] for r, c in zip(rows, common, strict=True)]
        return (bucket, common, [len(r) for r in rest], b"".join(rest), [len(r[4]) for r in rows], b"".join(r[4] for r in rows), *([r[i] for r in rows] for i in range(4)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0

        def hand_on() -> pa.RecordBatch:
            columns = zip(*(front_coded(b, rows) for b, rows in held.items()), strict=True)
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            kinds = (pa.int32(), ints, ints, pa.binary(), ints, pa.binary(), longs, longs, ints, ints)
            names = [part.split(" ")[0] for part in RUN.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            core, content, _, least, most, left, right = (c.to_pylist() for c in batch.columns)
            for row in zip(core, content, least, most, left, right, strict=True):
                held.setdefault(row[0] % buckets, []).append(row)
                size += len(row[4]) + len(row[5])
                if size > RUN_BYTES:
                    yield hand_on()
                    held, size = {}, 0
        if held:
            yield hand_on()

    return strings.select("core", "content", "n", "least", "most", "left", "right").mapInArrow(work, RUN)


class Run:
    """Suffixes of a front-coded run, decoded one by one."""

    def __init__(self, row: dict):
        self.row, self.number, self.at, self.left_at, self.text = row, -1, 0, 0, b""
        self.common = 0

    def advance(self) -> bool:
        """Go to the next suffix; ``common`` is what it shares with the one before."""
        row, left_size = self.row, self.row["left_sizes"][self.number] if self.number >= 0 else 0
        self.left_at += left_size
        self.number += 1
        if self.number == len(row["shared"]):
            return False
        self.common, size = row["shared"][self.number], row["sizes"][self.number]
        self.text = self.text[: self.common] + row["rest"][self.at : self.at + size]
        self.at += size
        return True

    def entry(self) -> tuple:
        row, i = self.row, self.number
        return row["core"][i], row["content"][i], row["least"][i], row["most"][i], row["left"][self.left_at : self.left_at + row["left_sizes"][i]], self.text


def merge(runs: list[Run]) -> Iterator[tuple[int, tuple]]:
    """All suffixes in order, each with the length it shares with the one before.

    ``known[r]`` is what the waiting suffix of run r shares with the last winner it was compared
    against, which is the last suffix put out as far as the comparisons to come are concerned.
    """
    size = 1
    while size < len(runs):
        size *= 2
    alive = [i < len(runs) and runs[i].advance() for i in range(size)]
    known = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; a finished run loses against everything."""
        if not (alive[a] and alive[b]):
            return (a, b) if alive[a] else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a].text, runs[b].text
        common = shared(x, y, known[a])
        winner, loser = (a, b) if x[common : common + 1] <= y[common : common + 1] else (b, a)
        known[loser] = common
        return winner, loser

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if size > 1 else 0
    while alive[top]:
        yield known[top], runs[top].entry()
        alive[top] = runs[top].advance()
        known[top] = runs[top].common
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated(block: list[tuple], common: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each suffix of one core, in order, the offsets (first, last) of its windows that repeat in another.

    ``common[i]`` is what suffix i shares with suffix i - 1.
    """
    count = len(block)
    if count <= PAIRS:
        out: list[list[tuple[int, int]]] = [[] for _ in block]
        for i in range(count):
            right = length
            for j in range(i + 1, count):
                right = min(right, common[j])
                a, b = block[i], block[j]
                low = max(length - right, a[2], b[2])
                high = min(a[3], b[3])
                if low <= high:
                    high = min(high, shared(a[4][::-1], b[4][::-1]))
                    if low <= high:
                        out[i].append((low, high))
                        out[j].append((low, high))
        return out
    reverse = [b[4][::-1] for b in block]
    order = sorted(range(count), key=reverse.__getitem__)
    left = np.array([0, *(shared(reverse[i], reverse[j]) for i, j in zip(order, order[1:], strict=False))])
    right = np.array(common)
    least, most = np.array([b[2] for b in block]), np.array([b[3] for b in block])
    span = range(int(least.min()), int(most.max()) + 1)
    hit = np.zeros((len(span), count), bool)
    for k, offset in enumerate(span):
        by_right = np.cumsum(right < length - offset)
        by_left = np.empty(count, np.int64)
        by_left[order] = np.cumsum(left < offset)
        active = (least <= offset) & (offset <= most)
        _, place, n = np.unique((by_right * (count + 1) + by_left)[active], return_inverse=True, return_counts=True)
        hit[k, active] = n[place] > 1
    out = []
    for i in range(count):
        edge = np.diff(np.concatenate([[0], hit[:, i].astype(np.int8), [0]]))
        out.append([(span[a], span[b - 1]) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
    return out


MARKS = "core long, content long, marks array<struct<low:int,high:int>>"


def merged(runs: DataFrame, length: int, reach: int) -> DataFrame:
    """``core``, ``content`` and ``marks`` (offsets of repeated windows) of suffixes that have some."""
    core_size = length - reach + 1

    def work(table: pa.Table) -> pa.Table:
        found: list[tuple] = []
        block: list[tuple] = []
        common: list[int] = []

        def close() -> None:
            if len(block) > 1:
                found.extend((b[0], b[1], [{"low": a, "high": z} for a, z in m]) for b, m in zip(block, repeated(block, common, length), strict=True) if m)

        for known, entry in merge([Run(row) for row in table.to_pylist()]):
            if known < core_size and block:
                close()
                block, common = [], []
            block.append(entry)
            common.append(known)
        close()
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind)], names=["core", "content", "marks"])

    return runs.groupBy("bucket").applyInArrow(work, MARKS)


def digest(text: memoryview) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of whole numbers under a schema of int and long columns."""
    names, kinds = zip(*(column.split(" ") for column in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == "int" else pa.int64()) for x, k in zip(columns, kinds, strict=True)], list(names))


SHARES = "core long, content long, n long, step int, low int, high int, inner long, whole long"
WINDOWS = "core long, step int, inner long, whole long, n long, offset int, window long"


def counted(strings: DataFrame, length: int, stride: int) -> DataFrame:
    """The same for crowded cores, by counting hashes, in two steps so that few windows are looked at one by one.

    The offsets of a suffix's windows are cut at multiples of ``stride``. All windows of a share hold
    the same ``inner`` bytes, and ``whole`` names all their bytes. An inner that occurs once
    repeats nowhere, a whole that occurs twice repeats throughout; only for the other shares,
    about one for each end of a repeat, every window is counted.
    """

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for core, content, n, least, most, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # The bytes of the window at offset o begin at most - o.
                view, end = memoryview(left + right), len(left) + len(right)
                for step in range(least // stride, most // stride + 1):
                    first, last = step * stride, step * stride + stride - 1
                    low, high = max(least, first), min(most, last)
                    inner = view[max(0, most - first) : min(end, most - last + length)]
                    rows.append((core, content, n, step, low, high, digest(inner), digest(view[most - high : most - low + length]) ^ low << 16 ^ high))
            yield table_of(rows, SHARES)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for core, step, inner, whole, n, low, high, most, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view = memoryview(left + right)
                rows += [(core, step, inner, whole, n, o, digest(view[most - o : most - o + length])) for o in range(low, high + 1)]
            yield table_of(rows, WINDOWS)

    share, kind = ["core", "step", "inner"], ["core", "step", "inner", "whole"]
    parts = settle(strings.select("core", "content", "n", "least", "most", "left", "right").mapInArrow(shares, SHARES), "shares")
    kinds = settle(parts.groupBy(*kind, "low", "high").agg(F.sum("n").alias("n"), F.min("content").alias("content")), "kinds")
    again = settle(kinds.groupBy(share).agg(F.count("*").alias("kinds"), F.sum("n").alias("times")).where("times > 1").select(*share, "kinds"), "again")
    open_kinds = settle(kinds.join(again, share), "open")
    looked_at = open_kinds.where("kinds > 1").join(strings.select("core", "content", "most", "left", "right"), ["core", "content"])
    each = settle(looked_at.select(*kind, "n", "low", "high", "most", "left", "right").mapInArrow(windows, WINDOWS), "windows")
    repeats = settle(each.groupBy("core", "window").agg(F.sum("n").alias("times")).where("times > 1").select("core", "window"), "repeats")
    single = each.where("n = 1").join(repeats, ["core", "window"])
    marks = single.groupBy(kind).agg(F.collect_list(F.struct(F.col("offset").alias("low"), F.col("offset").alias("high"))).alias("marks"))
    throughout = open_kinds.where("n > 1").select(*kind, F.array(F.struct("low", "high")).alias("marks"))
    found = settle(marks.unionByName(throughout), "found")
    return parts.select("content", *kind).join(found, kind).groupBy("core", "content").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def repeated_windows(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """``row`` and ``windows`` (first and last start of runs of repeated windows) of texts that have some."""
    found = settle(found_anchors(docs, length, reach), "anchors")
    contents = settle(found.groupBy("core", "content").agg(F.count("*").alias("n")), "contents")
    cores = settle(contents.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("times")).where("times > 1").select("core", "kinds"), "cores")
    live = settle(contents.join(cores, "core"), "live")
    members = settle(found.join(live, ["core", "content"]), "members")
    wanted = members.where("kinds > 1").dropDuplicates(["core", "content"])
    strings = settle(cut_strings(docs, wanted, length).join(cores, "core"), "strings")
    few = strings.where(f"kinds <= {BLOCK}")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-strings.count() // MERGED))
    by_merge = merged(sorted_runs(few, buckets), length, reach)
    by_count = counted(strings.where(f"kinds > {BLOCK}"), length, STEP)
    whole = live.where("n > 1").join(members.select("core", "content", "least", "most").dropDuplicates(["core", "content"]), ["core", "content"])
    marks = whole.select("core", "content", F.array(F.struct(F.col("least").alias("low"), F.col("most").alias("high"))).alias("marks"))
    marks = settle(marks.unionByName(by_merge).unionByName(by_count), "marks")
    at = F.col("at")
    windows = F.transform("marks", lambda m: F.struct((at - m["high"]).alias("first"), (at - m["low"]).alias("last")))
    return settle(members.select("row", "at", "core", "content").join(marks, ["core", "content"]).groupBy("row").agg(F.flatten(F.collect_list(windows)).alias("windows")), "repeats")


def spans_of(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs (begin, end) of windows given by runs of starts."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(np.flatnonzero(new)[1:], len(begin)) - 1]


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` (removed runs of bytes, begin and end) and ``kept`` (remaining bytes) of every row."""
    rows = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias(key), F.coalesce(text, F.lit("")).alias("body"))
    repeats = repeated_windows(rows, length, reach)
    schema = docs.select(key).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ", 1)
    schema += ", n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for body, windows in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                data = body.as_py()
                sizes.append(len(data))
                if not windows.is_valid:
                    spans.append([])
                    kept.append(data)
                    continue
                runs = windows.values
                begin, end = (x.tolist() for x in spans_of(runs.field("first").to_numpy(), runs.field("last").to_numpy(), length))
                spans.append([{"begin": a, "end": b} for a, b in zip(begin, end, strict=True)])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *end], [*begin, len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"])

    return rows.join(repeats, "row", "left").select(key, "body", "windows").mapInArrow(work, schema)
