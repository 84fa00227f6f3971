"""Token counts by compiled finite-state transducers.

Two deterministic transducers run one after the other. The word cutter has eight states and
reads characters whose class says what the pattern needs to know of the next two; its
transitions tell where a word begins. The text is cut into chunks of equal length, every chunk
is run from all eight states at once, the resulting state maps compose by a parallel prefix
scan, and each chunk is run again from the state it really starts in.

The merge transducer reads the bytes of a word. A state holds, for each suffix that can still
grow into a token, its place in the token trie, the token before it and the count there; a
transition is annotated with the change of the token count. States and transitions are
compiled when first reached and then only looked up; a word is read once per worker.

Nulls count as empty texts: no bytes, no tokens. Repeated rows give repeated results, texts are
whole whatever their length, other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vocabulary
from tidemark.llm.texts import slices, whole

LETTER, NUMBER, OTHER, SHORT, LONG, LAST_SPACE, LAST_BLANK, BLANK, BORDER = range(9)
OPEN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)
#: Characters per chunk of the prefix scan.
CHUNK = 256
#: Stands before every text and between a special string and its neighbours; no valid text holds it.
SEPARATOR = "\ud800"
#: States of the merge transducer kept compiled, and words a worker keeps counted; past either it starts afresh.
KEPT_STATES, KEPT_WORDS = 120_000, 300_000


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 blank, for every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (3, r"\s+")):
        for found in regex.finditer(pattern, everything):
            kinds[found.start() : found.end()] = kind
    return kinds


@lru_cache(maxsize=1)
def cutter() -> tuple[np.ndarray, np.ndarray]:
    """``next[symbol, state]`` and ``begins[symbol, state]``: whether a word begins at the symbol."""
    to, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    joins = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for symbol, state in joins.items():
        to[symbol], begins[symbol, [state, AFTER_SPACE]] = state, False
    for symbol, state in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        to[symbol] = state
        to[symbol, [IN_OTHERS, AFTER_SPACE]], begins[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS, False
    to[LAST_SPACE], to[LAST_BLANK], to[BLANK], to[BORDER] = AFTER_SPACE, OPEN, IN_BLANKS, OPEN
    begins[BLANK, IN_BLANKS] = False
    # What is left of 's, 're and the like belongs to it, whatever it is.
    to[:BORDER, ONE_LEFT], to[:BORDER, TWO_LEFT], begins[:BORDER, [ONE_LEFT, TWO_LEFT]] = OPEN, ONE_LEFT, False
    return to, begins


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """Cutter symbols: character classes that include what comes next."""
    border = codes == ord(SEPARATOR)
    kind = character_kinds()[codes]
    blank = kind == 3
    ahead = np.append(~(blank | border)[1:], False)
    symbols = np.where(blank, np.where(ahead, np.where(codes == 32, LAST_SPACE, LAST_BLANK), BLANK), kind).astype(np.uint8)
    symbols[border] = BORDER
    quote = np.flatnonzero(codes == ord("'"))
    one, two = (np.append(codes, [0, 0])[quote + k] for k in (1, 2))
    symbols[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
    symbols[quote[np.logical_or.reduce(pairs)]] = LONG
    return symbols


def word_starts(symbols: np.ndarray) -> np.ndarray:
    """Positions at which the cutter begins a word, by a prefix scan over the chunks' state maps."""
    to, begins = cutter()
    chunks = max(1, -(-len(symbols) // CHUNK))
    padded = np.full(chunks * CHUNK, BORDER, np.uint8)
    padded[: len(symbols)] = symbols
    columns = padded.reshape(chunks, CHUNK).T.astype(np.intp) * 8
    flat_to, flat_begins = to.ravel(), begins.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = flat_to[column[:, None] + maps]
    reach = 1
    while reach < chunks:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    state = np.append(OPEN, maps[:-1, OPEN]).astype(np.uint8)
    out = np.empty((CHUNK, chunks), bool)
    for k, column in enumerate(columns):
        at = column + state
        out[k], state = flat_begins[at], flat_to[at]
    return np.flatnonzero(out.T.ravel()[: len(symbols)])


class MergeTransducer:
    """Deterministic transducer over the bytes of a word, compiled as far as it is reached."""

    def __init__(self, path: str):
        vocab = vocabulary.load(path)
        self.pair_rank = {(a, b): r for r, (a, b, _) in enumerate(vocab.merges.tolist())}
        self.made_of = {c: (a, b, r) for r, (a, b, c) in enumerate(vocab.merges.tolist())}
        if len(self.made_of) < len(vocab.merges):
            raise ValueError(f"{path}: two merges make the same token")
        self.trie: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.grows: set[int] = set()
        specials, nodes = set(vocab.special.values()), 1
        for token, data in enumerate(vocab.token_bytes):
            if token in specials or not data:
                continue
            node = 0
            for byte in data:
                self.grows.add(node)
                step = node << 8 | byte
                node = self.trie.setdefault(step, nodes)
                nodes += node == nodes
            self.token_at[node] = token
        self.fits_known: dict[tuple[int, int], bool] = {}
        self.reached: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[int, tuple[int, int]] = {}
        self.intern(((0, -1, 0),))

    def intern(self, state: tuple) -> int:
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Parts along the right (side 1) or left edge of a token, with the rank at which each is merged away."""
        if (token, side) not in self.spines:
            out, part, until = [], token, float("inf")
            while True:
                out.append((part, until))
                if part not in self.made_of:
                    break
                until = self.made_of[part][2]
                part = self.made_of[part][side]
            self.spines[token, side] = out
        return self.spines[token, side]

    def crossed(self, left: int, right: int, before: float) -> bool:
        """Whether a merge of rank below ``before`` joins an end part of ``left`` with a first part of ``right``."""
        for x, x_until in self.spine(left, 1):
            for y, y_until in self.spine(right, 0):
                rank = self.pair_rank.get((x, y))
                if rank is not None and rank < before and rank < x_until and rank <= y_until:
                    return True
        return False

    def stands(self, token: int) -> bool:
        """Whether the merges turn the token's own bytes into it."""
        if token not in self.reached:
            parts = self.made_of.get(token)
            self.reached[token] = parts is None or (self.stands(parts[0]) and self.stands(parts[1]) and not self.crossed(parts[0], parts[1], parts[2]))
        return self.reached[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        if left < 0:
            return True
        key = (left, right)
        if key not in self.fits_known:
            if len(self.fits_known) > 1_000_000:
                self.fits_known.clear()
            self.fits_known[key] = not self.crossed(left, right, float("inf"))
        return self.fits_known[key]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Number of the state after ``byte``, and by how much the count changes."""
        grown, last, gain = [], None, 0
        for node, before, count in self.states[state]:
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            if child in self.grows:
                grown.append((child, before, count))
            if last is None:
                token = self.token_at.get(child)
                if token is not None and self.stands(token) and self.fits(before, token):
                    last, gain = token, count + 1
        # Exactly one token can end an encoding here; counts in the new state are relative to it.
        step = self.intern((*((n, t, c - gain) for n, t, c in grown), (0, last, 0))), gain
        self.steps[state << 8 | byte] = step
        return step

    def count(self, word: bytes) -> int:
        """Tokens of one word (not empty)."""
        total, at, steps = 0, 0, self.steps
        for byte in word:
            step = steps.get(at << 8 | byte)
            if step is None:
                if len(self.states) > KEPT_STATES:
                    now = self.states[at]
                    self.reset()
                    at, steps = self.intern(now), self.steps
                step = self.compile(at, byte)
            at, gain = step
            total += gain
        return total


class Counter:
    """Token counts of whole texts under one vocabulary file."""

    def __init__(self, path: str):
        self.special = vocabulary.load(path).special_pattern()
        self.merges = MergeTransducer(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            counts[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        joined = SEPARATOR + SEPARATOR.join(pieces)
        symbols = symbols_of(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
        begins = word_starts(symbols)
        border = symbols[begins] == BORDER
        piece = np.cumsum(border) - 1
        ends = np.append(begins[1:], len(joined))
        words = [joined[a:b] for a, b in zip(begins[~border].tolist(), ends[~border].tolist(), strict=True)]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        new = list(set(words).difference(self.known))
        if new:
            self.known.update((w, self.merges.count(w.encode())) for w in new)
        of_word = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        text = np.array(owner, np.int64)[piece[~border]]
        return counts + np.bincount(text, of_word, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""
    schema = docs.select(key).schema.add("n_bytes", "long").add("n_tokens", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        count, out = counter(path), to_arrow_schema(schema)
        for batch in batches:
            texts = whole(batch.column(1))
            tokens = [count.count(texts[part]) for part in slices(texts)]
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), n_bytes, pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)]))], schema=out)

    return docs.select(key, F.col(text)).mapInArrow(work, schema).withColumn("over_limit", F.col("n_tokens") > limit)
