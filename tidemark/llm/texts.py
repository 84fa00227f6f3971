"""Helpers shared by the text operators: bounded slices of a batch and byte-level alphabets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

#: Characters of text one numpy pass works on; a longer text forms a slice of its own.
SLICE_CHARS = 1_000_000


def slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Consecutive slices of ``texts`` holding at most ``limit`` characters (one text at least)."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > limit:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def whole(column) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes, in order,
    for the characters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
