"""Byte-level BPE vocabulary files: token bytes, ranked merges, special strings, word pattern."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

from tidemark.llm.texts import byte_alphabet

#: Fixed value: the pattern byte-level vocabularies split text by, before merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of ASCII characters only, where the class names have a short form.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


@dataclass(frozen=True)
class Vocabulary:
    """``merges[r] = (left, right, merged)`` ids in rank order; ``token_bytes[id]``."""

    token_bytes: list[bytes]
    byte_ids: np.ndarray
    merges: np.ndarray
    special: dict[str, int]

    def special_pattern(self):
        return regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library; kinds it cannot follow are refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"]
    plain = spec["normalizer"] is None and before == before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    tokens_plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    if model["type"] != "BPE" or not plain or not tokens_plain or model.get("ignore_merges"):
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    alphabet, ids = byte_alphabet(), model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        token_bytes[i] = bytes(alphabet[c] for c in token)
    for token, i in special.items():
        token_bytes[i] = token.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], dtype=np.int64)
    symbol = {b: c for c, b in alphabet.items()}
    byte_ids = np.array([ids[symbol[b]] for b in range(256)], dtype=np.int64)
    return Vocabulary(token_bytes, byte_ids, merges, special)
