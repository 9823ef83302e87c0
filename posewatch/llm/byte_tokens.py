"""Byte-level vocabularies: ids of texts and the bytes of each id.

The vocabulary comes from a tokenizers file. Its ids rise in merge order, so the same
table serves tiktoken as ranks, which gives the same ids several times faster. Very long
texts go to the tokenizers library itself: the other one's pattern search keeps a stack
that a white-space run of a million characters overflows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from posewatch.llm.bpe import byte_letters

LONG_TEXT = 100_000


class ByteTokens:
    """`specials`: whether the strings of special tokens in a text become their ids."""

    def __init__(self, path: str, specials: bool):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        named = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in named
        }
        self.bytes_of = [b""] * (max(*ranks.values(), *named.values()) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in named.items())]:
            self.bytes_of[i] = token
        self.fast = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=named if specials else {}
        )
        self.specials = specials
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not specials

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if len(text) > LONG_TEXT:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.specials:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def load(path: str, specials: bool) -> ByteTokens:
    return ByteTokens(path, specials)
