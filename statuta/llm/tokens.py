"""Tokens of a public byte-level vocabulary inside tasks.

The ids are those of the `tokenizers` file of the vocabulary, its special string included; they are
computed from the same vocabulary's ranks with tiktoken, which is several times faster, and tests
hold both together. Nothing is remembered between texts.
"""

from __future__ import annotations

import base64
import functools

import numpy as np

#: Vocabulary file (its stem; `.json` and `.tiktoken` hold the same vocabulary).
VOCABULARY = "byte_bpe_50k"
#: Special string of the vocabulary and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


@functools.cache
def encoding(vocabulary: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


@functools.cache
def byte_lengths(vocabulary: str = VOCABULARY) -> np.ndarray:
    """Bytes of the text that each id stands for."""
    e = encoding(vocabulary)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(SPECIAL_ID + 1)], np.int64)


def encode_document(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit numbers; a special string in it is one id."""
    return encoding(vocabulary).encode_to_numpy(text, allowed_special="all")
