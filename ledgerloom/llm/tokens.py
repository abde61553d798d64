"""Token ids as the public byte-level vocabulary gives them."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

import numpy as np

# Where both libraries are known to agree on letters, digits and space (a test compares them).
_SIMPLE = re.compile("[\x00-ɏ]*")


def default_paths() -> tuple[str, str]:
    """The vocabulary as a tokenizer file, and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(tokenizer: str, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, without special tokens added.

    ``ranks`` names the same vocabulary for a faster library of equal results; it is used for texts
    of Latin letters that do not spell a special token, all others go to the tokenizer itself.
    """
    loaded: dict[str, object] = {}

    def exact(text: str) -> list[int]:
        if "exact" not in loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            loaded["exact"] = Tokenizer.from_file(tokenizer)
        return loaded["exact"].encode(text, add_special_tokens=False).ids

    def fast(text: str) -> list[int]:
        if "fast" not in loaded:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            loaded["fast"] = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )
        return loaded["fast"].encode_ordinary(text)

    def encode(text: str) -> np.ndarray:
        simple = ranks and "<|" not in text and _SIMPLE.fullmatch(text)
        return np.array(fast(text) if simple else exact(text), dtype="<u4")

    return encode
