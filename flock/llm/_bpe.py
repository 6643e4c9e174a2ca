"""Byte-level BPE of a public vocabulary file; the path is a parameter."""

from __future__ import annotations

import base64
import functools
import json
import re
from pathlib import Path


def default_ranks() -> str:
    """Ranks of the vocabulary that byte_bpe_50k.json also holds (equal ids, faster to encode)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_RUN = re.compile(r"\s\s")
_AHEAD = r"|\s+(?!\S)"


def special_tokens() -> dict[str, int]:
    """Tokens that byte_bpe_50k.json adds to the vocabulary."""
    import public_tokenizers
    added = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"))["added_tokens"]
    return {t["content"]: t["id"] for t in added}


@functools.lru_cache(maxsize=2)
def encoder(path: str, special: bool = False):
    """text -> ids.  Strings of special tokens are ordinary text or, with ``special``,
    the tokens' ids, as the tokenizers library takes them by default.

    The pattern's look-ahead only matters in runs of two or more white space
    characters; texts without such a run go through the same pattern without it,
    which matches alike and faster.
    """
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    full = tiktoken.Encoding("full", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN.replace(_AHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    added = special_tokens() if special else {}
    apart = tiktoken.Encoding("apart", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return apart.encode(text, allowed_special="all")
        return (full if _RUN.search(text) else plain).encode_ordinary(text)
    return encode
