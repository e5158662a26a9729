"""Ids of a byte-level BPE tokenizers file, with a memory of the parts between blanks."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .common import Recent

#: White space other than blank, tab and line ends.
RARE_SPACE = re.compile("[\\x0b\\x0c\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Parts held at a time, half of them those in use of late.
MEMORY = 120_000


def byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies use for each byte: visible Latin-1 signs stand for themselves, the rest for 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def one_blank_apart(text: str) -> bool:
    """Whether cutting the text before each blank cuts no run of white space: then no pre-token spans a cut."""
    return not ("  " in text or "\n " in text or "\t " in text or "\r " in text or text[:1] == " " or text[-1:] == " " or RARE_SPACE.search(text))


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[str, ...]:
    """What the file's added tokens stand for: the library takes them for tokens wherever a text holds them."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens") or [] if t["content"])


@lru_cache(maxsize=2)
def _encode_whole(path: str):
    """text -> list of ids, for texts without added tokens. Where the merges stand in the order of their ids, as in the public files, ranks say the same
    as merges and tiktoken's core does the work; otherwise the tokenizers library itself."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, signs = model["vocab"], byte_signs()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    if made and min(made) >= 256 and all(x < y for x, y in zip(made, made[1:], strict=False)) and not model.get("ignore_merges"):
        import public_tokenizers
        import tiktoken

        whole = {*made, *(vocab[s] for s in signs if s in vocab)}
        ranks = {bytes(signs[c] for c in t): i for t, i in vocab.items() if i in whole}
        if len(ranks) == len(made) + 256:
            return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: library(path).encode(text, add_special_tokens=False).ids


def unit_encoder(path: str):
    """text -> ids as little-endian 32-bit bytes, equal to encoding the whole text at once with the library's own settings.

    Parts that this encoder has met lately are looked up (about 2 x MEMORY at most; make one a task). A text that holds
    the content of one of the file's added tokens goes to the library as it is.
    """
    whole, added = _encode_whole(path), added_tokens(path)
    memory = Recent(MEMORY)
    pack = lambda s: np.array(whole(s), dtype="<u4").tobytes()

    def encode(text: str) -> bytes:
        if any(t in text for t in added):
            return np.array(library(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not one_blank_apart(text):
            return pack(text)
        parts = text.split(" ")
        parts[0] = head = "\x00 " + parts[0]
        try:
            held = memory.now
            return b"".join([held[u] for u in parts])
        except KeyError:
            new = memory.unknown(dict.fromkeys(parts))
            held = memory.now
            held.update([(u, pack(u[2:] if u is head else " " + u)) for u in new])
            return b"".join([held[u] for u in parts])

    return encode
