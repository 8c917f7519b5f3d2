"""Ids of byte-level BPE vocabularies, read from a tokenizers file, by the faster of two installed libraries.

Where the file is a plain byte-level BPE (no normaliser, the usual word pattern, merges in order of their ids), tiktoken gives the very
ids that tokenizers gives, at about four times the speed; the vocabulary is handed to it as ranks. Special strings in a text are split
off first, as the tokenizers library does by default. Any other file goes to the tokenizers library itself, piece by distinct piece.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

from . import pieces

#: The word pattern of byte-level pre-tokenization, with possessive runs (fixed value).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(file: dict) -> dict[bytes, int] | None:
    """Ranks if the file is one that both libraries read alike, else None."""
    model, words = file["model"], file.get("pre_tokenizer") or {}
    plain = (
        file.get("normalizer") is None
        and words.get("type") == "ByteLevel"
        and not words.get("add_prefix_space")
        and words.get("use_regex")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in file.get("added_tokens", []))
    )
    if not plain:
        return None
    own, added = byte_of_char(), {a["content"] for a in file.get("added_tokens", [])}
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(ids, ids[1:])):
        return None
    return {bytes(own[c] for c in token): i for token, i in model["vocab"].items() if token not in added}


_ENCODERS: dict[str, Callable[[list[str]], list[bytes]]] = {}


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """This worker's encoder of a vocabulary file: texts to their ids as little-endian unsigned 32-bit numbers."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ranks = _ranks(file)
        _ENCODERS[path] = _by_pieces(path) if ranks is None else _by_ranks(ranks, file.get("added_tokens", []))
    return _ENCODERS[path]


def _by_pieces(path: str) -> Callable[[list[str]], list[bytes]]:
    cache = pieces.cache_for(path, "ids")

    def encode(texts: list[str]) -> list[bytes]:
        cut = [pieces.with_leading_space(text) for text in texts]
        cache.fill(piece for parts in cut for piece in parts)
        return [b"".join(map(cache.__getitem__, parts)) for parts in cut]

    return encode


def _by_ranks(ranks: dict[bytes, int], added: list[dict]) -> Callable[[list[str]], list[bytes]]:
    import tiktoken

    ordinary = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    special = {a["content"]: array("I", [a["id"]]).tobytes() for a in added}
    parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def encode(texts: list[str]) -> list[bytes]:
        found = []
        for text in texts:
            if parts is not None and any(s in text for s in special):
                found.append(b"".join(special[p] if p in special else array("I", ordinary(p)).tobytes() for p in parts.split(text) if p))
            else:
                found.append(array("I", ordinary(text)).tobytes())
        return found

    return encode
