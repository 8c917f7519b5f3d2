"""Cutting texts where a tokenizer's result can't depend on the other side, and encoding each distinct piece once.

Both vocabularies split a text into words before any merge, and no word reaches across the start of a white-space run
that follows other characters. Pieces are therefore cut there: the ids of a text are those of its pieces in order.
Only texts without any white space stay whole. Distinct pieces are encoded in batches of bounded bytes by the
library itself; repeated ones come from a bounded cache, so a worker's memory doesn't grow with its input.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of distinct pieces given to the library in one batch.
BATCH_BYTES = 1 << 20
#: Bytes of pieces and entries that one cache may hold before it starts anew.
CACHE_BYTES = 16 << 20
CACHE_ENTRIES = 120_000

#: Unicode White_Space, as the tokenizers' own patterns take it (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
_LEADING = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def with_leading_space(text: str) -> list[str]:
    """Pieces that each start with the white space before them; their concatenation is the text."""
    return _LEADING.findall(text)


def without_space(text: str) -> list[str]:
    """Pieces between runs of ASCII white space, for vocabularies that drop white space."""
    return [piece.decode("utf-8", "surrogatepass") for piece in text.encode("utf-8", "surrogatepass").split()]


class PieceCache(dict):
    """Piece to what ``measure`` makes of its ids. ``fill`` first; then plain look-ups serve the batch."""

    def __init__(self, path: str, measure: Callable[[list[int]], object]):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.measure, self.held = measure, 0

    def fill(self, pieces: Iterable[str]) -> None:
        """Encode what the cache lacks, in batches balanced by bytes."""
        if self.held > CACHE_BYTES or len(self) > CACHE_ENTRIES:
            self.clear()
            self.held = 0
        batch, size = [], 0
        for piece in {p for p in pieces if p not in self}:
            batch.append(piece)
            size += len(piece)
            if size >= BATCH_BYTES:
                self._encode(batch)
                batch, size = [], 0
        if batch:
            self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        for piece, found in zip(batch, self.encoder.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            self[piece] = self.measure(found.ids)
            self.held += len(piece) + 4 * len(found.ids)


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return np.asarray(ids, dtype="<u4").tobytes()


_CACHES: dict[tuple[str, str], PieceCache] = {}


def cache_for(path: str, kind: str) -> PieceCache:
    """This worker's cache for a vocabulary; ``kind`` is ``count`` or ``ids``."""
    if (path, kind) not in _CACHES:
        _CACHES[path, kind] = PieceCache(path, len if kind == "count" else id_bytes)
    return _CACHES[path, kind]


def text_slices(column: pa.Array, limit: int = 4 * BATCH_BYTES) -> Iterable[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about ``limit`` bytes of an Arrow column; null counts as empty. Only one run at a time is held as Python strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= limit or i + 1 == len(sizes):
            yield start, [text or "" for text in column.slice(start, i + 1 - start).to_pylist()]
            start, size = i + 1, 0
