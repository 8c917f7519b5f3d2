"""Pages to parent chunks to children. Sizes are prefix sums; cuts are nearest boundaries in them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .. import shipping
from ..functions import udfs

PARENT_WORDS, CARRY = 512, 1


def packed(sizes: list[int], limit: int = PARENT_WORDS, carry: int = CARRY) -> list[list[int]]:
    """Greedy groups of consecutive items. A full group passes its last ``carry`` items on, unless they leave no room for the next."""
    groups: list[list[int]] = []
    group: list[int] = []
    load = 0
    for i, size in enumerate(sizes):
        if group and load + size > limit:
            groups.append(group)
            group = group[-carry:] if carry else []
            load = sum(sizes[k] for k in group)
            if load + size > limit:
                group, load = [], 0
        group.append(i)
        load += size
    return [*groups, group] if group else groups


def _nearest(marks: np.ndarray, low: int, high: int, goal: float) -> int:
    """The first position in [low, high] whose prefix sum is nearest to the goal."""
    return low + int(np.abs(marks[low : high + 1] - goal).argmin())


def cut(sizes: list[int], parts: int, overlap: int = 0) -> list[tuple[int, int]]:
    """``parts`` forward ranges of near-equal sums; with an overlap each starts about that much before the last one's end."""
    n = len(sizes)
    if parts <= 1:
        return [(0, n)]
    marks = np.concatenate([[0], np.cumsum(sizes)]).astype(float)
    length = (marks[-1] + (parts - 1) * overlap) / parts
    stride, ranges, start = length - overlap, [], 0
    for k in range(parts - 1):
        goal = k * stride + length if overlap else marks[-1] * (k + 1) / parts
        end = _nearest(marks, start + 1, n - (parts - 1 - k), goal)
        ranges.append((start, end))
        start = _nearest(marks, start + 1, end, (k + 1) * stride) if overlap else end
    return [*ranges, (start, n)]


def child_ranges(sizes: list[int], words: int, overlap: int = 0) -> list[tuple[int, int]]:
    """The fewest children of at most ``words`` words; one sentence alone may be longer."""
    total = sum(sizes)
    parts = math.ceil((total - overlap) / (words - overlap)) if overlap and total > words else math.ceil(total / words)
    for parts in range(max(1, min(len(sizes), parts)), len(sizes) + 1):
        ranges = cut(sizes, parts, overlap)
        if not any(b - a > 1 and sum(sizes[a:b]) > words for a, b in ranges):
            break
    return ranges


def parents(pages: DataFrame, limit: int = PARENT_WORDS, carry: int = CARRY) -> DataFrame:
    """Chunks (chunk_id, doc_id, page_no, chunk_index, text) of pages (doc_id, page_no, text, lang); none crosses a page. No shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, page, text, lang in frame[["doc_id", "page_no", "text", "lang"]].itertuples(index=False):
                parts = udfs.sentences(text, lang)
                groups = packed([udfs.words_in(s, lang) for s in parts], limit, carry)
                for i, group in enumerate(groups):
                    rows.append((f"{doc}:p{page}:c{i}", doc, page, i, ("" if lang == "zh" else " ").join(parts[k] for k in group)))
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "page_no", "chunk_index", "text"])

    shipping.arrow(pages.sparkSession)
    return pages.select("doc_id", "page_no", "text", "lang").mapInPandas(shipping.lean(run), "chunk_id string, doc_id string, page_no int, chunk_index int, text string")


def children(chunks: DataFrame, words: int = 150, overlap: int = 0) -> DataFrame:
    """Children of chunks (chunk_id, doc_id, page_no, text, lang); joined in order they give the parent's text when nothing overlaps."""
    unit = f"{words}o{overlap}" if overlap else str(words)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for chunk, doc, page, text, lang in frame[["chunk_id", "doc_id", "page_no", "text", "lang"]].itertuples(index=False):
                parts = udfs.sentences(text, lang) or [text]
                for i, (a, b) in enumerate(child_ranges([udfs.words_in(s, lang) for s in parts], words, overlap)):
                    rows.append((f"{chunk}:w{unit}:k{i}", chunk, doc, page, i, ("" if lang == "zh" else " ").join(parts[a:b]), words, overlap))
            yield pd.DataFrame(rows, columns=["child_id", "parent_id", "doc_id", "page_no", "child_index", "text", "child_words", "child_overlap"])

    shipping.arrow(chunks.sparkSession)
    schema = "child_id string, parent_id string, doc_id string, page_no int, child_index int, text string, child_words int, child_overlap int"
    return chunks.select("chunk_id", "doc_id", "page_no", "text", "lang").mapInPandas(shipping.lean(run), schema)
