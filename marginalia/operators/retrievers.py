"""Retrievers by name, over any set of units, and the encoder plug that vector ones search with.

A name is a base, searched over chunks, or ``base@words`` or ``base@wordsOoverlap``, searched over that set of children. All rank pages: units are
searched ``DEPTH`` times as deep as asked, and each page stays once, at the place of its best unit.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shipping
from ..functions import text as tx
from . import retrieval

Encode = Callable[[DataFrame], DataFrame]
Search = Callable[[DataFrame, int], DataFrame]

# Names of retrievers, and how deep units are searched for pages.
WORD_BASED, VECTOR_BASED = ("tfidf_pipeline", "tfidf_raw", "bm25_raw"), ("bge_m3_dense", "hybrid_rrf", "hybrid_rrf+reranker")
SIZED = ("bm25_raw", "bge_m3_dense", "hybrid_rrf", "hybrid_rrf+reranker")
DEPTH = 3
#: Words of a text that an encoder sees.
ENCODED_WORDS = 512


class Corpus(NamedTuple):
    """One set of units: (scope, unit, text, page), their index tables, or None where a large batch is to stream the texts instead, and their vectors (unit, v)."""

    units: DataFrame
    tables: dict[str, DataFrame] | None
    vectors: DataFrame


def parsed(name: str) -> tuple[str, str | None] | None:
    """A retriever's base and set of children, None for chunks; None for an unknown name. An overlap of 0 is not named."""
    base, mark, size = name.partition("@")
    if not mark:
        return (base, None) if base in WORD_BASED + VECTOR_BASED else None
    found = re.fullmatch(r"([1-9]\d*)(?:o(\d+))?", size)
    if base not in SIZED or found is None:
        return None
    overlap = int(found[2] or 0)
    return base, found[1] + (f"o{overlap}" if overlap else "")


def _units(base: str, corpus: Corpus, encode: Encode, questions: DataFrame, k: int) -> DataFrame:
    def bm25(depth: int) -> DataFrame:
        if corpus.tables is None:
            return retrieval.bm25(corpus.units, questions, depth)
        return retrieval.top_k(retrieval.bm25_hits(corpus.tables["bm25"], questions, depth), depth)

    def dense(depth: int) -> DataFrame:
        return retrieval.dense(corpus.vectors, encode(questions), depth)

    if base == "tfidf_pipeline":
        return retrieval.tfidf_pipeline(corpus.units, questions, k).select("q", "unit", "score", "rank")
    if base == "tfidf_raw" and corpus.tables is None:
        return retrieval.tfidf(corpus.units, questions, k)
    if base == "tfidf_raw":
        return retrieval.top_k(retrieval.tfidf_hits(corpus.tables["tfidf"], corpus.tables["idf"], questions), k)
    if base == "bm25_raw":
        return bm25(k)
    if base == "bge_m3_dense":
        return dense(k)
    fused = retrieval.rrf(bm25(retrieval.CANDIDATES), dense(retrieval.CANDIDATES), retrieval.POOL if base.endswith("reranker") else k)
    return retrieval.reranked(fused, questions, corpus.units.select("unit", "text"), k) if base.endswith("reranker") else fused


def retriever_for(name: str, corpora: dict[str | None, Corpus], encode: Encode) -> Search | None:
    """``search(questions, k)`` of a name: (q, page, unit, score, rank) by page. None for an unknown name or a set that is not there.

    ``corpora`` has chunks under None and sets of children by name; ``encode`` gives (q, qv) of questions (q, scope, text).
    """
    found = parsed(name)
    if found is None or found[1] not in corpora:
        return None
    base, corpus = found[0], corpora[found[1]]

    def search(questions: DataFrame, k: int) -> DataFrame:
        hits = _units(base, corpus, encode, questions, k * DEPTH)
        return retrieval.deduped_pages(hits.join(corpus.units.select("unit", "page"), "unit"), k)

    return search


@cache
def loaded(load: Callable):
    """A model loaded once in a process: executors call this inside their Arrow functions."""
    return load()


def letters() -> Callable[[pd.Series], np.ndarray]:
    """The default encoder: counts of the 26 Latin letters. A stand-in that makes no quality claims."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    return lambda texts: np.array([[t.count(c) for c in alphabet] for t in texts.str.lower()], dtype=np.float64).reshape(-1, len(alphabet))


def encoded(text: Column, load: Callable = letters, words: int = ENCODED_WORDS, batch: int = 16) -> Column:
    """Unit vectors of texts, by the encoder that ``load()`` makes once in each worker; a zero vector stays zero, null counts as empty.

    Texts are cut after ``words`` words, before they reach Python. The encoder sees ``batch`` texts at a time.
    """
    shipping.arrow()

    def run(texts: pd.Series) -> pd.Series:
        encode = loaded(load)
        parts = [np.asarray(encode(texts.iloc[i : i + batch]), dtype=np.float64) for i in range(0, len(texts), batch)]
        made = np.concatenate(parts) if parts else np.zeros((0, 0))
        norms = np.linalg.norm(made, axis=1, keepdims=True)
        return pd.Series(list(made / np.where(norms > 0, norms, 1.0)), index=texts.index)

    head = F.regexp_extract(F.coalesce(text, F.lit("")), rf"^\s*(?:\S+\s+){{0,{words - 1}}}\S*", 0)
    return F.pandas_udf(run, "array<double>")(head)
