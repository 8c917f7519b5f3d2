"""Operator 10: repeated substrings by seed and extend.

Seeds: the winnowed minima of ``SEED``-word hashes over every window of ``WINDOW`` words. A window's seed depends on its words
alone, so two documents that share a window share its seed. Consecutive windows with one seed form a run, the context of an anchor. An anchor of
two or more documents is extended both ways by all the words of its context at once (one row for about a dozen windows). Where an anchor's
contexts differ, it is extended by each way to divide the missing ``WINDOW - SEED`` words between its left and its right: that is one window
for each division, equal for two documents just if they agree that far on both sides. All documents of an anchor are extended at once by grouped
minima, never pair by pair. Matched windows that overlap make up the maximal repeats, which are what is cut; a repeat shorter than a window has none.

Windows are compared by a 64-bit hash among those whose anchors, 25 words, have equal 64-bit hashes too; words themselves aren't compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, shared

WINDOW, SEED = 50, 25
_EMPTY = hashlib.sha256(b"").hexdigest()


def seeds(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The seed of each window: the least hash among its runs of ``seed`` words."""
    grams = hashing.gram_hashes(hashes, seed)
    span, width = window - seed + 1, 1
    while 2 * width <= span:  # minima over powers of two, then one overlap
        grams, width = np.minimum(grams[:-width], grams[width:]), 2 * width
    rest = span - width
    return np.minimum(grams[:-rest], grams[rest:]) if rest else grams


def _signed(digest: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(digest, dtype=np.int64).tolist())


def _winnow(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("n_words", "high", "low", "sha", "seeds")}
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = hashing.split_words(text, lower=False)
                joined = b" ".join(words)
                high, low = _signed(xxhash.xxh3_128_digest(joined))
                own = np.unique(seeds(hashing.word_hashes(words), window, seed)).view(np.int64) if len(words) >= window else None
                for name, value in (("n_words", len(words)), ("high", high), ("low", low), ("sha", hashlib.sha256(joined).hexdigest()), ("seeds", own)):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(out[n], pa.int64()) for n in ("n_words", "high", "low")), pa.array(out["sha"]), pa.array(out["seeds"], pa.list_(pa.int64()))],
                names=["id", "h", "n_words", "high", "low", "sha", "seeds"],
            )

    return run


def _runs(window: int, seed: int):
    """Runs of windows whose seed is shared, with a hash of each window; a document's first run carries its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("class", "d", "seed", "start", "high", "low", "frames", "text")}
            for cid, d, high, low, shared_seeds, text in zip(
                *(batch.column(n).to_pylist() for n in ("class", "d", "high", "low", "shared")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True
            ):
                words = hashing.split_words(text, lower=False)
                if len(words) < window or _signed(xxhash.xxh3_128_digest(b" ".join(words))) != (high, low):
                    continue
                hashes = hashing.word_hashes(words)
                own = seeds(hashes, window, seed)
                frames = hashing.gram_hashes(hashes, window, hashing.P2).view(np.int64)
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                ends = np.append(starts[1:], len(own))
                hit = np.isin(own[starts], np.asarray(shared_seeds, dtype=np.int64).view(np.uint64))
                for start, end in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True):
                    part = frames[start:end]
                    span_high, span_low = _signed(xxhash.xxh3_128_digest(part.tobytes()))
                    for name, value in (("class", cid), ("d", d), ("seed", int(own[start].view(np.int64))), ("start", start), ("high", span_high), ("low", span_low), ("frames", part), ("text", text)):
                        out[name].append(value)
                    text = None
            longs = [pa.array(out[n], pa.int64()) for n in ("class", "d", "seed", "start", "high", "low")]
            yield pa.RecordBatch.from_arrays(
                [*longs, pa.array(out["frames"], pa.list_(pa.int64())), pa.array(out["text"], pa.binary())],
                names=["class", "d", "seed", "start", "high", "low", "frames", "text"],
            )

    return run


def _cut(window: int, with_text: bool):
    """Remove the words of flagged windows. Runs: [start, windows in it, flagged ones or null for all]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, removed, digests, texts = [], [], [], []
            for cid, text, runs in zip(*(batch.column(n).to_pylist() for n in ("class", "text", "runs")), strict=True):
                words = hashing.split_words(text, lower=False)
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                for r in runs:
                    if r["some"] is None:
                        steps[r["start"]] += 1
                        steps[r["start"] + r["n"] - 1 + window] -= 1
                    else:
                        for at in r["some"]:
                            steps[r["start"] + at] += 1
                            steps[r["start"] + at + window] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                cids.append(cid)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "replace") if with_text else None)
            columns = [pa.array(cids, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["class", "cut", "cut_sha"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def removed_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every word that lies in a ``window``-word passage which also starts in a document with a smaller id.

    Returns (id, n_words, n_removed, kept_sha256[, kept_text]) for each row; kept words are joined by one space. Windows are
    judged on the input. ``kept_text`` is null where nothing was removed: the text stays as it is. Null, blank and
    short texts keep all words. A null id is neither smaller nor larger than any other. Rows that repeat an id do not remove each
    other's words. An empty table gives an empty one. Only the two named columns are read.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("h"))
    schema = "id long, h long, n_words long, high long, low long, sha string, seeds array<long>"
    rows = shared.stored(shared.numbered(picked.mapInArrow(shared.lean(_winnow(window, seed)), schema)), "winnowed")

    # Equal word sequences are one class: only its first document is searched, the others lose every word.
    classes = shared.stored(
        rows.where("seeds is not null and id is not null")
        .groupBy("high", "low")
        .agg(F.min("_rid").alias("class"), F.min(F.struct("id", "h")).alias("first"), F.first("seeds").alias("seeds"))
        .select("high", "low", "class", F.col("first.id").alias("d"), F.col("first.h").alias("h"), "seeds"),
        "classes",
    )
    seeded = classes.select(F.explode("seeds").alias("seed"), "class")
    common = seeded.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    touched = seeded.join(common, "seed").groupBy("class").agg(F.collect_list("seed").alias("shared"))
    wanted = shared.stored(touched.join(classes.select("class", "d", "h", "high", "low", F.xxhash64("d", "h").alias("row")), "class"), "wanted")
    texts = picked.where("id is not null and text is not null").where(shared.sieve(wanted.select("row"), "row")(F.xxhash64("id", "h")))
    runs = shared.stored(
        texts.groupBy("id", "h").agg(F.first("text").alias("text"))
        .join(wanted.withColumnRenamed("d", "id"), ["id", "h"])
        .select("class", F.col("id").alias("d"), "high", "low", "shared", "text")
        .mapInArrow(shared.lean(_runs(window, seed)), "class long, d long, seed long, start long, high long, low long, frames array<long>, text binary"),
        "runs",
    )
    spans = shared.stored(
        runs.groupBy("seed", "high", "low").agg(F.min("d").alias("d0"), F.first("frames").alias("frames")), "spans"
    )
    # Seeds with several contexts: their windows one by one, once per distinct context.
    split = shared.stored(spans.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "split")
    frames = shared.stored(
        spans.join(split, "seed").select("seed", "high", "low", "d0", F.posexplode("frames").alias("at", "frame")), "frames"
    )
    # Minima are stored before rows are joined with them: the join then deals plain rows, and a passage that many contexts share is split.
    first = shared.stored(frames.groupBy("seed", "frame").agg(F.min("d0").alias("m0"), F.max("d0").alias("m1")).where("m0 < m1").drop("m1"), "first")
    some = frames.join(first, ["seed", "frame"]).where("m0 < d0").groupBy("seed", "high", "low").agg(F.collect_list("at").alias("some"))
    known = shared.stored(spans.select("seed", "high", "low", "d0").join(some, ["seed", "high", "low"], "left"), "known")
    flagged = (
        runs.select("class", "d", "seed", "start", "high", "low", F.size("frames").alias("n"))
        .join(known, ["seed", "high", "low"])
        .where("d > d0 or some is not null")
        .select("class", F.struct("start", "n", F.when(F.col("d") > F.col("d0"), F.lit(None)).otherwise(F.col("some")).alias("some")).alias("run"))
        .groupBy("class")
        .agg(F.collect_list("run").alias("runs"))
    )
    cut_schema = "class long, cut long, cut_sha string" + ", kept_text string" * with_text
    cut = (
        runs.where("text is not null")
        .select("class", "text")
        .join(flagged, "class")
        .mapInArrow(shared.lean(_cut(window, with_text)), cut_schema)
    )
    per_class = classes.select("class", "d", "high", "low").join(cut, "class", "left").drop("class")
    later = F.coalesce(F.col("id") > F.col("d"), F.lit(False))
    own = F.col("id").eqNullSafe(F.col("d"))
    result = rows.drop("seeds", "_rid", "h").join(per_class, ["high", "low"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(later, F.col("n_words")).when(own, F.coalesce("cut", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(later, F.lit(_EMPTY)).when(own, F.coalesce("cut_sha", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        *([F.when(later, F.lit("")).when(own, F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
    return result
