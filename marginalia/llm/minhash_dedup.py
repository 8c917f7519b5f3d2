"""Operator 5: near-duplicates by one-permutation MinHash with optimal densification.

Each set of 5-word shingles gets one permutation's minima over ``BINS`` bins; an empty bin borrows from the bin that a
fixed sequence of universal hashes names first (optimal densification). ``BANDS`` bands of ``ROWS`` bins are bucket
keys: a pair at the threshold 0.75 misses all of them with probability (1 - 0.75**ROWS)**BANDS, about 5e-6.

Equal sets are one node, whatever their number. Every bucket links its members to one centre only, a star, and the candidates are
confirmed on full sets. What a star can lose, links between members that are not near its centre, is recovered exactly: members of
one bucket that are still in different components go through a prefix filter with positional and length bounds, so pairs inside a
group of copies are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing, shared
from .components import connected_components

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
_SHIFT = np.uint64(64 - 7)
_EDGES = np.arange(BINS, dtype=np.uint64) << _SHIFT
_TRIES = 512
#: Ratio of neighbouring classes of set sizes.
_STEP = 1.05


def _probes() -> np.ndarray:
    """Bin j's t-th lender, from a fixed universal hash of (j, t)."""
    j, t = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(_TRIES, dtype=np.uint64), indexing="ij")
    with np.errstate(over="ignore"):
        return (hashing.mixed(j * hashing.P1 + t * hashing.P2 + np.uint64(1)) >> _SHIFT).astype(np.int64)


_PROBES = _probes()


def shingle_set(text: bytes | None, words_in: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; fewer words than one shingle make a single one."""
    hashes = hashing.word_hashes(hashing.split_words(text, lower=True))
    if not len(hashes):
        return hashes
    return np.unique(hashing.gram_hashes(hashes, min(words_in, len(hashes))))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a sorted, non-empty set."""
    first = np.searchsorted(shingles, _EDGES)
    end = np.append(first[1:], len(shingles))
    full = end > first
    sketch = np.zeros(BINS, dtype=np.uint64)
    sketch[full] = shingles[first[full]]
    empty = np.flatnonzero(~full)
    for t in range(_TRIES):
        if not len(empty):
            break
        lender = _PROBES[empty, t]
        found = full[lender]
        sketch[empty[found]] = sketch[lender[found]]
        empty = empty[~found]
    if len(empty):  # after so many tries: the first full bin, the same for equal patterns
        sketch[empty] = sketch[np.flatnonzero(full)[0]]
    return sketch


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * hashing.P2
    with np.errstate(over="ignore"):
        for column in sketch.reshape(BANDS, ROWS).T:
            keys = keys * hashing.P1 + column
        return hashing.mixed(keys).view(np.int64)


def _set_id(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the full set, as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=np.int64).tolist())


def _signatures(words_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, highs, lows, bands = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                shingles = shingle_set(text, words_in)
                sizes.append(len(shingles))
                high, low = _set_id(shingles) if len(shingles) else (0, 0)
                highs.append(high)
                lows.append(low)
                bands.append(band_keys(minima(shingles)) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "h", "n_shingles", "high", "low", "bands"],
            )

    return run


def _sets(words_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, high, low, text in zip(
                *(batch.column(n).to_pylist() for n in ("node", "high", "low")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True
            ):
                shingles = shingle_set(text, words_in)
                if len(shingles) and _set_id(shingles) == (high, low):
                    nodes.append(node)
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold; integer arithmetic, so no rounding at the edge."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    shared_n = F.size(F.array_intersect("set_a", "set_b"))
    return (
        with_b.select("a", "b", shared_n.alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
        .where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("s") - F.col("i")))
        .select("a", "b")
    )


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b) of ``nodes`` (node, n, c) in different components whose sets can reach the threshold, and few others.

    A set's shingles are ordered from rare to common. If two sets reach the threshold, their first common shingle leaves enough shingles after
    it in both, so it is among the first few of each, and how few follows from both sizes. Only those are joined, by
    shingle and classes of size. An edited copy's first shingles are its own, which no other has, so a large group of
    edited copies yields hardly any pairs, and no pair that reaches the threshold is left out.
    """
    spread = nodes.join(sets, "node").select("node", "n", "c", F.explode("shingles").alias("shingle"))
    common = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = (
        spread.join(common, "shingle")
        .groupBy("node", "n", "c")
        .agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order"))
        .select("node", "n", "c", (F.col("n") - F.size("order")).alias("own"), F.posexplode("order").alias("i", "e"))
        .select("node", "n", "c", (F.col("n") - F.col("own") - F.col("i")).alias("left"), F.col("e.shingle").alias("shingle"))
    )

    def size_class(n):
        return F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(_STEP)).cast("int")

    least_n = F.ceil(F.col("n") * percent / 100)
    classed = (
        ordered.withColumn("mine", size_class(F.col("n")))
        .withColumn("theirs", F.explode(F.sequence(size_class(least_n), size_class(F.ceil(F.col("n") * 100 / percent)))))
        .withColumn("m", F.greatest(least_n, F.floor(F.pow(F.lit(_STEP), F.col("theirs")) - 1e-6)))
        .where(F.col("left") * (100 + percent) >= F.lit(percent) * (F.col("n") + F.col("m")))
        .select("node", "n", "c", "left", "shingle", F.least("mine", "theirs").alias("low"), F.greatest("mine", "theirs").alias("high"), (F.col("mine") <= F.col("theirs")).alias("is_low"), (F.col("mine") >= F.col("theirs")).alias("is_high"))
    )
    classed = shared.stored(classed, "prefixes")
    keys = ["shingle", "low", "high"]
    mixed_keys = classed.groupBy(keys).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select(keys)
    live = classed.join(mixed_keys, keys)
    one = live.where("is_low").select(*keys, *(F.col(x).alias(f"{x}1") for x in ("node", "n", "c", "left")))
    two = live.where("is_high").select(*keys, *(F.col(x).alias(f"{x}2") for x in ("node", "n", "c", "left")))
    reaches = F.least("left1", "left2") * (100 + percent) >= F.lit(percent) * (F.col("n1") + F.col("n2"))
    sizes = F.lit(100) * F.least("n1", "n2") >= F.lit(percent) * F.greatest("n1", "n2")
    pairs = one.join(two, [*(one[k] == two[k] for k in keys), one["c1"] != two["c2"], (one["low"] < one["high"]) | (one["node1"] < two["node2"]), reaches, sizes])
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, words_in: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_shingles, component_id, kept) for each row of ``docs``.

    Rows are linked when ``100 * |A & B| >= percent * |A | B|`` holds for their shingle sets; ``component_id`` is the smallest
    id reachable by links, itself included. Null and blank texts have an empty set and link with nothing, and so do
    rows with a null id (component null, kept). Rows that repeat an id are compared like any others. An empty table gives an
    empty one. Only the two named columns are read. Texts are read twice; the second time only those that share a bucket are shuffled.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("h"))
    schema = "id long, h long, n_shingles long, high long, low long, bands array<long>"
    rows = shared.stored(shared.numbered(picked.mapInArrow(shared.lean(_signatures(words_in)), schema)), "signatures")

    linked = rows.where("n_shingles > 0 and id is not null")
    nodes = shared.stored(
        linked.groupBy("high", "low").agg(
            F.min("_rid").alias("node"), F.min(F.struct("id", "h")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        ).select("high", "low", "node", F.col("first.id").alias("first_id"), F.col("first.h").alias("h"), "n", "bands"),
        "nodes",
    )
    banded = nodes.select(F.explode("bands").alias("key"), "node", "n")
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = shared.stored(banded.join(buckets, "key"), "members")
    # The member with the most company over all its buckets is the centre: of edited copies, the text they were made from.
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    centres = shared.stored(members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"), "n")).alias("centre")), "centres")

    stars = shared.stored(
        members.join(centres.select("key", (-F.col("centre.minus")).alias("centre"), F.col("centre.n").alias("m")), "key")
        .where("node <> centre")
        .where(F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m"))
        .select(F.col("centre").alias("a"), F.col("node").alias("b"))
        .distinct(),
        "stars",
    )
    wanted = shared.stored(members.select("node").distinct().join(nodes.select("node", "high", "low", F.col("first_id").alias("id"), "h", F.xxhash64("first_id", "h").alias("row")), "node"), "wanted")
    texts = picked.where("text is not null and id is not null").where(shared.sieve(wanted, "row")(F.xxhash64("id", "h")))
    sets = shared.stored(
        texts.groupBy("id", "h").agg(F.first("text").alias("text"))
        .join(wanted, ["id", "h"])
        .select("node", "high", "low", "text")
        .mapInArrow(shared.lean(_sets(words_in)), "node long, shingles array<long>"),
        "sets",
    )
    links = shared.stored(_confirmed(stars, sets, percent), "confirmed")
    found = shared.stored(connected_components(links), "components")

    # What stars have not joined: members of one bucket in different components.
    placed = members.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    placed = shared.stored(placed, "placed")
    mixed_keys = shared.stored(placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key"), "mixed")
    open_ = placed.join(mixed_keys, "key").select("node", "n", "c").distinct()
    rest = shared.stored(_prefix_pairs(open_, sets, percent), "rest")
    more = shared.stored(_confirmed(rest.join(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti"), sets, percent), "confirmed")
    if more.take(1):
        tops = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = shared.stored(connected_components(tops.unionByName(more)), "components")

    class_of = shared.stored(nodes.join(found, "node", "left").select("high", "low", "first_id", F.coalesce("component", "node").alias("component")), "classes")
    least = shared.stored(class_of.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    return (
        rows.select("id", "n_shingles", "high", "low")
        .join(class_of.join(least, "component").select("high", "low", "component_id"), ["high", "low"], "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
