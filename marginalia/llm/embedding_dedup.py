"""Operator 4: near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample so that the signs of rotated vectors are balanced binary codes with little quantisation error.
Vectors keep their angles (they are not centred), so two at angle ``t`` differ in each bit with probability ``t / pi``. Codes are cut into
substrings, one table for each; a pair is retrieved when a substring is equal and the whole codes are within a Hamming radius, then reranked
by exact cosine in double precision. Substring length follows the largest label, so buckets stay small as tables grow, and the
number of tables follows from the length so that a pair at the threshold is missed with probability below ``MISS``.

Equal vectors are one node with a weight. Buckets of at most ``BLOCK`` nodes share Arrow groups of about ``GROUP`` nodes. A larger bucket is
dealt out as pairs of blocks, so no task holds a hot bucket; its pairs are all compared. A group returns counts and a spanning forest of its
links, never the links themselves. Vectors travel in their own precision and are compared in double precision.
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

from . import shared
from .components import connected_components

#: Rows of the sample that rotations are fitted on, rounds of fitting, and the probability to miss a pair at the threshold.
SAMPLE, ROUNDS, MISS = 20_000, 30, 1e-4
#: Nodes of a block, and about as many that a bucket should hold.
BLOCK, BUCKET = 1024, 32
#: Nodes that one Arrow group of small buckets holds on average.
GROUP = 4096


def rotation(sample: np.ndarray, seed: int) -> np.ndarray:
    """ITQ: alternate between codes sign(X R) and the orthogonal R nearest to them, from a random rotation."""
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((sample.shape[1],) * 2))[0]
    for _ in range(ROUNDS if len(sample) else 0):
        codes = np.where(sample @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(sample.T @ codes)
        turn = left @ right
    return turn


def tables_for(nodes: int, threshold: float) -> tuple[int, int, int]:
    """(substring bits, tables, Hamming radius over all their bits) for the most nodes that one label has."""
    differ = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    bits = min(30, max(8, math.ceil(math.log2(max(1, nodes) / BUCKET))))
    tables = math.ceil(math.log(MISS) / math.log(1 - min((1 - differ) ** bits, 1 - 1e-9)))
    total = bits * tables
    radius = math.ceil(total * differ + 6 * math.sqrt(total * differ * (1 - differ)))
    return bits, tables, radius


def _vector(values: list | None) -> np.ndarray | None:
    """A finite, non-zero vector in double precision, or None."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, dtype=np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _read(kind: str):
    """Labels, ids and the bytes of good vectors in their own precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, highs, lows, sizes = [], [], [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = _vector(values) if label is not None else None
                raw = None if x is None else x.astype(kind).tobytes()
                high, low = (None, None) if raw is None else np.frombuffer(xxhash.xxh3_128_digest(raw), dtype=np.int64).tolist()
                packed.append(raw)
                highs.append(high)
                lows.append(low)
                sizes.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(sizes, pa.int32())],
                names=["id", "label", "vector", "high", "low", "dim"],
            )

    return run


def _coded(turns: dict[int, np.ndarray], bits: int, tables: int, kind: str):
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subs = []
            for raw, dim in zip(batch.column("vector").to_pylist(), batch.column("dim").to_pylist(), strict=True):
                signs = np.frombuffer(raw, dtype=kind).astype(np.float64) @ turns[dim] >= 0
                subs.append((signs[: bits * tables].reshape(tables, bits) @ weights).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(subs, pa.list_(pa.int32()))], names=[*batch.schema.names, "subs"])

    return run


def _block_pairs(block: np.ndarray, one: int, two: int, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs between two blocks of a large bucket, or inside one."""
    rows, columns = np.flatnonzero(block == one), np.flatnonzero(block == two)
    for start in range(0, len(rows), 64):
        i, j = (x.ravel() for x in np.meshgrid(rows[start : start + 64], columns, indexing="ij"))
        keep = node[i] < node[j] if one == two else slice(None)
        yield i[keep], j[keep]


def _bucket_pairs(sub: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs inside each of many small buckets, by their distance in sorted order."""
    order = np.argsort(sub, kind="stable")
    own = sub[order]
    left = np.arange(len(own))
    for lag in range(1, len(own)):
        left = left[left + lag < len(own)]
        left = left[own[left] == own[left + lag]]
        if not len(left):
            return
        yield order[left], order[left + lag]


def _linked(radius: int, threshold: float, kind: str):
    """Links inside a group: (a, null, count) for each linked node, and (a, b, null) for a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        place, one, two = (table.column(n)[0].as_py() for n in ("t", "one", "two"))
        node, copies, sub = (table.column(n).to_numpy() for n in ("node", "copies", "sub"))
        subs = np.array(table.column("subs").to_pylist(), dtype=np.int32)
        vectors = np.stack([np.frombuffer(raw, dtype=kind) for raw in table.column("vector").to_pylist()]).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        large = table.column("slot")[0].as_py() < 0
        lefts, rights = [], []
        for i, j in _block_pairs(table.column("block").to_numpy(), one, two, node) if large else _bucket_pairs(sub):
            apart = np.bitwise_count(subs[i] ^ subs[j])
            new = (apart.sum(axis=1) <= radius) & (apart[:, :place] > 0).all(axis=1)  # else an earlier table has the pair
            i, j = i[new], j[new]
            near = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norms[i] * norms[j]) >= threshold
            lefts.append(i[near])
            rights.append(j[near])
        a = np.concatenate(lefts) if lefts else np.empty(0, dtype=np.int64)
        b = np.concatenate(rights) if rights else np.empty(0, dtype=np.int64)
        counts = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        top = np.arange(len(node))
        while True:  # the least position reachable
            new = top.copy()
            np.minimum.at(new, a, top[b])
            np.minimum.at(new, b, top[a])
            new = new[new]
            if (new == top).all():
                break
            top = new
        some, joined = np.flatnonzero(counts), np.flatnonzero(top != np.arange(len(node)))
        return pa.table(
            {
                "a": pa.array(np.concatenate([node[some], node[joined]]), pa.int64()),
                "b": pa.array([None] * len(some) + node[top[joined]].tolist(), pa.int64()),
                "n": pa.array(counts[some].astype(np.int64).tolist() + [None] * len(joined), pa.int64()),
            }
        )

    return run


def near_embeddings(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Return (id, n_links, component_id, kept) for each row of ``vectors``.

    Rows are linked when their labels are equal and not null and their cosine is at least ``threshold``. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do those of different lengths or with null ids. Repeated ids are rows
    like any others. An empty table gives an empty one. Only the three named columns are read.
    """
    spark = vectors.sparkSession
    shared.ship(spark)
    picked = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].alias("v"))
    kind = "f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "f8"
    rows = shared.stored(
        shared.numbered(picked.mapInArrow(shared.lean(_read(kind)), "id long, label string, vector binary, high long, low long, dim int")), "vectors"
    )
    good = rows.where("vector is not null and id is not null")
    nodes = shared.stored(
        good.groupBy("label", "high", "low", "dim").agg(
            F.min("_rid").alias("node"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
        ),
        "nodes",
    )
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables, radius = tables_for(most, threshold)
    sampled = nodes.select("dim", "vector", F.xxhash64("high", "low").alias("o")).orderBy("o").limit(SAMPLE).collect()
    turns = {}
    for (dim,) in nodes.select("dim").distinct().collect():
        sample = np.array([np.frombuffer(r["vector"], dtype=kind) for r in sampled if r["dim"] == dim], dtype=np.float64).reshape(-1, dim)
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        turns[dim] = np.concatenate([rotation(sample, seed) for seed in range(-(-bits * tables // dim))], axis=1)
    schema = "node long, label string, dim int, copies long, vector binary, subs array<int>"
    coded = shared.stored(nodes.select("node", "label", "dim", "copies", "vector").mapInArrow(shared.lean(_coded(turns, bits, tables, kind)), schema), "codes")

    entries = coded.select("*", F.posexplode("subs").alias("t", "sub"))
    buckets = coded.select("label", "dim", F.posexplode("subs").alias("t", "sub")).groupBy("label", "dim", "t", "sub").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = shared.stored(buckets, "buckets")
    groups = max(1, most // GROUP)
    dealt = (
        entries.join(buckets, ["label", "dim", "t", "sub"])
        .withColumn("slot", F.when(F.col("size") > BLOCK, -1 - F.col("sub")).otherwise(F.pmod(F.xxhash64("sub"), F.lit(groups)).cast("int")))
        .withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
        .withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("one", F.least("block", "other"))
        .withColumn("two", F.greatest("block", "other"))
    )
    found = shared.stored(
        dealt.select("label", "dim", "t", "slot", "one", "two", "sub", "block", "node", "copies", "vector", "subs")
        .groupBy("label", "dim", "t", "slot", "one", "two")
        .applyInArrow(_linked(radius, threshold, kind), "a long, b long, n long"),
        "links",
    )
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    classes = connected_components(found.where("b is not null"))
    placed = (
        nodes.join(counts, "node", "left")
        .join(classes, "node", "left")
        .select("label", "high", "low", "dim", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    )
    placed = shared.stored(placed, "placed")
    least = shared.stored(placed.groupBy("c").agg(F.min("first_id").alias("component_id")), "least")
    return (
        rows.select("id", "label", "high", "low", "dim")
        .join(placed.join(least, "c").drop("c", "first_id"), ["label", "high", "low", "dim"], "left")
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
