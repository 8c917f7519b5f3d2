"""Connected components of a link table, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Return (node, component): for every node of a link its component's smallest node.

    Large-star and small-star rounds in turn. Each round joins links to one minimum per node; minima come from
    partial aggregates and are stored first, so both sides of the join are plain shuffles that adaptive execution splits: a hub with
    a third of all links is no hot task. Links of a node to itself and null ends are ignored; repeated and reversed
    links count once. No links: an empty table. Rounds are cut with scratch tables, and the one before is deleted.
    """
    spark = edges.sparkSession
    pairs = (
        edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    table = shared.stored(pairs, "links")
    size, own = None, [shared.last_path()]
    while True:
        wide = shared.stored(_large_star(table, own), "links")
        own.append(shared.last_path())
        fresh = shared.stored(_small_star(wide, own), "links")
        shared.dropped(spark, own)
        own = [shared.last_path()]
        # Settled when every node points once, at a root; a sum over both ends notices any change.
        now = fresh.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if now["n"] == 0 or (now["n"], now["h"]) == size:
            table = fresh
            break
        size, table = (now["n"], now["h"]), fresh
    stars = table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def _least(rows: DataFrame, own: list[str]) -> DataFrame:
    """Each node's smallest neighbour, from partial minima. Stored, so that a join with it deals plain rows, whose hot keys Spark splits."""
    least = shared.stored(rows.groupBy("u").agg(F.min("v").alias("m")), "least")
    own.append(shared.last_path())
    return least


def _large_star(links: DataFrame, own: list[str]) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, own).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, own: list[str]) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Here u > v holds for each link."""
    least = _least(links, own)
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
