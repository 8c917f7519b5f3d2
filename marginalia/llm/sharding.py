"""Operator 1: shards of near-equal bytes from a K-d tree over document metadata.

Every document has one integer key per metadata dimension: its scaled coordinate, then a hash of the row that orders ties. A node is
split along the dimension in which its documents spread widest, at the weighted median of bytes (or the fraction that its two halves'
shard counts call for), until each leaf is one shard. Medians come from distributed histograms that narrow in on the split; the driver sees
a bounded number of bin totals for each level, never documents.

Documents of equal text are one point, that of the smallest id, and so share a shard, unless they hold more than ``WHOLE`` of a shard's bytes
together: a larger group is dealt like any other rows, or shards could not be near equal.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

_BITS = 30
_TOP = (1 << 2 * _BITS) - 1
#: Bin totals that one level may send to the driver, and the least bins for a node.
_TOTALS, _LEAST_BINS = 8192, 64
#: A split is taken at a bin's edge if it is off by less than this share of a shard.
TOLERANCE = 0.001
#: Share of a shard's bytes up to which a group of equal texts stays whole.
WHOLE = 0.02
_TEXT = ["_t", "text_crc32", "size"]


@dataclass
class Tree:
    """Scales of the dimensions, and for each level each node's dimension and split key."""

    dimensions: list[str]
    scales: list[tuple[float, float]]
    shards: int
    levels: list[tuple[list[int], list[int]]] = field(default_factory=list)
    leaves: dict[int, int] = field(default_factory=dict)
    copies: DataFrame | None = None  # a stored table: the point of each group of equal texts that stays whole

    def assigned(self, df: DataFrame, keys: list[str], name: str = "shard") -> DataFrame:
        """Add the shard of each row by its key columns; plain expressions, no shuffle."""
        numbers = [self.leaves.get(i, 0) for i in range(1 << len(self.levels))]
        return df.withColumn(name, F.element_at(_longs(numbers), self.node(keys) + 1).cast("int"))

    def node(self, keys: list[str]) -> Column:
        """A row's node in the deepest level so far, from 0: a fold over the levels, as long as the tree is deep."""
        if not self.levels:
            return F.lit(0)
        # Nodes are numbered as in a heap: the root is 1, the children of g are 2 g and 2 g + 1.
        dims, splits = (_longs([v for level in self.levels for v in level[i]]) for i in (0, 1))
        own = F.array(*keys)

        def step(g: Column, _: Column) -> Column:
            right = F.element_at(own, (F.element_at(dims, g) + 1).cast("int")) > F.element_at(splits, g)
            return g * 2 + right.cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.lit(len(self.levels))), F.lit(1), step) - (1 << len(self.levels))


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _coordinate(df: DataFrame, name: str) -> Column:
    """A column as a number in its own order; the first seven characters stand for a string. Null comes first."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        codes = [F.least(F.coalesce(F.ascii(F.substring(df[name], i + 1, 1)), F.lit(0)), F.lit(255)).cast("double") * float(256 ** (6 - i)) for i in range(7)]
        return sum(codes[1:], codes[0])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_timestamp(df[name].cast("timestamp")).cast("double")
    return F.nanvl(df[name].cast("double"), F.lit(0.0))


def _light(docs: DataFrame, dimensions: list[str], id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    size = (F.octet_length(text) + F.lit(16)).cast("long")
    return docs.select(
        docs[id_col].alias("id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_t"),
        *(_coordinate(docs, d).alias(f"_x{i}") for i, d in enumerate(dimensions)),
        *more,
    )


def _gathered(light: DataFrame, copies: DataFrame, dimensions: int) -> DataFrame:
    """Rows of a group that stays whole take its point; ``_whole`` marks them. Only rows that may be of such a group are shuffled."""
    own = [f"_x{i}" for i in range(dimensions)]
    may_be = shared.sieve(copies, "hash")(F.xxhash64(*_TEXT))
    points = copies.select(*_TEXT, F.lit(True).alias("_in"), *(F.col(x).alias(f"_p{x}") for x in own))
    rest = [c for c in light.columns if c not in own]
    found = light.where(may_be).join(points, _TEXT, "left").withColumn("_whole", F.coalesce("_in", F.lit(False)))
    moved = found.select(*rest, *(F.when(F.col("_whole"), F.col(f"_p{x}")).otherwise(F.col(x)).alias(x) for x in own), "_whole")
    return light.where(~may_be).select(*rest, *own, F.lit(False).alias("_whole")).unionByName(moved)


def _keyed(light: DataFrame, scales: list[tuple[float, float]], *more: str) -> DataFrame:
    keys = []
    for i, (low, high) in enumerate(scales):
        unit = (F.coalesce(F.col(f"_x{i}"), F.lit(low)) - F.lit(low)) / F.lit(max(high - low, 1e-9))
        tie = F.expr(f"if(_whole, xxhash64(_t, size, {i}), xxhash64(id, text_crc32, size, {i}))").bitwiseAND(F.lit((1 << _BITS) - 1))
        keys.append((F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit)) * float((1 << _BITS) - 1)).cast("long") * F.lit(1 << _BITS) + tie).alias(f"_k{i}"))
    return light.select("id", "size", "text_crc32", *keys, *more)


def _split_keys(table: DataFrame, tree: Tree, keys: list[str], wanted: dict[int, tuple[int, int, int, float]], leaf_bytes: float) -> dict[int, int]:
    """The split key of each node. wanted: node -> (dimension, least key, greatest key, bytes to the left)."""
    depth, found = len(tree.levels), {}
    ranges = {n: (lo, hi, 0.0) for n, (_, lo, hi, _) in wanted.items()}  # bounds, and the bytes left of them
    while open_ := {n: r for n, r in ranges.items() if n not in found}:
        bins = max(_LEAST_BINS, _TOTALS // len(open_))
        width = 1 << depth
        low, step, dim = [0] * width, [1] * width, [0] * width
        top = [-1] * width
        for n, (lo, hi, _) in open_.items():
            low[n], step[n], top[n], dim[n] = lo, max(1, -(-(hi - lo + 1) // bins)), hi, wanted[n][0]
        at = F.col("_node") + 1
        key = F.element_at(F.array(*keys), F.element_at(_longs(dim), at).cast("int") + 1)
        totals = (
            table.withColumn("_node", tree.node(keys))
            .select("_node", "size", key.alias("_key"), F.element_at(_longs(low), at).alias("_low"), F.element_at(_longs(step), at).alias("_step"))
            .where((F.col("_key") >= F.col("_low")) & (F.col("_key") <= F.element_at(_longs(top), at)))
            .withColumn("_bin", F.expr("(_key - _low) div _step"))
            .groupBy("_node", "_bin")
            .agg(F.sum("size").alias("bytes"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
            .collect()
        )
        by_node = defaultdict(list)
        for r in totals:
            by_node[r["_node"]].append(r)
        for n, (_, _, before) in open_.items():
            goal, own = wanted[n][3], sorted(by_node[n], key=lambda r: r["lo"])
            left, previous = before, own[0]["lo"] - 1
            for r in own:
                after = left + r["bytes"]
                if after >= goal or r is own[-1]:
                    near_left, near_right = abs(goal - left), abs(after - goal)
                    if r["lo"] == r["hi"] or min(near_left, near_right) <= TOLERANCE * leaf_bytes:
                        found[n] = previous if near_left < near_right else r["hi"]
                    else:
                        ranges[n] = (r["lo"], r["hi"], left)
                    break
                left, previous = after, r["hi"]
    return found


def fitted(table: DataFrame, dimensions: list[str], scales: list[tuple[float, float]], shards: int) -> Tree:
    """Grow the tree over a keyed table."""
    tree, keys = Tree(dimensions, scales, shards), [f"_k{i}" for i in range(len(dimensions))]
    nodes, leaf_bytes = {0: shards}, None
    while max(nodes.values()) > 1:
        stats = {
            r["_node"]: r
            for r in table.withColumn("_node", tree.node(keys))
            .groupBy("_node")
            .agg(F.sum("size").alias("bytes"), *(F.min(k).alias(f"lo{k}") for k in keys), *(F.max(k).alias(f"hi{k}") for k in keys))
            .collect()
        }
        if leaf_bytes is None:
            leaf_bytes = (stats[0]["bytes"] if stats else 0) / shards
        wanted = {}
        for n, leaves in nodes.items():
            if leaves > 1 and n in stats:
                s = stats[n]
                dim = max(range(len(keys)), key=lambda i: (s[f"hi{keys[i]}"] - s[f"lo{keys[i]}"], -i))
                wanted[n] = (dim, s[f"lo{keys[dim]}"], s[f"hi{keys[dim]}"], s["bytes"] * (leaves // 2) / leaves)
        splits = _split_keys(table, tree, keys, wanted, leaf_bytes) if wanted else {}
        width = 1 << len(tree.levels)
        tree.levels.append(([wanted[n][0] if n in wanted else 0 for n in range(width)], [splits.get(n, _TOP + 1) for n in range(width)]))
        nodes = {c: k for n, leaves in nodes.items() for c, k in (((2 * n, leaves // 2), (2 * n + 1, leaves - leaves // 2)) if leaves > 1 else ((2 * n, 1),))}
    tree.leaves = {n: i for i, n in enumerate(sorted(nodes))}
    return tree


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("source", "lang", "n_chars", "doc_id"), id_col: str = "doc_id", text_col: str = "text") -> tuple[Tree, DataFrame]:
    """Fit a tree and return it with the manifest (id, size, text_crc32, law, shard, slot, grown_shard).

    ``shards`` leaves, or as many as ``target_bytes`` needs. Size is the text's UTF-8 bytes plus 16 (null: 16). The law is ``bytes``: shards are
    near equal in bytes, ``grown_shard`` is null. ``slot`` is gapless from 0 in each shard. Null coordinates sort first;
    missing dimensions are left out, and without any the row hash alone orders documents. Equal texts (null and empty ones are equal) share a
    shard unless they hold more than ``WHOLE`` of a shard's bytes together; rows equal in id, too, always do. Other ties are split by hash. A very
    long text may outweigh a shard by itself. An empty table gives an empty manifest. Other columns may have any name.
    """
    names = [d for d in dimensions if d in docs.columns] or [id_col]
    light = shared.stored(_light(docs, names, id_col, text_col), "coordinates")
    ends = light.agg(F.sum("size").alias("bytes"), *(f(f"_x{i}").alias(f"{n}{i}") for i in range(len(names)) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    count = shards if target_bytes is None else max(1, -(-int(ends["bytes"] or 0) // target_bytes))
    scales = [(float(ends[f"lo{i}"] or 0), float(ends[f"hi{i}"] or 0)) for i in range(len(names))]
    point = F.min(F.struct("id", *(f"_x{i}" for i in range(len(names))))).alias("p")
    copies = light.groupBy(*_TEXT).agg(F.count(F.lit(1)).alias("n"), point).where((F.col("n") > 1) & (F.col("n") * F.col("size") <= WHOLE * float(ends["bytes"] or 0) / count))
    copies = shared.stored(copies.select(*_TEXT, F.xxhash64(*_TEXT).alias("hash"), *(F.col(f"p._x{i}").alias(f"_x{i}") for i in range(len(names)))), "copies")
    table = shared.stored(shared.numbered(_keyed(_gathered(light, copies, len(names)), scales)), "keys")
    tree = fitted(table, names, scales, count)
    tree.copies = copies
    placed = tree.assigned(table, [f"_k{i}" for i in range(len(names))])
    manifest = shared.ranked(placed, "shard", "_rid", "slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
    return tree, manifest


def with_shard(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> DataFrame:
    """``docs`` with all its columns and each row's shard, as the manifest has it for any null, repeated or empty row; an empty table gives an empty one.

    The shard follows from expressions over the row. Only texts of groups that stay whole are shuffled, to find their group's point.
    """
    row = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    light = _light(docs, tree.dimensions, id_col, text_col, row)
    keyed = _keyed(_gathered(light, tree.copies, len(tree.dimensions)), tree.scales, "_row")
    placed = tree.assigned(keyed, [f"_k{i}" for i in range(len(tree.scales))], "_shard")
    return placed.select("_row.*", F.col("_shard").alias(name))


def write_shards(docs: DataFrame, tree: Tree, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write one folder of Parquet files per shard, all rows of ``with_shard``; several tasks write a shard's files. Replaces what is at ``path``."""
    with_shard(docs, tree, id_col, text_col).write.partitionBy("shard").mode("overwrite").parquet(path)
