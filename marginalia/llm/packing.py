"""Operator 6: best-fit packing by large-item matching.

Token lengths are at most the capacity, so everything that a packing depends on is the histogram of lengths: at most
``capacity`` counts. The plan is made over that histogram on the driver, whole runs of equal bins at a time; pieces
then find their place by their rank among pieces of equal length. A task counts its own pieces of each length while it encodes them,
so a rank is that count plus the sum over earlier tasks, and no piece is sorted. Nothing that grows with the corpus is collected.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import byte_bpe, pieces, shared

CAPACITY = 2048


def default_vocabulary() -> str:
    """Where the byte-level vocabulary of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first, shorter one."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Return (id, piece, start, length, ids_crc32, part, nth[, ids]) for every piece of every document, id 0 at each end.

    ``part`` is the task that made the piece and ``nth`` its rank among that task's pieces of equal length. Fix both with ``stored``.
    """
    shared.ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    fields = [
        T.StructField(id_col, picked.schema["id"].dataType),
        T.StructField("piece", T.IntegerType()),
        *(T.StructField(name, T.LongType()) for name in ("start", "length", "ids_crc32", "part", "nth")),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = byte_bpe.encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for first, texts in pieces.text_slices(batch.column(1)):
                rows, out = [], {name: [] for name in ("piece", "start", "length", "ids_crc32", "nth", "ids")}
                for row, ids in enumerate(ids_of(texts), first):
                    ids += b"\0\0\0\0"
                    for n, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append(row)
                        for name, value in (("piece", n), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(own)), ("nth", seen[length])):
                            out[name].append(value)
                        seen[length] += 1
                        if with_ids:
                            out["ids"].append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(out["piece"], pa.int32()),
                    *(pa.array(out[name], pa.int64()) for name in ("start", "length", "ids_crc32")),
                    pa.array(np.full(len(rows), part), pa.int64()),
                    pa.array(out["nth"], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return picked.mapInArrow(shared.lean(encode), T.StructType(fields))


class Plan:
    """Runs of equal placements: ranks ``lo..hi`` of a length go ``per_bin`` to a bin from bin ``bin`` at ``offset``."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, lo, bin, per_bin, offset
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first, count)
        self.sizes: list[int] = []  # gaps in use, ascending
        self.next_rank: dict[int, int] = {}

    def place(self, length: int, first_bin: int, items: int, per_bin: int, offset: int) -> None:
        rank = self.next_rank.get(length, 0)
        self.rows.append((length, rank, first_bin, per_bin, offset))
        self.next_rank[length] = rank + items

    def leave(self, gap: int, first_bin: int, count: int) -> None:
        if gap and count:
            if gap not in self.gaps:
                self.gaps[gap] = []
                insort(self.sizes, gap)
            self.gaps[gap].append((first_bin, count))

    def open(self, count: int) -> int:
        first = self.bins
        self.bins += count
        return first


def planned(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Large-item matching, then best fit, over counts by length (1 to ``capacity``).

    A bin can hold at most two items above a third of the capacity. Longest first, each such item is matched with
    the longest one that still fits beside it. The gaps that remain take the smaller items, longest first, each in
    the tightest gap; a new bin is opened only when no gap is large enough. Items of one length move together, so the
    work depends on the number of lengths and runs, not of items.
    """
    plan = Plan(capacity)
    left = {length: n for length, n in histogram.items() if n > 0}
    large = sorted(length for length in left if 3 * length > capacity)
    present = list(large)
    for length in reversed(large):
        while left.get(length):
            n = left[length]
            at = bisect_left(present, capacity - length + 1) - 1
            mate = present[at] if at >= 0 else 0
            if mate == length and n >= 2:
                pairs = n // 2
                first = plan.open(pairs)
                plan.place(length, first, 2 * pairs, 2, 0)
                left[length] -= 2 * pairs
                plan.leave(capacity - 2 * length, first, pairs)
                continue
            if mate == length:  # a single one is left of this length: look below it
                mate = present[at - 1] if at > 0 else 0
            pairs = min(n, left[mate]) if mate else n
            first = plan.open(pairs)
            plan.place(length, first, pairs, 1, 0)
            left[length] -= pairs
            if mate:
                plan.place(mate, first, pairs, 1, length)
                left[mate] -= pairs
                if not left[mate]:
                    present.pop(bisect_left(present, mate))
            plan.leave(capacity - length - mate, first, pairs)
        if present and (at := bisect_left(present, length)) < len(present) and present[at] == length:
            present.pop(at)
    for length in sorted((x for x in left if 3 * x <= capacity and left[x]), reverse=True):
        n = left[length]
        while n:
            at = bisect_left(plan.sizes, length)
            if at == len(plan.sizes):
                per_bin = capacity // length
                count = -(-n // per_bin)
                plan.leave(capacity, plan.open(count), count)
                continue
            gap = plan.sizes[at]
            per_bin = gap // length
            first, count = plan.gaps[gap].pop()
            full = min(count, n // per_bin)
            if full:
                plan.place(length, first, full * per_bin, per_bin, capacity - gap)
                plan.leave(gap - per_bin * length, first, full)
                n -= full * per_bin
            if full < count and n:  # the last few go into one more bin
                plan.place(length, first + full, n, per_bin, capacity - gap)
                plan.leave(gap - n * length, first + full, 1)
                n, full = 0, full + 1
            if full < count:
                plan.gaps[gap].append((first + full, count - full))
            if not plan.gaps[gap]:
                del plan.gaps[gap]
                plan.sizes.pop(bisect_left(plan.sizes, gap))
    return plan


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset. Only documents longer than the
    capacity are cut. Null and empty texts are one piece of the closing id 0. Null ids are kept, repeated rows are
    each packed, an empty table gives an empty one, other columns aren't read. The texts are encoded once; a scratch
    table of pieces holds the rest of the work. Counts by task and length are at most ``capacity`` for each task of the scan.
    """
    spark = docs.sparkSession
    table = shared.stored(token_pieces(docs, vocabulary, capacity, id_col, text_col, with_ids), "pieces")
    counts = shared.stored(table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = planned(histogram, capacity)
    keys = np.array([length << 44 | lo for length, lo, *_ in plan.rows], dtype=np.int64)
    order = np.argsort(keys)
    keys, rows = keys[order], np.array(plan.rows, dtype=np.int64).reshape(-1, 5)[order]
    sent = spark.sparkContext.broadcast((keys, rows))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("shift"))
    light = table.join(shifts.hint("merge"), ["part", "length"])  # a table that grows with the tasks: never broadcast
    fields = [f for f in table.schema.fields if f.name not in ("part", "nth")]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("shift").to_numpy()
            own = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - own[:, 1]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return light.mapInArrow(shared.lean(place), schema)
