"""What the corpus operators share: shipping code to executors, scratch tables, ranks without hot tasks.

Scratch tables live in the folder that the session names in ``spark.checkpoint.dir``; every executor sees it, so a
lost executor costs only the tasks that it ran. Nothing here keeps data in executor-local storage.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import bounded_batches, lean, ship  # noqa: F401  the operators call them from here

_OWN_ROOT: dict[str, str] = {}
_WRITTEN: dict[str, str] = {}
_OWNER = [""]

#: Rows in one block of ``ranked``; a window never holds more.
BLOCK = 16384
#: Bits of a ``sieve``: at least, for each key, and at most (4 MB), whatever the number of keys.
SIEVE_LEAST, SIEVE_PER_KEY, SIEVE_MOST = 1 << 16, 16, 1 << 25


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables: ``spark.checkpoint.dir``. Only a local master may leave that unset and gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="marginalia-scratch-")
        atexit.register(shutil.rmtree, _OWN_ROOT[app], ignore_errors=True)
    return _OWN_ROOT[app]


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when each query ends; what they made is in a table by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet scratch table and read it back: lineage is cut and later passes prune columns."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/marginalia-{uuid.uuid4().hex}-{name}"
    with _tidy(spark):
        df.write.parquet(path)
    _WRITTEN[path] = _OWNER[-1]
    return spark.read.schema(df.schema).parquet(path)


def sieve(hashes: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that every hash in a long column of a stored table passes, and few others: one bit per hash in an array of bounded size.

    It thins a scan out before a shuffle; an exact join follows. With very many hashes the array fills and the test lets more
    pass, so results never depend on it. Built by one aggregate, read as a scalar subquery; no row of the table reaches the driver.
    """
    spark, wanted = hashes.sparkSession, SIEVE_LEAST
    count = hashes.count()
    while wanted < min(SIEVE_MOST, SIEVE_PER_KEY * count):
        wanted *= 2
    words, at = wanted // 64, F.pmod(F.col(column), F.lit(wanted))
    filled = (
        hashes.select(F.expr("1L").alias("one"), at.alias("at"))
        .groupBy(F.expr("at div 64").alias("id"))
        .agg(F.bit_or(F.expr("shiftleft(one, cast(at % 64 as int))")).alias("bits"))
    )
    dense = spark.range(words).join(filled, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "bits")))
    array = stored(dense.agg(F.transform(ordered, lambda x: x["bits"]).alias("bits")), "sieve").scalar()

    def passes(value: Column) -> Column:
        place = F.pmod(value, F.lit(wanted))
        return F.getbit(F.get(array, F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1

    return passes


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables by path."""
    jvm = spark._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _WRITTEN.pop(path, None)


def last_path() -> str:
    """Where the newest scratch table lies."""
    return next(reversed(_WRITTEN))


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """Scratch tables written inside belong to ``owner``."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def swept(spark: SparkSession, owner: str = "") -> None:
    """Delete an owner's scratch tables; call it once the results that read them are materialised."""
    dropped(spark, [path for path, own in _WRITTEN.items() if own == owner])


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Add a unique long per row. Fix it with ``stored`` before use: a recomputed plan may number anew."""
    return df.withColumn(name, F.monotonically_increasing_id())


def ranked(df: DataFrame, key: str, rid: str, name: str) -> DataFrame:
    """Add ``name``: gapless ranks from 0 among rows of equal ``key``, in order of ``rid``.

    ``rid`` comes from ``numbered`` and is fixed. Ranks are taken inside blocks of at most ``BLOCK`` rows and shifted
    by the running count of earlier blocks, so a key with a third of all rows never lands in one task.
    """
    blocked = df.withColumn("_block", F.expr(f"shiftright({rid}, 14)"))
    inside = Window.partitionBy(key, "_block").orderBy(rid)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        blocked.groupBy(key, "_block")
        .agg(F.count(F.lit(1)).alias("_in_block"))
        .withColumn("_shift", F.coalesce(F.sum("_in_block").over(before), F.lit(0).cast("long")))
        .drop("_in_block")
    )
    return (
        blocked.withColumn("_at", (F.row_number().over(inside) - 1).cast("long"))
        .join(shifts, [key, "_block"])
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_at", "_shift", "_block")
    )
