"""Shipping this package to executors, and what Arrow functions hold there."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send the package to the executors once a session, so that Arrow functions import there wherever it is installed."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="marginalia-code-")
    target = os.path.join(folder, "marginalia_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _SHIPPED.add(app)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB in this session, instead of 64: a batch is held several times over, in the JVM and in its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def arrow(spark: SparkSession | None = None) -> SparkSession:
    """What every Arrow function needs first: this package on the executors and small batches."""
    spark = spark or SparkSession.active()
    ship(spark)
    bounded_batches(spark)
    return spark


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function whose worker gives memory back when its task ends: workers are used again, and what one held would stay."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _given_back()

    return wrapped


def _given_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
