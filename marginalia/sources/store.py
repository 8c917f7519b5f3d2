"""A document store of append-only Parquet tables with one commit log.

Rows carry the version that wrote them. Putting documents appends rows to every table first and then one file to the log; only versions in the log are
read, and of each document only its newest. So a replacement shows in all tables at once or, if it dies half-way, in none, and no
other document's rows are rewritten. ``compacted`` drops what newer versions have replaced.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

_OWN: dict[str, str] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A folder for tables of this application: in ``spark.checkpoint.dir``, or a temporary one where the master is local."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/marginalia-{app}-{name}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="marginalia-work-")
    return os.path.join(_OWN[app], name)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write rows as a table of this application and read it back: later passes don't make them again."""
    path = workspace(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, version): the committed version of each document."""
    if not _there(spark, f"{path}/log"):
        return spark.createDataFrame([], "doc_id string, version long")
    return spark.read.schema("doc_id string, version long").parquet(f"{path}/log").groupBy("doc_id").agg(F.max("version").alias("version"))


def current(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table's rows of the committed versions; unfinished and replaced ones don't show."""
    if not _there(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, version long").parquet(f"{path}/{name}")
    return rows.join(newest(spark, path), ["doc_id", "version"], "left_semi").drop("version")


def put(path: str, documents: DataFrame, parts: dict[str, DataFrame]) -> None:
    """Replace the documents (doc_id) in all tables by their rows in ``parts``; a document without rows in a table has none there afterwards."""
    spark = documents.sparkSession
    known = newest(spark, path).agg(F.max("version")).first()[0]
    version = F.lit(0 if known is None else known + 1).cast("long").alias("version")
    for name, rows in parts.items():
        rows.select("*", version).write.mode("append").parquet(f"{path}/{name}")
    documents.select(F.col("doc_id").cast("string"), version).distinct().coalesce(1).write.mode("append").parquet(f"{path}/log")


def replaced_content(path: str, documents: DataFrame, chunks: DataFrame, more: dict[str, DataFrame]) -> None:
    """Replace documents' chunks and other tables and keep the cards of chunks whose id and text are as before."""
    spark = documents.sparkSession
    cards = tables.kept_cards(current(spark, path, "cards", tables.CARD), current(spark, path, "chunks", tables.CHUNK), chunks)
    put(path, documents, {"chunks": chunks, "cards": cards.join(documents.select("doc_id"), "doc_id", "left_semi"), **more})


def compacted(spark: SparkSession, path: str, name: str, schema: str, to: str) -> None:
    """Write a table without replaced rows elsewhere, partitioned by document."""
    current(spark, path, name, schema).write.mode("overwrite").partitionBy("doc_id").parquet(to)
