"""Keyed, incremental state on Structured Streaming: step events, progress, heartbeats, counters, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", per_trigger: int = 16) -> DataFrame:
    """The events of a folder as a stream; event time is cast, because watermarks need a zoned timestamp."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_progress(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The newest event of each key; works on batch and stream (update mode)."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("s")).select(key, "s.ts", "s.event_type", "s.value")


def stale(latest: DataFrame, now, after: str = "300 seconds") -> DataFrame:
    """Keys whose last sign of life is too old."""
    return latest.withColumn("stale", F.col("ts") < now - F.expr(f"interval {after}"))


def counters(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Running count and sum of each key and kind."""
    return events.groupBy(key, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def windowed(events: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counts by event-time window. A watermark bounds the state of a live stream and drops later rows; None has no watermark and counts every row."""
    timed = events if late is None else events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Repeated events of one id dropped; ids are forgotten with the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def merged_into(path: str, keys: list[str], order: str | None = None):
    """A ``foreachBatch`` sink that upserts into versions of a Parquet table.

    A version counts once its ``_SUCCESS`` is there, so a batch that died half-way is written again and a repeated one is not. Of rows
    with equal keys in one batch the last by ``order`` is taken, or any one without it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
        listed = fs.listStatus(path_of(path)) if fs.exists(path_of(path)) else []
        versions = sorted(int(s.getPath().getName()[1:]) for s in listed if fs.exists(path_of(f"{path}/{s.getPath().getName()}/_SUCCESS")))
        if epoch in versions:
            return
        rest = [c for c in batch.columns if c not in keys]
        merged = batch.dropDuplicates(keys) if order is None else batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
        if versions:
            old = spark.read.parquet(f"{path}/v{versions[-1]}")
            merged = old.join(merged.select(*keys), keys, "left_anti").unionByName(merged)
        merged.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write


#: What a job's state may follow (fixed values).
JOB_ORDER = ("building", "ready", "summarizing", "summarized")


def job_states(events: DataFrame) -> DataFrame:
    """(doc_id, state, ts) of job events (doc_id, state, ts): the furthest state; an error after it wins, a later restart clears it. One grouped fold, batch or stream."""
    rank = F.array_position(F.array(*map(F.lit, JOB_ORDER)), F.col("state"))
    last = F.max(F.struct("ts", "state"))
    best = F.max(F.struct(rank.alias("rank"), "ts", "state"))
    told = events.groupBy("doc_id").agg(last.alias("last"), best.alias("best"))
    failed, again = F.col("last.state") == "error", F.col("last.state") == "building"
    return told.select("doc_id", F.when(failed | again, F.col("last.state")).otherwise(F.col("best.state")).alias("state"), F.col("last.ts").alias("ts"))


def accepted_answers(resumes: DataFrame) -> DataFrame:
    """The first answer to each pause (thread, pause); later ones of the same pause are rejected."""
    rest = [c for c in resumes.columns if c not in ("thread", "pause")]
    return resumes.groupBy("thread", "pause").agg(F.min_by(F.struct(*rest), F.struct("ts", *[c for c in rest if c != "ts"])).alias("_r")).select("thread", "pause", "_r.*")


def thread_states(events: DataFrame) -> DataFrame:
    """(thread, n, pauses, last, awaiting) of thread events (thread, event_id, ts, kind): a thread awaits an answer while its last pause is newer than
    each resume and end. One grouped fold: as a stream its state lies in the checkpoint, so a restart goes on where the last one stopped."""
    at, kind = F.struct("ts", "event_id"), F.col("kind")
    told = events.groupBy("thread").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(kind == "pause", 1)).alias("pauses"),
        F.max(F.struct("ts", "event_id", "kind")).alias("last"),
        F.max(F.when(kind == "pause", at)).alias("paused"),
        F.max(F.when(kind.isin("resume", "done"), at)).alias("went"),
    )
    waits = F.col("paused").isNotNull() & (F.col("went").isNull() | (F.col("paused") > F.col("went")))
    return told.select("thread", "n", "pauses", F.col("last.kind").alias("last"), waits.alias("awaiting"))


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over what is there now and return its last result as a table on disk; no rows pass through the driver."""
    spark, path = stream.sparkSession, store.workspace(stream.sparkSession, name)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
