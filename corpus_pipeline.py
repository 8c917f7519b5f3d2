"""A training corpus in five stages, each of which works on all that the one before it kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again before the next one. All but the last
return the columns of ``documents``, and any others that ``docs`` has, whatever their names. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, minhash_dedup, packing, pii, quality, shared

#: Owner of the stages' scratch tables. A stage deletes those of the stage before it, whose result is written by then.
OWNER = "pipeline"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fitted on the labelled ones, does not reject.

    A null or blank text is scored as one empty line. Rows that repeat a text share its fate; ids, null or repeated, play no part but in the fit.
    """
    shared.bounded_batches(spark)
    with shared.owned(OWNER):
        model = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return quality.kept(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, a null id last.

    Rows are told apart by a stored number, not by their ids, which may be null or repeated. Null and blank texts are in no group and all stay. Rows
    that stay pass by without a shuffle.
    """
    shared.swept(spark, OWNER)
    shared.bounded_batches(spark)
    with shared.owned(OWNER):
        rows = shared.stored(shared.numbered(docs), "rows")
        classes = minhash_dedup.near_duplicates(rows, id_col="_rid").select("_rid", "component_id")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_rid")).alias("first")
        grouped = shared.stored(classes.join(rows.select("_rid", "doc_id"), "_rid"), "grouped")
        kept = shared.stored(grouped.groupBy("component_id").agg(first).select("component_id", F.col("first._rid").alias("kept")), "kept")
        dropped = shared.stored(grouped.join(kept, "component_id").where("_rid <> kept").select("_rid", F.xxhash64("_rid").alias("hash")), "dropped")
        doubtful = shared.sieve(dropped, "hash")(F.xxhash64("_rid"))
        rest = rows.where(doubtful).join(dropped.select("_rid"), "_rid", "left_anti")
        return rows.where(~doubtful).unionByName(rest).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, judged row by row: another row of the same id, or without one, stays. Null and wordless texts stay."""
    shared.swept(spark, OWNER)
    shared.bounded_batches(spark)
    with shared.owned(OWNER):
        return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind. Null texts stay null; ids play no part."""
    shared.swept(spark, OWNER)
    shared.bounded_batches(spark)
    with shared.owned(OWNER):
        return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed training sequences. Null and empty texts are one piece; repeated rows are each packed."""
    shared.swept(spark, OWNER)
    shared.bounded_batches(spark)
    with shared.owned(OWNER):
        return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained models and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is kept in the shared scratch folder until the next has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared.scratch_root(spark)}/marginalia-pipeline-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}-{number}-{name}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            shared.dropped(spark, [before])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
