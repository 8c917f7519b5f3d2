"""The ingest job: raw pages to clean pages, language, chunks and children, put into a document store as one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs
from ..sources import store, tables
from . import chunking, cleaning

CHILD = "child_id string, parent_id string, doc_id string, page_no int, child_index int, text string, child_words int, child_overlap int"


def truncated(pages: DataFrame, most: int | None) -> DataFrame:
    """Pages up to a page number."""
    return pages if most is None else pages.where(F.col("page_no") <= most)


def with_ocr(pages: DataFrame, read: DataFrame) -> DataFrame:
    """Pages read again (doc_id, page_no, text_raw) take the place of those without text; nothing is read twice."""
    return tables.upserted(pages, read, ["doc_id", "page_no"])


def cleaned(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text_raw, text_clean): cleaning rules, then repeated lines of the document removed."""
    ruled = pages.select("doc_id", "page_no", "text_raw", tx.clean_page(udfs.nfkc("text_raw")).alias("text"))
    return cleaning.without_repeated_lines(ruled, keep=("text_raw",)).withColumnRenamed("text", "text_clean")


def scan_error(language: Column, scan: Column) -> Column:
    """Why a scan can't be read: only Chinese ones are; null where nothing is wrong."""
    return F.when(scan & (language == "en"), "scanned English document: OCR it first").when(scan & language.isNull(), "no text found in this scan")


def results(pages: DataFrame, chunks: DataFrame, scans: DataFrame) -> DataFrame:
    """(doc_id, num_pages, num_chunks, language, ocr_required, error): one row for each document, also for one without text."""
    sizes = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("num_pages"))
    made = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("num_chunks"))
    langs = cleaning.document_language(pages.select("doc_id", "page_no", F.col("text_raw").alias("text")))
    joined = sizes.join(made, "doc_id", "left").join(langs, "doc_id", "left").join(scans.select("doc_id", F.col("needs_ocr").alias("ocr_required")), "doc_id", "left")
    return joined.select("doc_id", "num_pages", F.coalesce("num_chunks", F.lit(0).cast("long")).alias("num_chunks"), F.col("lang").alias("language"), "ocr_required", scan_error(F.col("lang"), F.col("ocr_required")).alias("error"))


def ingested(pages: DataFrame, path: str, words: int = 150, overlap: int = 0, most: int | None = None) -> DataFrame:
    """Ingest raw pages (doc_id, page_no, text_raw) of any number of documents and return their ``results``.

    Null texts are empty pages. A document without any text gets a result but no rows in the store. Documents ingested before are replaced
    as a whole, and cards of unchanged chunks stay.
    """
    spark = pages.sparkSession
    work = f"{path}/_work"
    kept = truncated(pages, most)
    langs = store.scratch(cleaning.document_language(kept.select("doc_id", "page_no", F.col("text_raw").alias("text"))), "langs")  # small, and joined with all texts
    cleaned(kept).write.mode("overwrite").parquet(f"{work}/pages")
    clean = spark.read.parquet(f"{work}/pages")
    readable = clean.join(langs, "doc_id")
    chunking.parents(readable.select("doc_id", "page_no", F.col("text_clean").alias("text"), "lang")).write.mode("overwrite").parquet(f"{work}/chunks")
    chunks = spark.read.parquet(f"{work}/chunks")
    children = chunking.children(chunks.join(langs, "doc_id"), words, overlap)
    store.replaced_content(path, langs.select("doc_id"), chunks, {"pages": readable.select("doc_id", "page_no", "text_raw", "text_clean"), "children": children})
    return results(kept, chunks, cleaning.needs_ocr(kept.select("doc_id", F.col("text_raw").alias("text"))))


def rebuilt_children(path: str, chunks: DataFrame, langs: DataFrame, words: int, overlap: int = 0) -> DataFrame:
    """One child set made anew from stored chunks; other sets aren't touched."""
    return chunking.children(chunks.join(langs, "doc_id"), words, overlap)


def index_status(job: Column, chunks: Column) -> Column:
    """``ready``, ``building`` or ``error`` of a document's index: what its job says, else whether there is anything to search."""
    return F.when(F.coalesce(job, F.lit("")) != "", job).when(chunks == 0, "error").otherwise("ready")


def summary_status(ready: Column, running: Column, error: Column) -> Column:
    """``ready``, ``building``, ``error`` or ``none`` of a document's summary."""
    return F.when(ready, "ready").when(running, "building").when(F.coalesce(error, F.lit("")) != "", "error").otherwise("none")
