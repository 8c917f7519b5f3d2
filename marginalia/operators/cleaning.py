"""Page-level text operators: repeated lines, language votes, OCR need, noise repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import store


def edge_lines(pages: DataFrame, top: int = 2, bottom: int = 2) -> DataFrame:
    """(doc_id, page_no, key, weight) of the first and last non-blank lines of each page. A line of a short page can be both."""
    lines = F.filter(F.transform(F.split("text", "\n"), tx.line_key), lambda x: x != "")
    edges = F.when(F.size("l") > 0, F.concat(F.slice("l", 1, top), F.slice("l", F.greatest(F.lit(1), F.size("l") - bottom + 1), bottom))).otherwise(F.array().cast("array<string>"))
    weight = F.when(F.col("key").rlike(f"(?i){tx.PAGE_NUMBER}") | F.col("key").rlike(tx.SEPARATOR), 2).otherwise(1)
    return pages.select("doc_id", "page_no", lines.alias("l")).select("doc_id", "page_no", F.explode(edges).alias("key")).withColumn("weight", weight)


def repeated_lines(pages: DataFrame, ratio: float = 0.6, min_len: int = 3) -> DataFrame:
    """(doc_id, key, weight): header and footer lines on at least ``ratio`` of a document's pages, and on one at least."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        edge_lines(pages)
        .where(F.length("key") >= min_len)
        .groupBy("doc_id", "key")
        .agg(F.sum("weight").alias("weight"))
        .join(counts, "doc_id")
        .where(F.col("weight") >= F.greatest(F.lit(1), F.floor(F.col("n") * ratio)))
        .select("doc_id", "key", "weight")
    )


def without_repeated_lines(pages: DataFrame, ratio: float = 0.6, min_len: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages without their document's repeated lines, wherever on the page they stand; line order is kept. A null text is an empty page.

    A document has few of them, at most 8 / ``ratio`` or those of 1 / ``ratio`` pages: pages get them as one array, and their lines are never rows.
    """
    drop = repeated_lines(pages, ratio, min_len).groupBy("doc_id").agg(F.collect_set("key").alias("_drop"))
    drop = store.scratch(drop, "lines")  # its size is known then, and texts aren't shuffled for a small one
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("_drop", tx.line_key(x)), F.lit(False)))
    return pages.join(drop, "doc_id", "left").select("doc_id", "page_no", *keep, tx.stripped(F.array_join(left, "\n")).alias("text"))


def needs_ocr(pages: DataFrame, min_chars: int = 30, ratio: float = 0.6) -> DataFrame:
    """(doc_id, empty_ratio, needs_ocr): enough pages with hardly any text."""
    short = F.when(F.length(tx.stripped(F.coalesce("text", F.lit("")))) < min_chars, 1.0).otherwise(0.0)
    return pages.groupBy("doc_id").agg(F.avg(short).alias("empty_ratio")).withColumn("needs_ocr", F.coalesce(F.col("empty_ratio") >= ratio, F.lit(True)))


def document_language(pages: DataFrame, sample: int = 5, min_chars: int = 50, seed: int = 0) -> DataFrame:
    """(doc_id, lang): a vote of sampled pages with enough text, else of any non-blank ones; ties are ``en``."""
    size = F.length(tx.stripped(F.coalesce("text", F.lit(""))))
    told = pages.where(size > 0).select("doc_id", "page_no", (size >= min_chars).alias("full"), tx.is_zh_page(F.col("text")).cast("int").alias("zh"))  # no text in the shuffle
    order = Window.partitionBy("doc_id").orderBy(F.desc("full"), F.xxhash64("page_no", F.lit(seed)))
    chosen = told.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    votes = F.when(F.max("full"), F.avg(F.when(F.col("full"), F.col("zh")))).otherwise(F.avg("zh"))  # pages with enough text come first, so one is chosen if there is any
    return chosen.groupBy("doc_id").agg(F.when(votes > 0.5, "zh").otherwise("en").alias("lang"))


def noise_changes(chunks: DataFrame, min_chars: int = 3) -> DataFrame:
    """Rows whose text noise repair changes: (…, new_text, action), ``delete`` if hardly anything is left."""
    changed = chunks.withColumn("new_text", tx.tidied(F.col("text"))).where(~F.col("new_text").eqNullSafe(F.col("text")))
    return changed.withColumn("action", F.when(F.length(tx.stripped(F.col("new_text"))) < min_chars, "delete").otherwise("update"))


def page_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): a page's chunks in order, one per line."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def stratified_sample(pages: DataFrame, bins: int, min_chars: int = 300, seed: int = 42) -> DataFrame:
    """One page of each of ``bins`` runs of consecutive pages of a document, by a seeded hash."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    numbered = pages.where(F.length("text") >= min_chars).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    binned = numbered.withColumn("bin", F.floor(F.col("_i") / F.greatest(F.lit(1), F.floor(F.col("_n") / bins))).cast("int")).where(F.col("bin") < bins)
    return binned.groupBy("doc_id", "bin").agg(F.min_by(F.struct("page_no", "text"), F.xxhash64("page_no", F.lit(seed))).alias("r")).select("doc_id", "bin", "r.*")
