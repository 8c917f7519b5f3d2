"""Document-level rollups: contents ranges, sections, cards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shipping

SECTION_CHARS, CARD_BATCH, CARD_RETRY = 12_000, 8, 4


def toc_ranges(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, title, start, end) of contents entries (doc_id, pos, level, title, page) and page counts (doc_id, num_pages).

    Level one alone if it has three entries, else the first two levels; the later title wins a start page; empty ranges go.
    """
    ones = entries.groupBy("doc_id").agg(F.count(F.when(F.col("level") == 1, 1)).alias("ones"))
    used = entries.join(ones, "doc_id").where(F.when(F.col("ones") >= 3, F.col("level") == 1).otherwise(F.col("level") <= 2))
    starts = used.groupBy("doc_id", F.col("page").alias("start")).agg(F.max_by("title", "pos").alias("title"))
    after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start"))
    ranged = starts.withColumn("next", after).join(pages, "doc_id").withColumn("end", F.coalesce(F.col("next") - 1, F.col("num_pages")))
    return ranged.where(F.col("start") <= F.col("end")).select("doc_id", "title", "start", "end")


def paged_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages with each range that holds them. A sweep over a document's range starts and page numbers finds them, and holds the open ranges only; other columns are joined then."""
    spark = shipping.arrow(pages.sparkSession)
    page, start = pages.schema["page_no"].dataType.simpleString(), ranges.schema["start"].dataType.simpleString()
    end = ranges.schema["end"].dataType.simpleString()
    spans = ranges.where("start <= end").groupBy("doc_id", F.col("start").cast("long").alias("at")).agg(F.collect_set(F.col("end").cast("long")).alias("ends"))
    numbers = pages.select("doc_id", F.col("page_no").cast("long").alias("at")).distinct().where("at is not null").withColumn("ends", F.lit(None).cast("array<long>"))
    events = spans.unionByName(numbers).where("doc_id is not null").repartition("doc_id").sortWithinPartitions("doc_id", "at", F.col("ends").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, live = None, []
        for batch in batches:
            rows = []
            for key, at, ends in zip(*(batch[c].to_pylist() for c in ("doc_id", "at", "ends")), strict=True):
                if key != doc:
                    doc, live = key, []
                while live and live[0][0] < at:
                    heapq.heappop(live)
                if ends is None:
                    rows += [(key, at, first, last) for last, first in live]
                else:
                    for last in ends:
                        heapq.heappush(live, (last, at))
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "page_no", "start", "end"])

    doc_type = pages.schema["doc_id"].dataType.simpleString()
    found = events.mapInArrow(shipping.lean(run), f"doc_id {doc_type}, page_no long, start long, end long")
    held = found.select("doc_id", F.col("page_no").cast(page).alias("page_no"), F.col("start").cast(start).alias("start"), F.col("end").cast(end).alias("end"))
    if set(pages.columns) != {"doc_id", "page_no"}:
        held = pages.join(held, ["doc_id", "page_no"])
    else:
        copies = pages.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("_n"))
        held = held.join(copies, ["doc_id", "page_no"]).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n", "_i")
    more = [c for c in ranges.columns if c not in ("doc_id", "start", "end")]
    return held.join(ranges, ["doc_id", "start", "end"]).select(*pages.columns, "start", "end", *more)


def windows(pages: DataFrame, most: int = SECTION_CHARS) -> DataFrame:
    """(doc_id, part, start, end): greedy runs of consecutive pages of at most ``most`` characters; no page is split.

    One pass over each document's sorted (page, size) rows, which holds the open run only; texts stay out of it. A page without a size is a run of its own.
    """
    shipping.arrow(pages.sparkSession)
    page, doc_type = (pages.schema[c].dataType.simpleString() for c in ("page_no", "doc_id"))
    sized = pages.select("doc_id", "page_no", F.length("text").alias("size")).repartition("doc_id").sortWithinPartitions("doc_id", "page_no", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, part, load, first, last, kinds = None, 0, None, None, None, None
        for batch in batches:
            kinds, rows = [batch.schema.field("doc_id").type, pa.int32(), *[batch.schema.field("page_no").type] * 2], []
            for key, at, size in zip(*(batch[c].to_pylist() for c in ("doc_id", "page_no", "size")), strict=True):
                new = key != doc or not part
                if new or load is None or size is None or load + size > most:
                    if part:
                        rows.append((doc, part, first, last))
                    doc, part, load, first, last = key, 1 if new else part + 1, size, at, at
                else:
                    load, first, last = load + size, at if first is None else first, at
            yield made(rows, kinds)
        if part:
            yield made([(doc, part, first, last)], kinds)

    def made(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([],) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "part", "start", "end"])

    return sized.mapInArrow(shipping.lean(run), f"doc_id {doc_type}, part int, start {page}, end {page}")


def batches(rows: DataFrame, key: str, order: str, size: int = CARD_BATCH) -> DataFrame:
    """Rows with the fixed-size batch that they fall into."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("int"))


def cards_by_page(cards: DataFrame) -> DataFrame:
    """(doc_id, page_no, cards): a page's cards in order, joined by a bar."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", F.concat_ws(": ", "topic", "description").alias("t"))))
    return cards.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " | ").alias("cards"))


def matched_cards(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """Model replies (batch, pos, id, topic) to asked chunks (batch, pos, id, chunk_id): by id; by position if no id fits and counts agree."""
    by_id = asked.join(replies.select("batch", "id", F.col("topic").alias("t_id")), ["batch", "id"], "left")
    by_place = by_id.join(replies.select("batch", "pos", F.col("topic").alias("t_pos")), ["batch", "pos"], "left")
    w = Window.partitionBy("batch")
    sizes = replies.groupBy("batch").agg(F.count(F.lit(1)).alias("n_replies"))
    told = by_place.join(sizes, "batch", "left").withColumn("_hits", F.count("t_id").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    topic = F.when(F.col("_hits") > 0, F.col("t_id")).when(F.col("_n") == F.col("n_replies"), F.col("t_pos"))
    return told.select("batch", "chunk_id", topic.alias("topic")).where("topic is not null")


def all_carded(chunks: DataFrame, cards: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_cards, complete): complete documents have chunks, and a card for each."""
    a = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    b = cards.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cards"))
    both = a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_cards", F.lit(0)).alias("n_cards"))
    return both.withColumn("complete", (F.col("n_chunks") > 0) & (F.col("n_cards") >= F.col("n_chunks")))


def rule_issues(sections: DataFrame) -> DataFrame:
    """Sections (…, start, end, key_points array<struct<text,page>>, key_terms) with the list of what their summary lacks."""
    outside = F.array_sort(F.array_distinct(F.transform(F.filter("key_points", lambda p: ~p["page"].between(F.col("start"), F.col("end"))), lambda p: p["page"])))
    issues = F.array(
        F.when(F.size("key_points") < 3, "fewer than 3 key points"),
        F.when(F.size(outside) > 0, F.concat(F.lit("pages outside the section: "), F.array_join(outside.cast("array<string>"), ", "))),
        F.when(F.size("key_terms") == 0, "no key terms"),
    )
    return sections.withColumn("issues", F.array_compact(issues))


def section_rollup(sections: DataFrame) -> DataFrame:
    """(doc_id, sections): summaries in order; the title is the contents', else the model's, else the page range."""
    title = F.coalesce(F.nullif("toc_title", F.lit("")), F.nullif("llm_title", F.lit("")), F.format_string("Pages %d-%d", "start", "end"))
    row = F.struct("start", "end", title.alias("title"), "main_idea")
    return sections.where("main_idea is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("sections"))


def source_text(pages: DataFrame, ranges: DataFrame, most: int = 40_000) -> DataFrame:
    """(doc_id, start, text) of each range's pages: ``[p.N] text`` blocks a blank line apart, cut at ``most`` characters."""
    block = F.struct("page_no", F.concat(F.lit("[p."), F.col("page_no").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("t"))
    blocks = F.transform(F.array_sort(F.collect_list(block)), lambda x: x["t"])
    return paged_ranges(pages, ranges).groupBy("doc_id", "start").agg(F.substring(F.array_join(blocks, "\n\n"), 1, most).alias("text"))


def card_prompts(chunks: DataFrame) -> DataFrame:
    """(doc_id, batch, prompt) of chunks (doc_id, batch, page_no, chunk_index, text): ``[c1] (p.N) text`` blocks in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "chunk_index", "text")))
    lines = F.transform(ordered, lambda x, i: F.concat(F.lit("[c"), (i + 1).cast("string"), F.lit("] (p."), x["page_no"].cast("string"), F.lit(") "), x["text"]))
    return chunks.groupBy("doc_id", "batch").agg(F.array_join(lines, "\n\n").alias("prompt"))


def cards_in_order(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cards with their chunk's place, in reading order."""
    return cards.join(chunks.select("chunk_id", "page_no", "chunk_index"), "chunk_id").orderBy("page_no", "chunk_index")


def children_in_order(children: DataFrame, chunks: DataFrame) -> DataFrame:
    """Children with their parent's place, by page, parent and child."""
    return children.join(chunks.select(F.col("chunk_id").alias("parent_id"), "chunk_index"), "parent_id").orderBy("page_no", "chunk_index", "child_index")


def next_after_check(issues: Column, checks: Column, most: int = 1) -> Column:
    """Whether a summary is written again."""
    return F.when((F.size(issues) > 0) & (checks <= most), "summarize").otherwise("finalize")


def change_counts(changes: DataFrame) -> DataFrame:
    """(doc_id, n): changed rows of each document, most first."""
    return changes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc_id")
