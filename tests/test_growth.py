"""Steps whose memory, time or largest task grew faster than their input: the results of plain code, on odd rows, and what bounds them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marginalia.functions import udfs
from marginalia.operators import chunking, cleaning, rollup, study, tasks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("step", ["nfkc", "sentences", "children", "replies"])
def test_small_arrow_batches(spark, step):
    """Batches of 64 MB of text were held several times over by each worker."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    t = spark.createDataFrame([("d", 1, "One two. Three", "en", "c", "p"), ("d", 2, None, "en", "d", None)], "doc_id string, page_no int, text string, lang string, chunk_id string, prompt string")
    made = {"nfkc": lambda: t.select(udfs.nfkc("text")), "sentences": lambda: t.select(udfs.sentence_split("text", "lang")), "children": lambda: chunking.children(t.where("text is not null"), 2, 1), "replies": lambda: tasks.replied(t, "answer")}[step]()
    assert made.count() and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m" and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "4000"


def test_windows_of_a_long_document(spark):
    sizes = [random.Random(7).choice([None, 0, 1, 5, 12, 3]) for _ in range(500)]
    pages = spark.createDataFrame([(d, i, None if n is None else "x" * n) for d in "ab" for i, n in enumerate(sizes)], "doc_id string, page_no int, text string").repartition(5)
    want, load = [], None
    for i, n in enumerate(sizes):
        if load is None or n is None or load + n > 10:
            want.append([i, i])
            load = n
        else:
            want[-1][1], load = i, load + n
    assert sorted(map(tuple, rollup.windows(pages, 10).collect())) == [(d, p + 1, a, b) for d in "ab" for p, (a, b) in enumerate(want)]
    long = spark.range(60_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page_no"), F.lit("x").alias("text"))
    began = time.time()
    assert rollup.windows(long, 1).count() == 60_000 and time.time() - began < 60


def test_ranges_of_a_long_document(spark):
    pages = spark.createDataFrame([("a", p, f"t{p}") for p in (1, 2, 2, 5, 9, 40)] + [("b", 5, None), ("c", 1, "u"), ("a", None, "v")], "doc_id string, page_no int, text string")
    ranges = spark.createDataFrame([("a", "x", 1, 5), ("a", "y", 2, 2), ("a", "z", 2, 2), ("a", "w", 6, 3), ("a", "v", 9, 39), ("b", "u", 5, 5), ("d", "t", 1, 9)], "doc_id string, title string, start int, end int")
    for some in (pages, pages.drop("text")):
        want = some.join(ranges, "doc_id").where(F.col("page_no").between(F.col("start"), F.col("end"))).select(*some.columns, "start", "end", "title")
        found = rollup.paged_ranges(some, ranges)
        assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    n = 60_000
    long = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page_no"))
    began = time.time()
    assert rollup.paged_ranges(long, long.select("doc_id", F.col("page_no").alias("start"), F.col("page_no").alias("end"))).count() == n and time.time() - began < 60


def test_context_takes_one_shuffle(spark):
    old = spark.createDataFrame([(1, 7, 0), (1, 8, 1), (1, 9, 2), (2, 7, 0), (3, 1, 0), (3, 1, 1), (3, None, 2), (None, 4, 0)], "q int, unit int, pos int")
    new = spark.createDataFrame([(1, 8, 0), (1, 5, 1), (1, 6, 2), (3, 1, 0), (3, None, 1), (4, 4, 0), (None, 4, 0)], "q int, unit int, pos int")
    found = study.merged_context(old, new, 4)
    assert sorted((r.q or 0, r.pos, r.unit) for r in found.collect()) == [(0, 0, 4), (0, 1, 4), (1, 0, 7), (1, 1, 8), (1, 2, 5), (1, 3, 6), (2, 0, 7), (3, 0, 1), (3, 1, 1), (3, 2, None), (3, 3, None), (4, 0, 4)]
    assert plan(study.merged_context(old, new, 4)).count("Exchange") == 1


def test_language_vote_shuffles_no_text(spark):
    zh, en = "这是一个很长的中文句子" * 10, "a long English sentence " * 10
    rows = [("a", 1, zh), ("a", 2, "x"), ("b", 1, en), ("b", 2, "中"), ("c", 1, "中文"), ("c", 2, " "), ("e", 1, None), *(("f", i, zh if i < 3 else en) for i in range(5))]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    found = cleaning.document_language(pages)
    assert {r.doc_id: r.lang for r in found.collect()} == {"a": "zh", "b": "en", "c": "zh", "f": "zh"}
    assert not [line for line in plan(cleaning.document_language(pages)).splitlines() if "Project [" in line and re.search(r"(\[|, )text#\d+(,|\])", line)]
    bare = cleaning.without_repeated_lines(spark.createDataFrame([("a", i, f"Head\n line {i}\n a {i}\n b {i}\n\n Head ") for i in range(4)] + [("b", 1, None)], "doc_id string, page_no int, text string"))
    assert {(r.doc_id, r.page_no): r.text for r in bare.collect()} == {("b", 1): "", **{("a", i): f"line {i}\n a {i}\n b {i}" for i in range(4)}}
    assert "posexplode" not in plan(bare)
