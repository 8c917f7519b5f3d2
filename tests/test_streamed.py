"""Searches that stream units past their questions: the results of a plain search, and no shuffle that grows with units and questions."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.operators import retrieval, streamed
from marginalia.plans import retrieval_queries as rq

SF = "/root/testdata/sf0.001"
UNITS = [("s", "a", "Heaps are trees. heaps!"), ("s", "b", "trees of heaps and queues"), ("s", "c", None), ("s", "d", "queues hold items"), ("t", "e", "heaps hold heaps"), ("t", "f", "graphs"), ("s", "g", "trees of heaps and queues"), ("s", None, "queues")]
ASKED = [(1, "s", "heaps trees"), (2, "s", "queues queues"), (3, "t", "heaps"), (4, "s", " "), (5, "none", "heaps"), (6, "s", "absent"), (7, "s", None)]


def frames(spark):
    return spark.createDataFrame(UNITS, "scope string, unit string, text string"), spark.createDataFrame(ASKED, "q int, scope string, text string")


def plain_bm25(k):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = []
    for q, scope, text in ASKED:
        docs = [(u, Counter(words(t))) for s, u, t in UNITS if s == scope]
        avg, scores = sum(sum(c.values()) for _, c in docs) / max(1, len(docs)), []
        for u, c in docs:
            s = sum(math.log(len(docs) / sum(t in x for _, x in docs)) * 2.5 * c[t] / (1.5 * (0.25 + 0.75 * sum(c.values()) / avg) + c[t]) for t in set(words(text)) if c[t])
            if s > 0 and u is not None:
                scores.append((-round(s, 6), u))
        found += [(q, u, -s, i + 1) for i, (s, u) in enumerate(sorted(scores)[:k])]
    return found


@pytest.mark.parametrize("block", [1024, 2])
def test_bm25_in_blocks_and_scopes(spark, monkeypatch, block):
    monkeypatch.setattr(streamed, "QUERIES", block)
    units, asked = frames(spark)
    rows = retrieval.bm25(units.repartition(3), asked, 2).orderBy("q", "rank").collect()
    assert [(r.q, r.unit, round(r.score, 6), r["rank"]) for r in rows] == plain_bm25(2)
    assert retrieval.bm25(units, asked.limit(0), 2).collect() == [] == retrieval.bm25(units.limit(0), asked, 2).collect()


def test_bm25_shuffles_only_the_best(spark):
    units, asked = frames(spark)
    plan = retrieval.bm25(units, asked, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((\w+)#", plan) and set(re.findall(r"hashpartitioning\((\w+)#", plan)) == {"q"}


def test_queries_make_no_index(spark, monkeypatch):
    monkeypatch.setattr(rq.index, "written", lambda *a, **b: pytest.fail("an index of all terms"))
    assert rq.bm25_topk(spark, SF).count() == 10 * spark.read.parquet(f"{SF}/benchmark.parquet").count()


def test_passages(spark):
    docs = [(1, "one two three four five"), (2, "Two, THREE; four"), (3, "three two"), (4, None), (5, "five six one two"), (6, "two"), (7, "two three five")]
    items = [(10, "one two three four"), (11, "two"), (12, ""), (13, "two three"), (14, "nowhere else")]
    units, asked = spark.createDataFrame(docs, "unit long, text string"), spark.createDataFrame(items, "q long, text string")
    found = streamed.passages(units, asked, 3)
    assert sorted(map(tuple, found.collect())) == [(10, 1), (10, 2), *((11, u) for u in (1, 2, 3, 5, 6, 7)), *((13, u) for u in (1, 2, 7))]
    assert streamed.passages(units, asked.limit(0), 3).collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize(("char_mode", "block", "frequent", "group"), [(False, 1024, 1 << 16, 1 << 23), (False, 2, 0, 3), (True, 3, 4, 5)])
def test_tfidf_is_that_of_the_tables(spark, monkeypatch, char_mode, block, frequent, group):
    for name, value in (("QUERIES", block), ("FREQUENT", frequent), ("GROUP", group)):
        monkeypatch.setattr(streamed, name, value)
    units, asked = frames(spark)
    units = units.unionByName(spark.createDataFrame([("s", f"m{i}", f"heaps of {'trees ' * i} and 😀中文 {i} items") for i in range(6)], units.schema)).where("unit is not null")
    rows = lambda df: sorted((r.q, r["rank"], r.unit, round(r.score, 9)) for r in df.collect())
    want = rows(retrieval.top_k(retrieval.tfidf_scores(units, asked, char_mode), 3))
    assert len(want) > 5 and rows(retrieval.tfidf(units.repartition(3), asked, 3, char_mode)) == want
    assert retrieval.tfidf(units.limit(0), asked, 3, char_mode).collect() == []


def test_tfidf_query_makes_no_index(spark, monkeypatch):
    monkeypatch.setattr(rq.index, "written", lambda *a, **b: pytest.fail("an index of all terms"))
    monkeypatch.setattr(rq.index, "tfidf_tables", lambda *a, **b: pytest.fail("a row for each gram of a unit"))
    assert rq.tfidf_word_topk(spark, SF).count() and rq.tfidf_char_topk(spark, SF).count()


def test_mmr_makes_no_index(spark, monkeypatch):
    """Candidates are reordered without a row for each gram of all units; equal texts are equal, blocks and odd rows change nothing."""
    monkeypatch.setattr(rq.index, "tfidf_tables", lambda *a, **b: pytest.fail("a row for each gram of a unit"))
    assert rq.mmr_pipeline(spark, SF).count()
    units, asked = frames(spark)
    units = units.unionByName(spark.createDataFrame([("s", f"m{i}", f"heaps of {'trees ' * (i % 4)} and items") for i in range(8)], units.schema)).withColumn("page", F.ascii("unit"))
    rows = lambda mode: sorted(map(tuple, retrieval.tfidf_pipeline(units.repartition(3), asked, 2, mode).selectExpr("q", "rank", "unit", "page", "round(score, 9)").collect()))
    whole = {mode: rows(mode) for mode in ("word", "char")}
    assert {r[0] for r in whole["word"]} == {1, 2, 3} and all(r[2] is not None for r in whole["word"])
    monkeypatch.setattr(streamed, "QUERIES", 2)
    assert {mode: rows(mode) for mode in ("word", "char")} == whole
    assert retrieval.tfidf_pipeline(units, asked.limit(0), 2).collect() == [] == retrieval.tfidf_pipeline(units.limit(0), asked, 2).collect()


@pytest.mark.parametrize(("block", "shard"), [(1024, 1 << 20), (2, 3)])
def test_packed_index(spark, monkeypatch, tmp_path, block, shard):
    """An index whose postings are packed by shard finds what a plain search finds, and neither its postings nor (q, unit) pairs are shuffled one by one."""
    from marginalia.operators import index

    monkeypatch.setattr(streamed, "QUERIES", block)
    monkeypatch.setattr(index, "SHARD", shard)
    monkeypatch.setattr(index, "postings", lambda *a, **b: pytest.fail("a row for each term of a unit"))
    monkeypatch.setattr(index, "tfidf_tables", lambda *a, **b: pytest.fail("tables that no one asked for"))
    units, asked = frames(spark)
    tables = index.opened(units.repartition(2), str(tmp_path), units, ("bm25",))
    assert set(tables) == {"bm25", "meta"}
    seen = lambda df: [(r.q, r.unit, round(r.score, 6), r["rank"]) for r in df.orderBy("q", "rank").collect()]
    found = retrieval.bm25_hits(tables["bm25"], asked, 2)
    assert seen(retrieval.top_k(found, 2)) == plain_bm25(2) and seen(retrieval.top_k(retrieval.bm25_hits(tables["bm25"], asked), 9)) == plain_bm25(9)
    assert set(re.findall(r"hashpartitioning\((\w+)#", found._jdf.queryExecution().executedPlan().toString())) <= {"shard"}
    assert retrieval.bm25_hits(tables["bm25"], asked.limit(0), 2).collect() == []


def test_index_kinds_are_made_when_asked_for(spark, tmp_path):
    from marginalia.operators import index

    units, asked = frames(spark)
    units, path = units.where("unit is not null"), str(tmp_path / "index")
    index.written(units, path, kinds=("bm25",))
    assert not (tmp_path / "index" / "tfidf").exists()
    tables = index.opened(units, path)
    assert tables["tfidf"].count() and retrieval.tfidf_hits(tables["tfidf"], tables["idf"], asked).count()
    other = units.withColumn("text", F.lit("heaps only"))
    index.opened(other, path, kinds=("bm25",))
    assert not (tmp_path / "index" / "tfidf").exists()
    assert index.opened(other, path)["tfidf"].select("term").distinct().count() == 3


@pytest.mark.parametrize("few", [200_000, 1])
def test_reranking_shuffles_texts_of_hits_only(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW", few)
    units, asked = frames(spark)
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "g", 3), (2, "d", 1)], "q int, unit string, rank int")
    found = retrieval.reranked(hits, asked, units.select("unit", "text"), 2, pool=2)
    assert sorted((r.q, r["rank"], r.unit, r.score) for r in found.collect()) == [(1, 1, "b", 1.0), (1, 2, "a", 0.5), (2, 1, "d", 1.0)]
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
