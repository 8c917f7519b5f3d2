"""The registry of retrievers and the encoder plug."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import index, retrieval, retrievers

TEXTS = ["heaps are trees", "queues hold items", "a heap keeps its least item first", "graphs have edges", "edges join nodes of graphs"]


@pytest.mark.parametrize(
    ("name", "want"),
    [("bm25_raw", ("bm25_raw", None)), ("bm25_raw@150", ("bm25_raw", "150")), ("hybrid_rrf+reranker@150o40", ("hybrid_rrf+reranker", "150o40")), ("bge_m3_dense@90o0", ("bge_m3_dense", "90")),
     ("tfidf_raw@150", None), ("bm25_raw@0", None), ("bm25_raw@x", None), ("bm25_raw@", None), ("other", None), ("", None)],
)
def test_names(name, want):
    assert retrievers.parsed(name) == want


def test_every_retriever(spark, tmp_path):
    units = spark.createDataFrame([("d", i, t, i // 2) for i, t in enumerate(TEXTS)], "scope string, unit int, text string, page int")
    index.written(units, str(tmp_path))
    vectors = units.select("unit", retrievers.encoded(F.col("text")).alias("v"))
    corpora = {key: retrievers.Corpus(units, index.opened(units, str(tmp_path)), vectors) for key in (None, "100")}
    questions = spark.createDataFrame([(7, "d", "graphs edges"), (8, "d", " ")], "q int, scope string, text string")
    encode = lambda qs: qs.select("q", retrievers.encoded(F.col("text")).alias("qv"))
    for name in (*retrievers.WORD_BASED, *retrievers.VECTOR_BASED, "bm25_raw@100"):
        rows = retrievers.retriever_for(name, corpora, encode)(questions, 2).where("q = 7").orderBy("rank").collect()
        assert rows and rows[0].page in (1, 2) and len({r.page for r in rows}) == len(rows) <= 2, name
    assert retrievers.retriever_for("bm25_raw@90", corpora, encode) is None
    assert retrievers.retriever_for("other", corpora, encode) is None


def test_folders_of_terms(spark, tmp_path):
    units = spark.createDataFrame([("d", i, t) for i, t in enumerate(TEXTS)], "scope string, unit int, text string")
    index.written(units, str(tmp_path / "some"))
    tables = index.opened(units, str(tmp_path / "some"))
    questions = spark.createDataFrame([(7, "d", "graphs edges")], "q int, scope string, text string")
    plain, dealt = retrieval.bm25_scores(units, questions), retrieval.bm25_hits(tables["bm25"], questions)
    assert sorted((r.unit, round(r.score, 9)) for r in dealt.collect()) == sorted((r.unit, round(r.score, 9)) for r in plain.collect())
    assert "dynamicpruning" in dealt._jdf.queryExecution().toString()
    plain, dealt = retrieval.tfidf_scores(units, questions), retrieval.tfidf_hits(tables["tfidf"], tables["idf"], questions)
    assert sorted((r.unit, round(r.score, 9)) for r in dealt.collect()) == sorted((r.unit, round(r.score, 9)) for r in plain.collect())
    none = units.limit(0)
    index.written(none, str(tmp_path / "none"))
    assert retrieval.bm25_hits(index.opened(none, str(tmp_path / "none"))["bm25"], questions).collect() == []


def test_encoder(spark):
    seen = lambda: lambda texts: np.array([[len(t.split()), 0.0] for t in texts])
    rows = spark.createDataFrame([(0, "w " * 600), (1, None), (2, "")], "id int, text string")
    cut = {r.id: r.v for r in rows.select("id", retrievers.encoded(F.col("text"), seen).alias("v")).collect()}
    assert cut == {0: [1.0, 0.0], 1: [0.0, 0.0], 2: [0.0, 0.0]}
    counts = lambda: lambda texts: np.array([[len(t.split()), 512.0] for t in texts])
    assert rows.where("id = 0").select(retrievers.encoded(F.col("text"), counts).alias("v")).head().v == pytest.approx([2**-0.5] * 2)
    assert rows.limit(0).select(retrievers.encoded(F.col("text")).alias("v")).collect() == []
