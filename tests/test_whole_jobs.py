"""Queries do the whole job: every row they are asked about, and the whole of its text."""

from marginalia.operators import retrieval
from marginalia.plans import catalogue
from marginalia.plans import retrieval_queries as rq

from .conftest import SF
from .test_catalogue import shown


def equal(spark, duck, name, sql):
    """Whether a query returns the rows of the SQL, as the catalogue's test compares them."""
    df, found = catalogue.queries()[name](spark, SF), duck.sql(sql)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    return sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())


def dense_of(asked):
    """The search's SQL for a set of queries."""
    return rq.dense_sql(asked)


def test_dense_queries(spark, duck):
    assert equal(spark, duck, "dense_topk", f"WITH {dense_of('a.vec_id % 50 = 0')} SELECT {rq.SHOWN} FROM dnr WHERE rank <= 10")


def test_dense_blocks(spark, monkeypatch):
    whole = rq.shown(retrieval.dense(*rq.vectors(spark, SF), 10)).collect()
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    vectors, queries = rq.vectors(spark, SF)
    assert sorted(rq.shown(retrieval.dense(vectors, queries, 10)).collect()) == sorted(whole)
    assert retrieval.dense(vectors, queries.limit(0), 10).collect() == []


def test_hybrid_items(spark, duck):
    dense = dense_of("a.vec_id IN (SELECT item_id FROM benchmark)")
    assert equal(spark, duck, "hybrid_rrf", f"WITH {rq.BM25}, {dense}, {rq.RRF} SELECT {rq.SHOWN} FROM fr WHERE rank <= 10")


def documents(spark, folder, texts):
    """A folder whose documents have these texts."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_noise_of_whole_texts(spark, duck, tmp_path):
    long = "word " * 50
    texts = ["a . . . . . . 9\nbody", "(continues on next page)", "x ↩→ y  z", long + "\nb . . . . . . 7", long, None, long + "\n(continued from previous page)", "plain"]
    folder = documents(spark, tmp_path, texts)
    rows = {r.doc_id: (r.new_text, r.action) for r in catalogue.queries()["noise_diff"](spark, folder).collect()}
    assert rows == {0: ("a 9\nbody", "update"), 1: ("", "delete"), 2: ("x y z", "update"), 3: (f"{long}\nb 7", "update"), 6: (long.strip(), "update")}
    duck.execute(f"create or replace temp view documents as from '{folder}/documents.parquet/*.parquet'")
    try:
        assert len(duck.sql(catalogue.oracle_sql()["noise_diff"]).fetchall()) == 5
    finally:
        duck.execute("drop view temp.documents")
    assert equal(spark, duck, "noise_diff", catalogue.oracle_sql()["noise_diff"])


def test_answer_keys_of_whole_texts(spark, duck, tmp_path):
    folder = documents(spark, tmp_path, ["Ab, " * 40 + "one", "Ab, " * 40 + "Two!", None])
    keys = {r.doc_id: r.answer_key for r in catalogue.queries()["text_scalars"](spark, folder).collect()}
    assert keys == {0: "ab" * 40 + "one", 1: "ab" * 40 + "two", 2: None}
    assert equal(spark, duck, "text_scalars", catalogue.oracle_sql()["text_scalars"])
