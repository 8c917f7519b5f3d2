"""Stores, indexes, ingest, sinks and MMR against plain versions and half-finished writes."""

import math
import re
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import index, ingest, retrieval
from marginalia.sources import store, tables
from marginalia.streaming import progress

from .conftest import SF

CHUNKS = [("a1", "a", 1, 0, "one"), ("a2", "a", 1, 1, "two"), ("b1", "b", 1, 0, "three")]


def chunks(spark, rows):
    return spark.createDataFrame(rows, tables.CHUNK)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "doc_id string")


def held(spark, path, name="chunks", schema=tables.CHUNK):
    return sorted(r.chunk_id for r in store.current(spark, path, name, schema).collect())


def test_replacement_shows_at_once_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "store")
    cards = spark.createDataFrame([(c, d, "t", "x") for c, d, *_ in CHUNKS], tables.CARD)
    store.put(path, ids(spark, "a", "b"), {"chunks": chunks(spark, CHUNKS), "cards": cards})
    # A write that dies after the first table: nothing of it shows.
    chunks(spark, [("a9", "a", 1, 0, "half")]).withColumn("version", F.lit(1).cast("long")).write.mode("append").parquet(f"{path}/chunks")
    assert held(spark, path) == ["a1", "a2", "b1"] == held(spark, path, "cards", tables.CARD)
    shutil.rmtree(f"{path}/chunks/_temporary", ignore_errors=True)
    store.replaced_content(path, ids(spark, "a"), chunks(spark, [("a1", "a", 1, 0, "one"), ("a2", "a", 1, 1, "changed"), ("a3", "a", 2, 0, "new")]), {})
    assert held(spark, path, "cards", tables.CARD) == ["a1", "b1"]
    assert [c for c in held(spark, path) if c != "a9"] == ["a1", "a2", "a3", "b1"]
    store.put(path, ids(spark, "b"), {"chunks": chunks(spark, [])})
    assert "b1" not in held(spark, path)
    store.compacted(spark, path, "chunks", tables.CHUNK, str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == len(held(spark, path))


def test_index_is_made_anew_for_other_texts(spark, tmp_path):
    units = spark.createDataFrame([("s", 1, "a b"), ("s", 2, "a c"), ("s", 3, "b d d")], "scope string, unit int, text string")
    asked = spark.createDataFrame([(1, "s", "b d")], "q int, scope string, text string")
    path = str(tmp_path / "index")
    find = lambda u: {r.unit: round(r.score, 6) for r in retrieval.bm25_hits(index.opened(u, path)["bm25"], asked).collect()}
    assert find(units) == find(units) == {1: 0.433321, 3: 1.796710}
    assert set(find(units.withColumn("text", F.regexp_replace("text", "d", "b")))) == {1, 3}
    shutil.rmtree(f"{path}/meta")
    assert find(units) == {1: 0.433321, 3: 1.796710}
    index.forgotten(spark, path)
    assert not (tmp_path / "index").exists()


def test_ingest(spark, tmp_path):
    rows = [("d", n, f"Head\nPage {n} says something here about cats. It goes on for a while.\nFoot") for n in (1, 2, 3, 4, 6)] + [("d", 5, None), ("e", 1, None), ("e", 2, " ")]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text_raw string")
    path = str(tmp_path / "store")
    found = {r.doc_id: (r.num_pages, r.num_chunks, r.language, r.ocr_required, r.error) for r in ingest.ingested(pages, path).collect()}
    assert found == {"d": (6, 5, "en", False, None), "e": (2, 0, None, True, "no text found in this scan")}
    kept = store.current(spark, path, "chunks", tables.CHUNK).collect()
    assert len(kept) == 5 and not any("Head" in r.text or "Foot" in r.text for r in kept)
    assert store.current(spark, path, "children", ingest.CHILD).count() == 5
    ingest.ingested(pages, path, most=5)
    assert store.current(spark, path, "pages", tables.PAGE).count() == 5 and store.current(spark, path, "chunks", tables.CHUNK).count() == 4
    read = spark.createDataFrame([("e", 1, "read")], "doc_id string, page_no int, text_raw string")
    assert {(r.page_no, r.text_raw) for r in ingest.with_ocr(pages.where("doc_id = 'e'"), read).collect()} == {(1, "read"), (2, " ")}


def test_half_written_version_is_written_again(spark, tmp_path):
    write = progress.merged_into(f"file://{tmp_path}/t", ["k"], "n")
    write(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, n int"), 0)
    (tmp_path / "t" / "v1" / "_temporary").mkdir(parents=True)
    write(spark.createDataFrame([(2, "c", 1)], "k int, v string, n int"), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t/v1").collect())) == [(1, "b", 2), (2, "c", 1)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gbk"])
def test_csv_encodings(spark, tmp_path, encoding):
    (tmp_path / "x.csv").write_bytes("name,n\n中文,1\n".encode(encoding))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "x.csv"), "name string, n int").collect()] == [("中文", 1)]
    tables.write_csv(spark.createDataFrame([("中文", 1)], "name string, n int"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfname,n")


def test_mmr_pipeline_is_the_plain_one(spark):
    """Selection by idf-weighted rows of the index, recomputed with lists."""
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    asked = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def grams(text):
        w = [t for t in re.findall(r"[^\W_]+", text.lower()) if len(t) >= 2]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    counts = {u: grams(t) for u, t in texts}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}

    def row(c):
        raw = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else {}

    rows = {u: row(c) for u, c in counts.items()}
    dot = lambda a, b: sum(v * b.get(t, 0.0) for t, v in a.items())
    units = spark.createDataFrame([("s", u, t, u + 1) for u, t in texts], "scope string, unit long, text string, page long")
    qs = spark.createDataFrame([(q, "s", t) for q, t in asked], "q long, scope string, text string")
    found = {}
    for r in retrieval.tfidf_pipeline(units, qs, 10).collect():
        found.setdefault(r.q, []).append((r["rank"], r.unit))
    for q, t in asked:
        own = row(grams(t))
        scores = sorted(((round(s, 6), u, s) for u in rows if (s := dot(own, rows[u])) > 0), key=lambda x: (-x[0], x[1]))[:50]
        some = [(u, s) for _, u, s in scores if s >= 0.08]
        sims = np.array([[dot(rows[a], rows[b]) if a != b else 0.0 for b, _ in some] for a, _ in some]).reshape(len(some), len(some))
        order = retrieval.mmr_order(np.array([s for _, s in some]), sims, 30)
        assert [u for _, u in sorted(found.get(q, []))] == [some[i][0] for i in order][:10]


def test_entry_without_the_corpus_operators(tmp_path):
    """The entry module and its queries load when the corpus operators and their pipeline are not there."""
    import os
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for keep_pipeline in (True, False):
        to = tmp_path / str(keep_pipeline)
        shutil.copytree(here, to, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'bm25_topk' in q and set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
        subprocess.run([sys.executable, "-c", code], cwd=to, check=True)
