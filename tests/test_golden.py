"""Hand-computed rows and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions import udfs
from marginalia.operators import chunking, cleaning, evaluation, retrieval, rollup, study
from marginalia.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def hits(spark, names, q=1):
    return spark.createDataFrame([(q, u, 1.0, i) for i, u in enumerate(names, 1)], "q int, unit string, score double, rank int")


def test_rrf(spark):
    rows = retrieval.rrf(hits(spark, "ABC"), hits(spark, "CAD"), 10).orderBy("rank").collect()
    assert [(r.unit, round(r.score, 5)) for r in rows] == [("A", 0.03252), ("C", 0.03227), ("B", 0.01613), ("D", 0.01587)]


def bm25(spark, docs, query):
    units = spark.createDataFrame([("s", i, t) for i, t in enumerate(docs, 1)], "scope string, unit int, text string")
    return {r.unit: round(r.score, 6) for r in retrieval.bm25(units, spark.createDataFrame([(1, "s", query)], "q int, scope string, text string")).collect()}


def test_bm25(spark):
    assert bm25(spark, ["a b", "a c", "b d d"], "b d") == {1: 0.433321, 3: 1.796710}
    assert bm25(spark, ["a", "a b"], "a") == {}
    assert bm25(spark, ["a", "a b"], "  ") == {}


def test_sentences():
    assert udfs.sentences("Dr. Smith left. It was 3 p.m. Bye!", "en") == ["Dr. Smith left.", "It was 3 p.m.", "Bye!"]
    assert udfs.sentences("你好。再见！", "zh") == ["你好。", "再见！"]
    assert udfs.sentences(None, "en") == []


def test_pack_and_cuts():
    assert chunking.packed([4, 5, 3, 9, 2], 10, 1) == [[0, 1], [1, 2], [3], [4]]
    assert chunking.cut([40, 30, 50, 60, 20, 70], 2) == [(0, 3), (3, 6)]
    assert chunking.cut([50] * 6, 3, 50) == [(0, 3), (2, 4), (3, 6)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(20, 120), st.sampled_from([0, 10]))
def test_child_ranges(sizes, words, overlap):
    ranges = chunking.child_ranges(sizes, words, overlap)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(sizes)
    for (a, b), (c, d) in zip(ranges, ranges[1:]):
        assert a < b and c < d and a < c <= b < d + 1
        assert overlap or b == c
    assert len(ranges) == len(sizes) or all(b - a == 1 or sum(sizes[a:b]) <= words for a, b in ranges)


def test_mmr():
    sims = np.array([[1, 0.95, 0.1], [0.95, 1, 0.2], [0.1, 0.2, 1]])
    assert retrieval.mmr_order(np.array([0.9, 0.8, 0.7]), sims, 3) == [0, 2, 1]


def test_text(spark):
    assert one(spark, tx.dehyphenated(F.lit("exam-\nple"))) == "example"
    assert one(spark, tx.joined_cjk(F.lit("中 文 a b"))) == "中文 a b"
    assert one(spark, tx.without_urls(F.lit("see http://x.y/z now"))) == "see  now"
    assert one(spark, tx.without_controls(F.lit("a\u00adb\n\tc\x07"))) == "ab\n\tc"
    assert one(spark, tx.clean_page(F.lit(None).cast("string"))) == ""
    assert one(spark, tx.tidied(F.lit("a  b"))) == "a  b"
    assert one(spark, tx.parsed_groups(F.lit("508 | 509 | 516 518"))) == [[508], [509], [516, 518]]
    assert one(spark, tx.page_list(F.array(F.lit(7), F.lit(3), F.lit(7)))) == "p.3, p.7"
    assert (one(spark, tx.unit_words(F.lit("150o40"))), one(spark, tx.unit_overlap(F.lit("150o40"))), one(spark, tx.unit_name(F.lit(128), F.lit(0)))) == (150, 40, "128")
    with pytest.raises(Exception, match="not a child set"):
        one(spark, tx.unit_words(F.lit("x")))
    assert one(spark, tx.tokens(F.lit("Ab 中文 d"))) == ["ab", "中", "文", "d"]
    assert one(spark, tx.is_zh_page(F.lit("中文abcdefghij"))) is True


def test_repeated_lines_of_one_page(spark):
    pages = spark.createDataFrame([("d", 1, "Head\nbody one\nbody two\nFoot")], "doc_id string, page_no int, text string")
    assert cleaning.without_repeated_lines(pages).first()["text"] == ""


def test_collapse(spark):
    rows = [(251, 0.989), (251, 0.733), (254, 0.661), (252, 0.640), (251, 0.439), (249, 0.321), (654, 0.301)]
    children = spark.createDataFrame([(1, f"c{i}", p, p, s, i) for i, (p, s) in enumerate(rows, 1)], "q int, unit string, parent int, page int, score double, rank int")
    assert [r.unit for r in retrieval.collapsed_parents(children, 5).orderBy("rank").collect()] == [251, 254, 252, 249, 654]


def test_spread_and_merge(spark):
    rows = spark.createDataFrame([("k", i) for i in range(10)], "key string, i int")
    assert sorted(r.i for r in study.spread(rows, "key", "i", 4).collect()) == [0, 2, 5, 7]
    made = lambda s: spark.createDataFrame([(1, u, i) for i, u in enumerate(s)], "q int, unit string, pos int")
    assert "".join(r.unit for r in study.merged_context(made("abcde"), made("bfg")).orderBy("pos").collect()) == "abcfg"


def test_ranks(spark):
    def ranks(ranking, groups):
        first, full = evaluation.hit_ranks(F.array(*map(F.lit, ranking)), F.array(*(F.array(*map(F.lit, g)) for g in groups)))
        return one(spark, first), one(spark, full)

    assert ranks([9, 3, 7], [[3], [7, 8]]) == (2, 3)
    assert ranks([9, 3], [[3], [7]]) == (2, 0)


def test_kappa(spark):
    rows = [(1, 1)] * 40 + [(1, 0)] * 10 + [(0, 1)] * 5 + [(0, 0)] * 45
    k = evaluation.kappa(spark.createDataFrame(rows, "a int, b int")).first()
    assert (round(k.po, 2), round(k.pe, 2), round(k.kappa, 2)) == (0.85, 0.5, 0.7)


def test_quiz_labels(spark):
    options = F.array(F.lit("A. x"), F.lit("B. y"))
    assert one(spark, study.mcq_label(options, F.lit("b"))) == "B. y"
    assert one(spark, study.mcq_label(options, F.lit("Z"))) == "Z"
    assert one(spark, study.valid_question(F.lit("mcq"), F.array(*map(F.lit, "abcd")), F.lit(""))) is True


def test_salvage():
    assert udfs.salvaged('```json\n{"t": {"a": "\\x"}}\n```') == {"a": "\\x"}
    assert udfs.salvaged("no object") is None


def test_windows(spark):
    pages = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([5, 5, 9, 20, 1], 1)], "doc_id string, page_no int, text string")
    assert [(r.start, r.end) for r in rollup.windows(pages, 10).orderBy("start").collect()] == [(1, 2), (3, 3), (4, 4), (5, 5)]


def test_rules_and_titles(spark):
    schema = "doc_id string, start int, end int, key_points array<struct<text:string,page:int>>, key_terms array<string>, toc_title string, llm_title string, main_idea string"
    s = spark.createDataFrame([("d", 3, 5, [("a", 9), ("b", 4)], [], "", None, "m")], schema)
    assert rollup.rule_issues(s).first()["issues"] == ["fewer than 3 key points", "pages outside the section: 9", "no key terms"]
    assert rollup.section_rollup(s).first()["sections"][0]["title"] == "Pages 3-5"


def test_upsert_and_questions(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, tables.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
    (tmp_path / "q.jsonl").write_text('{"id": "1", "doc_id": "abcdefghij"}\n\n{"id": "2", "excluded": true}\n')
    assert [(r.id, r.doc) for r in tables.questions(spark, str(tmp_path / "q.jsonl")).collect()] == [("1", "abcdefgh")]


def test_upserting_stream(spark, tmp_path):
    from marginalia.streaming import progress

    write = progress.merged_into(f"file://{tmp_path}/t", ["k"])
    write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    write(spark.createDataFrame([(2, "c")], "k int, v string"), 1)
    write(spark.createDataFrame([(2, "c")], "k int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t/v1").collect())) == [(1, "a"), (2, "c")]
