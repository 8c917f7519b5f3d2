"""Stages judge rows, also where ids are null or repeated."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(start, n=40):
    return " ".join(f"w{start + i}" for i in range(n))


def table(spark, folder, rows):
    path = f"{folder}/documents.parquet"
    spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def sources(df):
    return sorted(r.source for r in df.collect())


def test_dedup(spark, tmp_path):
    one, two, three = words(0), words(1000), words(2000)
    rows = [
        (1, one, "a"), (2, one, "copy"), (2, two, "same id as a copy"),
        (3, three, "x"), (3, three, "x"), (3, three, "x"),
        (None, words(3000), "null pair"), (None, words(3000), "null pair"), (None, words(4000), "null alone"),
        (None, one, "null copy"), (5, None, "no text"), (5, " ", "blank"), (None, None, "nothing"),
    ]
    after = corpus_pipeline.dedup_stage(spark, table(spark, tmp_path, rows), str(tmp_path))
    assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sources(after) == sorted(["a", "same id as a copy", "x", "null pair", "null alone", "no text", "blank", "nothing"])


def test_decontamination(spark, tmp_path):
    item = words(0, 12)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = f"{words(500)} {item} {words(600)}"
    rows = [
        (1, bad, "bad"), (1, words(1000), "same id"), (None, bad, "null bad"), (None, words(2000), "null clean"), (None, None, "nothing"),
        (2, bad, "bad"), (2, bad, "bad"), (3, words(3000), "clean"), (3, words(3000), "clean"), (1, None, "no text"),
    ]
    after = corpus_pipeline.decontamination_stage(spark, table(spark, tmp_path, rows), str(tmp_path))
    assert sources(after) == sorted(["same id", "null clean", "nothing", "clean", "clean", "no text"])


def odd_folder(spark, folder, rows):
    """Documents with columns whose names clash with those inside, labels and a benchmark."""
    from pyspark.sql import functions as F

    docs = table(spark, folder, rows).withColumns({"row": F.lit(1), "hash": F.lit("x"), "node": F.lit(2), "length": F.lit("y"), "_rid2": F.lit(0)})
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, words(0, 12)), (1, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_every_stage_takes_odd_rows(spark, tmp_path):
    long = words(0, 30_000)
    rows = [(1, words(7000), "a"), (2, "!!! ### !!!", "b"), (3, f"mail a.b@c.org {words(8000)}", "c"), (4, "b b b b b b b b", "d"), (None, None, "e"), (None, "", "f"), (5, " ", "g"), (6, long, "h"), (6, long, "i"), (1, words(9000), "j")]
    docs = odd_folder(spark, tmp_path, rows)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        found = after.collect()
        if name != "packing":
            assert after.columns == docs.columns, name
            assert {r.source for r in found} <= {s for _, _, s in rows}, name
        if name == "near_dedup":
            assert sources(after) == sorted("abcdefghj")
        if name == "decontamination":
            assert sources(after) == sorted("abcdefgj")
        if name == "pii":
            assert sources(after) == sorted("abcdefghij") and [r.text for r in found if r.source == "c"] == [f"mail [EMAIL] {words(8000)}"]
        if name == "packing":
            assert sum(r.piece == 0 for r in found) == len(rows)


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    docs = odd_folder(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
