"""Language-model steps: prompts, checked and repeated replies, and what becomes of replies that never fit."""

import json

import pandas as pd
from pyspark.sql import functions as F

from marginalia.operators import study, tasks


def rows(spark, *prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string")


def test_prompt_leaves_blank_parts_out(spark):
    got = spark.range(1).select(tasks.prompt("answer", F.lit("zh"), F.lit("[p.1] x"), question=F.lit("why"), notes=F.lit(" "), more=F.lit(None)).alias("p")).head().p
    assert got == f"{tasks.STEPS['answer'].order}\n\nWrite in Chinese.\n\nQuestion:\nwhy\n\nPages:\n[p.1] x"
    assert tasks.blocks(got + "\n\n[p.2] y\nz") == [(1, "x"), (2, "y\nz")]
    assert tasks.blocks("no pages") == []


def test_replies_are_repaired_and_asked_again(spark):
    def model(step, prompts):
        def one(p):
            if p == "fenced":
                return '```json\n{"answer": "a \\lg b", "pages": ["2", 3.0], "found": "True"}\n```'
            return "no" if p == "bad" else json.dumps({"answer": p, "pages": [], "found": False})

        return prompts.map(one)

    got = {r.id: r.reply for r in tasks.replied(rows(spark, "fenced", "bad", "ok", None), "answer", model).collect()}
    assert (got[0].answer, got[0].pages, got[0].found) == ("a \\lg b", [2, 3], True)
    assert got[1] is None and got[3] is None and got[2].answer == "ok"


def test_only_unusable_rows_are_asked_again(spark):
    def model(step, prompts):
        # The second call sees only what failed in the first.
        alone = len(prompts) == 1
        return prompts.map(lambda p: json.dumps({"summary": f"{p} {alone}"}) if alone or p != "late" else "{}")

    got = [r.reply.summary for r in tasks.replied(rows(spark, "soon", "late", "soon").coalesce(1), "fold", model).orderBy("id").collect()]
    assert got == ["soon False", "late True", "soon False"]


def test_schema_limits(spark):
    from pyspark.sql.types import DataType

    quiz = DataType.fromDDL(tasks.STEPS["quiz"].schema)
    question = {"id": "q", "type": "mcq", "concept": "c", "question": "?", "answer": "A", "page": 1}
    assert json.loads(tasks.usable(json.dumps({"questions": [question]}), quiz))["questions"][0]["options"] is None
    assert tasks.usable(json.dumps({"questions": [question | {"type": "essay"}]}), quiz) is None
    assert tasks.usable(json.dumps({"questions": [question | {"page": True}]}), quiz) is None
    assert tasks.usable(json.dumps({"questions": "none"}), quiz) is None
    assert tasks.usable(None, quiz) is None and tasks.usable("", quiz) is None


def test_route_decisions(spark):
    schema = "id int, reply struct<intent: string, scope: string, follow_up: boolean, topic: string>, button string, subject string, context boolean"
    told = [
        (0, ("ask", "topic", True, " heaps "), None, "s", True),
        (1, ("ask", "topic", True, ""), "quiz", "s", False),
        (2, ("quiz", "document", True, "x"), None, "s", True),
        (3, ("quiz", "document", False, ""), "summary", "", True),
        (4, ("flashcard", "document", False, ""), None, "", True),
    ]
    out = spark.createDataFrame(told, schema).select("id", tasks.decided(F.col("reply"), F.lit("msg"), F.col("button"), F.col("subject"), F.col("context")).alias("d")).orderBy("id").collect()
    assert [tuple(r.d) for r in out] == [("ask", "topic", True, "heaps"), ("quiz", "topic", False, "msg"), ("quiz", "document", False, "s"), ("summary", "document", False, "msg"), ("flashcard", "document", False, "the whole document")]


def test_texts(spark):
    sections = F.array(F.struct(F.lit("T").alias("title"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("idea").alias("main_idea")))
    none = F.lit(None).cast("array<struct<title: string, start: int, end: int, main_idea: string>>")
    answer = F.struct(F.lit("a").alias("answer"), F.array(F.lit(3), F.lit(1), F.lit(3)).alias("pages"), F.lit(True).alias("found"))
    row = spark.range(1).select(
        tasks.document_text(F.lit("S"), F.lit("O"), sections, F.lit(True)).alias("made"),
        tasks.document_text(F.lit("S"), F.lit("O"), none, F.lit(True)).alias("building"),
        tasks.document_text(F.lit("S"), F.lit("O"), none, F.lit(False)).alias("missing"),
        tasks.answer_text(answer).alias("answer"),
        F.lit(tasks.failure_text("quiz")).alias("failure"),
    ).head()
    assert row.made == "S\n\nO\n\n- T (p.1-2): idea"
    assert row.building != row.missing and "built" in row.building
    assert row.answer == "a\n\n(Source: p.1, p.3)"
    assert row.failure == "No usable quiz reply after 3 tries"
    assert tasks.provider(spark) == {"provider": "extractive", "model": "extractive"}


def test_quiz_drops_and_renumbers(spark):
    def model(step, prompts):
        q = {"id": "q9", "concept": "c", "question": "?", "page": 1}
        asked = [q | {"type": "mcq", "options": ["A. a"], "answer": "A"}, q | {"type": "mcq", "options": list("ABCD"), "answer": "b"}, q | {"type": "short", "answer": " "}, q | {"type": "short", "answer": "x"}]
        return prompts.map(lambda p: json.dumps({"questions": asked}))

    out = tasks.replied(rows(spark, "p"), "quiz", model).select(tasks.valid_questions(F.col("reply")).alias("q")).head().q
    assert [(q.id, q.type) for q in out] == [("q1", "mcq"), ("q2", "short")]
    text = tasks.replied(rows(spark, "p"), "quiz", model).select(tasks.quiz_text(tasks.valid_questions(F.col("reply")), F.lit(2)).alias("t")).head().t
    assert text == "Quiz round 2:\n\nq1. ?\n   A\n   B\n   C\n   D\n\nq2. ?"


def messages(spark, n):
    return spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(n)], "conv_id long, turn long, role string, text string")


def test_folds(spark):
    state = spark.createDataFrame([], "conv_id long, summary string, upto long")
    assert tasks.folded(messages(spark, 11), state).collect() == []
    first = tasks.folded(messages(spark, 12), state).collect()
    assert [(r.conv_id, r.upto) for r in first] == [(1, 8)] and first[0].summary.split("\n")[-1] == "- Assistant: m7"
    later = spark.createDataFrame([(1, "so far", 8)], "conv_id long, summary string, upto long")
    assert tasks.folded(messages(spark, 19), later).collect() == []
    assert tasks.folded(messages(spark, 20), later).head().summary.startswith("so far\n- User: m8")
    failed = tasks.folded(messages(spark, 20), later, lambda step, p: pd.Series("?", index=p.index)).head()
    assert (failed.summary, failed.upto) == ("so far", 8)


def test_judged_by_chunks(spark):
    told = spark.createDataFrame([(1, "Heaps are trees. Made up.", "[p.1] Heaps are trees. More."), (2, None, "[p.1] x")], "id long, answer string, pages string")
    got = {r.id: (r.claims, r.verdicts) for r in tasks.judged_by_chunks(told).collect()}
    assert got == {1: (["Heaps are trees.", "Made up."], ["yes", "idk"]), 2: ([], None)}


def test_missing_replies(spark):
    none = lambda step, p: pd.Series(None, index=p.index, dtype=object)
    over = tasks.replied(rows(spark, "p"), "overview", none)
    subject, overview = tasks.overview_or(F.col("reply"), F.lit("f.pdf"))
    assert tuple(over.select(subject, overview).head()) == ("f.pdf", "")
    checked = tasks.replied(rows(spark, "p"), "faithful", none)
    assert checked.select(tasks.faithfulness_issues(F.col("reply")).alias("i")).head().i == []


def test_history_from(spark):
    assert [r.turn for r in study.history_from(messages(spark, 4), F.lit(3)).collect()] == [3]
    assert study.history_from(messages(spark, 4), F.lit(4)).collect() == []
