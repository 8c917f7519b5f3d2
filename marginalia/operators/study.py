"""Session logic over rows: routing, grading, mastery, context budgets, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def route_message(intent: Column, scope: Column, has_context: Column, button: Column | None = None) -> Column:
    """The next step of a message: a button overrides the routed intent; follow-ups with context need no new search."""
    chosen = intent if button is None else F.coalesce(button, intent)
    return (
        F.when((chosen == "summary") & (scope == "document"), "document_summary")
        .when(chosen == "flashcards", "make_flashcards")
        .when(chosen == "quiz", "make_quiz")
        .when((chosen == "follow_up") & has_context, "answer")
        .otherwise("retrieve")
    )


def route_notes(covered: Column, hops: Column, next_query: Column, queries: Column, stalled: Column, scope: Column, most: int = 3) -> Column:
    """Whether another search follows the notes: not when covered, stalled, out of rounds, blank or repeated."""
    stop = covered | stalled | (hops >= most) | (F.trim(F.coalesce(next_query, F.lit(""))) == "") | F.array_contains(queries, next_query) | (scope == "document")
    return F.when(stop, "answer").otherwise("retrieve")


def valid_question(kind: Column, options: Column, answer: Column) -> Column:
    """Multiple choice needs four options and an answer that starts with A to D or is blank; others need an answer."""
    letter = F.substring(F.upper(F.trim(answer)), 1, 1)
    return F.when(kind == "mcq", (F.size(options) == 4) & ((letter == "") | letter.isin("A", "B", "C", "D"))).otherwise(F.trim(answer) != "")


def mcq_label(options: Column, letter: Column) -> Column:
    """The first option that starts with the letter, else the letter."""
    first = F.substring(F.upper(F.trim(letter)), 1, 1)
    return F.coalesce(F.get(F.filter(options, lambda o: F.upper(F.trim(o)).startswith(first)), F.lit(0)), first)


def graded(answers: DataFrame) -> DataFrame:
    """Answers (…, type, options, answer, given) with ``correct`` and ``needs_judge``: blank is wrong, the rest that is not exact needs a judge."""
    given = F.trim(F.coalesce("given", F.lit("")))
    exact = tx.answer_key(given) == tx.answer_key(F.coalesce("answer", F.lit("")))
    same_letter = F.substring(F.upper(given), 1, 1) == F.substring(F.upper(F.trim("answer")), 1, 1)
    return answers.withColumn(
        "correct", F.when(given == "", False).when(F.col("type") == "mcq", same_letter).when((F.col("type") == "fill_blank") & exact, True)
    ).withColumn("needs_judge", F.col("correct").isNull())


def judged(answers: DataFrame, judge) -> DataFrame:
    """The open answers sent to ``judge(questions, answers, given) -> booleans`` only; they are split off before the costly call."""
    call = F.pandas_udf(judge, "boolean")
    open_ = answers.where("needs_judge").withColumn("correct", call("question", "answer", "given"))
    return answers.where("not needs_judge").unionByName(open_)


def concept_scores(rows: DataFrame, by: tuple[str, ...] = ("concept",), weak: float = 0.6) -> DataFrame:
    """Mean correctness of each concept, and whether it is weak."""
    return rows.groupBy(*by).agg(F.avg(F.col("correct").cast("double")).alias("score"), F.count(F.lit(1)).alias("n")).withColumn("weak", F.col("score") < weak)


def merged_mastery(*layers: DataFrame) -> DataFrame:
    """Layers (key, concept, score), later ones win."""
    every = [layer.select("key", "concept", "score", F.lit(i).alias("_p")) for i, layer in enumerate(layers)]
    out = every[0]
    for layer in every[1:]:
        out = out.unionByName(layer)
    return out.groupBy("key", "concept").agg(F.max_by("score", "_p").alias("score"))


def saved_topics(visits: DataFrame) -> DataFrame:
    """(doc_id, topic, n, pages, last) of topic visits (doc_id, topic, pages, ts): the key is trimmed, lower-cased, at most 200 characters."""
    key = F.substring(F.lower(F.trim("topic")), 1, 200)
    return (
        visits.withColumn("topic", key)
        .where("topic <> ''")
        .groupBy("doc_id", "topic")
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"), F.max("ts").alias("last"))
    )


def recent(rows: DataFrame, key: str, order: str, n: int = 8) -> DataFrame:
    """The n latest rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *[c for c in rows.columns if c not in (key, order)][:1])
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def merged_context(old: DataFrame, fresh: DataFrame, cap: int = 5) -> DataFrame:
    """Old and new chunks (q, unit, pos): new ones that are not old come last, and old ones make room from their end. One shuffle, by question."""
    both = old.select("q", "unit", F.lit(0).alias("_s"), "pos").unionByName(fresh.select("q", "unit", F.lit(1).alias("_s"), "pos")).repartition("q")
    known = (F.min("_s").over(Window.partitionBy("q", "unit")) == 0) & F.col("q").isNotNull() & F.col("unit").isNotNull()
    left = both.withColumn("_known", known).where((F.col("_s") == 0) | ~F.col("_known"))
    n_new = F.when(F.col("q").isNull(), 0).otherwise(F.sum("_s").over(Window.partitionBy("q")))
    both = left.withColumn("_new", n_new).where((F.col("_s") == 1) | (F.col("pos") < F.greatest(F.lit(0), F.lit(cap) - F.col("_new")))).drop("_known", "_new")
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("_s", "pos")) - 1).drop("_s")


def spread(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """k evenly spaced rows of each key, or all of them."""
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    step = F.col("_n") / F.lit(k)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * step))
    return numbered.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i").cast("bigint"))).drop("_i", "_n")


def within_budget(blocks: DataFrame, key: str, order: str, size: Column, most: int = 40_000) -> DataFrame:
    """The leading blocks of each key whose running size fits."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= most)


def history(messages: DataFrame, n: int = 6, most: int = 500) -> DataFrame:
    """(conv_id, history): the last n messages, each cut, oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("text", 1, most))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn"), line.alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("history"))


def history_from(messages: DataFrame, seen: Column) -> DataFrame:
    """The messages (conv_id, turn, …) of each thread after the first ``seen`` ones."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("_i", F.row_number().over(w)).where(F.col("_i") > seen).drop("_i")


def fold_due(messages: DataFrame, upto: Column, keep: int = 4, least: int = 8) -> DataFrame:
    """(conv_id, n, fold): whether enough unsummarised messages lie behind the last few."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", F.col("n") - keep - upto >= least)


def last_user_message(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def without_answers(questions: DataFrame, col: str = "questions") -> DataFrame:
    """Quiz payloads as they are sent: no answers inside."""
    return questions.withColumn(col, F.transform(col, lambda q: q.dropFields("answer")))


def numbered_quiz(questions: DataFrame) -> DataFrame:
    """Valid questions only, renumbered q1 to qn in their order."""
    good = questions.where(valid_question(F.col("type"), F.col("options"), F.col("answer")))
    return good.withColumn("id", F.concat(F.lit("q"), F.row_number().over(Window.partitionBy("quiz").orderBy("pos"))))


def sse(event: Column, payload: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def map_rows(rows: DataFrame, call, schema: str) -> DataFrame:
    """A model call over rows, in Arrow batches: ``call(iterator of pandas frames)``. The engine brings inputs and checks, no model."""
    return rows.mapInPandas(call, schema)


def stalled(hops: Column, cited: Column, before: Column) -> Column:
    """Whether a further search gave no new page to cite."""
    return (hops > 1) & (F.size(F.array_except(cited, F.coalesce(before, F.array().cast("array<int>")))) == 0)


def after_notes(intent: Column, again: Column) -> Column:
    """The step after the notes: another search, or what was asked for."""
    made = {"ask": "answer", "summary": "topic_summary", "flashcard": "make_flashcards", "quiz": "make_quiz"}
    step = F.when(again, "retrieve")
    for key, name in made.items():
        step = step.when(intent == key, name)
    return step


def after_retrieve(context: Column) -> Column:
    return F.when(F.size(context) > 0, "summarize_topic").otherwise("no_context")


def after_quiz(questions: Column) -> Column:
    return F.when(F.size(questions) > 0, "collect_answers").otherwise("end")


def after_grade(weak: Column, round_: Column, most: int = 3) -> Column:
    return F.when((F.size(weak) > 0) & (round_ < most), "review").otherwise("remember")


def after_language(scan: Column, language: Column) -> Column:
    return F.when(~scan, "clean").when(language == "zh", "ocr").otherwise("ocr_failed")


def shown_cards(cards: DataFrame, shown: DataFrame) -> DataFrame:
    """Cards that cite a page which was shown (q, page); others are dropped."""
    return cards.join(shown.select("q", "page"), ["q", "page"], "left_semi")


def document_context(points: DataFrame, cards: DataFrame, chunks: DataFrame, carded: DataFrame, many: int = 30, few: int = 5) -> DataFrame:
    """(doc_id, pos, text): a document's summary points, else its cards if it has all of them, else its chunks; evenly spaced ones of each.

    Inputs are (doc_id, pos, text); ``carded`` lists the documents (doc_id) whose chunks all have cards.
    """
    first = points.select("doc_id", "pos", "text")
    done = first.select("doc_id").distinct()
    second = cards.join(carded.select("doc_id"), "doc_id", "left_semi").join(done, "doc_id", "left_anti").select("doc_id", "pos", "text")
    third = chunks.join(done, "doc_id", "left_anti").join(second.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "pos", "text")
    return spread(first.unionByName(second), "doc_id", "pos", many).unionByName(spread(third, "doc_id", "pos", few))


def context_block(page: Column, text: Column, topic: Column | None = None, description: Column | None = None) -> Column:
    """``[p.N] Card: topic - description`` and the text; without a topic the text alone follows the page."""
    card = F.lit("") if topic is None else F.when(F.coalesce(topic, F.lit("")) != "", F.concat(F.lit("Card: "), topic, F.lit(" - "), F.coalesce(description, F.lit("")), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("[p."), page.cast("string"), F.lit("] "), card, F.coalesce(text, F.lit("")))


def notes_text(idea: Column, points: Column) -> Column:
    """A main idea and its points (text, page), one a line."""
    lines = F.transform(points, lambda p: F.concat(F.lit("- "), p["text"], F.lit(" (p."), p["page"].cast("string"), F.lit(")")))
    return F.when(idea.isNull() & (F.size(points) <= 0), "(no notes)").otherwise(F.concat(F.coalesce(idea, F.lit("")), F.lit("\n"), F.array_join(lines, "\n")))


def memory_text(topics: Column, weak: Column) -> Column:
    """What is remembered of a document: topics (topic, takeaway) and missed concepts."""
    lines = F.transform(topics, lambda t: F.concat(F.lit("- "), t["topic"], F.lit(": "), t["takeaway"]))
    missed = F.when(F.size(weak) > 0, F.array(F.concat(F.lit("- Concepts missed in quizzes: "), F.array_join(weak, ", "))))
    told = F.concat(lines, F.coalesce(missed, F.array().cast("array<string>")))
    return F.when(F.size(told) > 0, F.array_join(told, "\n")).otherwise("(nothing yet)")


def conversation_text(summary: Column, history_: Column) -> Column:
    """The running summary, if any, and the recent messages."""
    head = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("Summary of earlier turns:\n"), summary, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("Recent messages:\n"), F.coalesce(F.nullif(history_, F.lit("")), F.lit("(no earlier messages)")))


def reviewed(found: DataFrame, context: DataFrame) -> DataFrame:
    """Hits (q, unit, pos) of a review's search; a question whose search found nothing keeps its old context."""
    return found.unionByName(context.join(found.select("q").distinct(), "q", "left_anti"))


def text_card(text: Column) -> tuple[Column, Column]:
    """The stand-in for a chunk's card where no model wrote one: its first words as topic and description."""
    return tx.first_words(text, 8, 30), tx.first_words(text, 40, 200)


def first_sentences(texts, count: int = 2):
    """The default extractive stand-in for a model that writes notes: pass it to ``pandas_udf``."""
    from ..functions.udfs import split_english

    return texts.map(lambda t: " ".join(split_english(t or "")[:count]))
