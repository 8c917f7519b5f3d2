"""Queries over the language-model steps, answered by the extractive stand-in, and over the keyed state of sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import study, tasks
from ..sources.tables import parallel, table
from ..streaming import progress
from .catalogue import registered

WORDS = r"regexp_extract_all({}, '[^ \t\n\r\f\v]+')"


def head(column: str, n: int, first: int = 1) -> str:
    """SQL of a text's words ``first`` to ``n``."""
    return f"array_to_string({WORDS.format(column)}[{first}:{n}], ' ')"


DOCS = f"d AS (SELECT doc_id, source, CAST(doc_id + 1 AS INTEGER) AS page, doc_id // 20 AS batch, {head('text', 12)} AS idea, {head('text', 3)} AS front, {head('text', 12, 2)} AS rest, len({WORDS.format('text')}) AS n FROM documents)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Each document as one page (doc_id, source, lang, page, block)."""
    docs = parallel(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))
    page = (F.col("doc_id") + 1).cast("int")
    return docs.select("doc_id", "source", "lang", page.alias("page"), tasks.page_blocks(page, F.col("text")).alias("block"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of at most twenty neighbouring documents of a source: (source, batch, pages, blocks)."""
    batch = F.floor(F.col("doc_id") / 20).alias("batch")
    told = F.array_sort(F.collect_list(F.struct("page", "block")))
    grouped = pages(spark, d).groupBy("source", batch).agg(told.alias("told"))
    return grouped.select("source", "batch", F.transform("told", lambda x: x["page"]).alias("pages"), F.array_join(F.transform("told", lambda x: x["block"]), "\n\n").alias("blocks"))


@registered("""WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn = 6 THEN 'quiz' WHEN contains(lower(text), 'quiz') THEN 'quiz' WHEN contains(lower(text), 'flashcard') THEN 'flashcard' WHEN contains(lower(text), 'summar') THEN 'summary' ELSE 'ask' END AS intent,
contains(lower(text), 'document') AS whole, contains(lower(text), 'more') AS more FROM conversations WHERE role = 'user')
SELECT conv_id, turn, intent, CASE WHEN whole THEN 'document' ELSE 'topic' END AS scope, more AND NOT whole AND turn > 0 AS follow_up,
CASE WHEN whole AND intent IN ('quiz', 'flashcard') THEN 'the whole document' WHEN whole OR trim(text) = '' THEN text ELSE trim(text) END AS topic FROM r""")
def routed_messages(spark, d):
    """Every message of a user routed; the seventh of a conversation comes with a pressed button."""
    users = table(spark, d, "conversations").where("role = 'user'")
    asked = users.withColumn("prompt", tasks.prompt("route", F.lit("en"), message=F.col("text")))
    button = F.when(F.col("turn") == 6, "quiz")
    found = tasks.decided(F.col("reply"), F.col("text"), button, F.lit(""), F.col("turn") > 0)
    return tasks.replied(asked, "route").select("conv_id", "turn", found.alias("r")).select("conv_id", "turn", "r.*")


@registered(f"WITH {DOCS} SELECT doc_id, idea || chr(10) || CASE WHEN n > 0 THEN chr(10) || '- ' || idea || ' (p.' || page || ')' ELSE '' END AS notes, n > 0 AS covered, CASE WHEN n > 0 THEN 1 ELSE 0 END AS cited FROM d")
def topic_notes(spark, d):
    asked = pages(spark, d).withColumn("prompt", tasks.prompt("notes", F.col("lang"), F.col("block"), topic=F.col("source")))
    reply = F.col("reply")
    return tasks.replied(asked, "notes").select("doc_id", tasks.summary_text(reply).alias("notes"), reply["covered"].alias("covered"), F.size(tasks.cited_pages(reply)).alias("cited"))


@registered(f"WITH {DOCS} SELECT doc_id, idea || CASE WHEN n > 0 THEN chr(10) || chr(10) || '(Source: p.' || page || ')' ELSE '' END AS answer FROM d")
def written_answers(spark, d):
    asked = pages(spark, d).withColumn("prompt", tasks.prompt("answer", F.col("lang"), F.col("block"), question=F.col("source")))
    return tasks.replied(asked, "answer").select("doc_id", tasks.answer_text(F.col("reply")).alias("answer"))


@registered(f"""WITH {DOCS}, k AS (SELECT *, page > min(page) OVER (PARTITION BY source, batch) AS shown FROM d),
f AS (SELECT * FROM k WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY source, batch ORDER BY page) <= 8),
c AS (SELECT *, row_number() OVER (PARTITION BY source, batch ORDER BY page) AS i FROM f WHERE shown),
g AS (SELECT source, batch, string_agg(i || '. ' || front || ' — ' || idea || ' (p.' || page || ')', chr(10) ORDER BY i) AS cards FROM c GROUP BY source, batch)
SELECT source, batch, coalesce(cards, 'No flashcards could be made from these pages.') AS cards FROM (SELECT DISTINCT source, batch FROM d) LEFT JOIN g USING (source, batch)""")
def written_flashcards(spark, d):
    """Cards of each context; those of its first page are dropped, as if that page had not been shown."""
    asked = contexts(spark, d).withColumn("prompt", tasks.prompt("flashcards", F.lit("en"), F.col("blocks"), topic=F.col("source")))
    shown = F.filter("pages", lambda p: p > F.get("pages", F.lit(0)))
    return tasks.replied(asked, "flashcards").select("source", "batch", tasks.flashcards_text(tasks.shown_flashcards(F.col("reply"), shown)).alias("cards"))


@registered(f"""WITH {DOCS}, c AS (SELECT *, row_number() OVER (PARTITION BY source, batch ORDER BY page) AS i FROM d WHERE n > 0),
g AS (SELECT source, batch, string_agg(chr(10) || 'q' || i || '. ' || rest, chr(10) ORDER BY i) AS asked FROM c WHERE i <= 5 GROUP BY source, batch)
SELECT source, batch, 'Quiz round 1:' || coalesce(chr(10) || asked, '') AS quiz FROM (SELECT DISTINCT source, batch FROM d) LEFT JOIN g USING (source, batch)""")
def written_quiz(spark, d):
    asked = contexts(spark, d).withColumn("prompt", tasks.prompt("quiz", F.lit("en"), F.col("blocks"), topic=F.col("source")))
    return tasks.replied(asked, "quiz").select("source", "batch", tasks.quiz_text(tasks.valid_questions(F.col("reply")), F.lit(1)).alias("quiz"))


@registered(f"""WITH {DOCS} SELECT doc_id, 'Pages ' || page || '-' || page AS title, idea AS main_idea, replace(front, ' ', '|') AS key_terms, 'Not supported by the text, remove or correct: (not on any page)' AS issues FROM d""")
def section_summaries(spark, d):
    """Each document as a section: summarised, then checked against its page together with a point that is not on it."""
    asked = pages(spark, d).withColumn("prompt", tasks.prompt("section", F.col("lang"), F.col("block")))
    made = tasks.replied(asked, "section").withColumnRenamed("reply", "section")
    told = F.array_join(F.concat(F.transform("section.key_points", lambda p: p["text"]), F.array(F.lit("(not on any page)"))), "\n")
    checked = tasks.replied(made.withColumn("prompt", tasks.prompt("faithful", F.lit("en"), F.col("block"), points=told)), "faithful")
    title = tasks.section_titles(F.lit(""), F.col("section"), F.col("page"), F.col("page"))
    return checked.select("doc_id", title.alias("title"), F.col("section.main_idea").alias("main_idea"), F.array_join("section.key_terms", "|").alias("key_terms"), F.array_join(tasks.faithfulness_issues(F.col("reply")), "; ").alias("issues"))


LINES = f"""l AS (SELECT source, batch, page, 'p.' || page || ' ' || idea AS line FROM d),
h AS (SELECT *, row_number() OVER (PARTITION BY source, batch ORDER BY page) AS i, {head('line', 8)} AS short FROM l)"""


@registered(f"""WITH {DOCS}, {LINES} SELECT source, batch, CASE WHEN batch % 7 = 3 THEN source ELSE any_value(short) FILTER (i = 1) END AS subject, CASE WHEN batch % 7 = 3 THEN '' ELSE string_agg(short, ' ' ORDER BY i) FILTER (i <= 5) END AS overview FROM h GROUP BY source, batch""")
def document_overviews(spark, d):
    """An overview of each context's first words; some have no prompt, as if their call had failed, and keep their file name."""
    p = pages(spark, d)
    words = F.regexp_extract_all("block", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    line = F.concat(F.lit("p."), F.col("page").cast("string"), F.lit(" "), F.array_join(F.slice(words, 2, 12), " "))
    told = F.array_sort(F.collect_list(F.struct("page", line.alias("line"))))
    grouped = p.groupBy("source", F.floor(F.col("doc_id") / 20).alias("batch")).agg(F.array_join(F.transform(told, lambda x: x["line"]), "\n").alias("lines"))
    asked = grouped.withColumn("prompt", F.when(F.col("batch") % 7 != 3, tasks.prompt("overview", F.lit("en"), sections=F.col("lines"))))
    subject, overview = tasks.overview_or(F.col("reply"), F.col("source"))
    return tasks.replied(asked, "overview").select("source", "batch", subject.alias("subject"), overview.alias("overview"))


@registered(f"""WITH m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'system'),
s AS (SELECT conv_id, arg_min(text, turn) AS summary, 1 AS upto FROM conversations WHERE role = 'system' GROUP BY conv_id),
k AS (SELECT m.*, summary, coalesce(upto, 0) AS upto FROM m LEFT JOIN s USING (conv_id)),
o AS (SELECT conv_id, any_value(summary) AS summary, any_value(n) AS n, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(coalesce(text, ''), 1, 500), chr(10) ORDER BY i) AS told FROM k WHERE n - 2 - upto >= 2 AND i >= upto AND i < n - 2 GROUP BY conv_id)
SELECT conv_id, CASE WHEN trim(coalesce(summary, '')) <> '' THEN summary || chr(10) ELSE '' END || array_to_string(list_transform(list_filter(string_split(told, chr(10)), lambda x: len({WORDS.format('x')}) > 0), lambda x: '- ' || {head('x', 12)}), chr(10)) AS summary, n - 2 AS upto FROM o""")
def conversation_folds(spark, d):
    """Running summaries folded on; conversations are short here, so two messages stay out and two make a fold due."""
    m = table(spark, d, "conversations")
    state = m.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("summary")).withColumn("upto", F.lit(1))
    return tasks.folded(m.where("role <> 'system'"), state, keep=2, least=2)


THREADS = """WITH e AS (SELECT user_id AS thread, event_id, ts, CASE event_id % 4 WHEN 0 THEN 'pause' WHEN 1 THEN 'resume' WHEN 2 THEN 'step' ELSE 'done' END AS kind FROM events)
SELECT thread, count(*) AS n, count(*) FILTER (kind = 'pause') AS pauses, arg_max(kind, struct_pack(t := ts, e := event_id)) AS last,
coalesce(max(struct_pack(t := ts, e := event_id)) FILTER (kind = 'pause') > coalesce(max(struct_pack(t := ts, e := event_id)) FILTER (kind IN ('resume', 'done')), struct_pack(t := TIMESTAMP '1970-01-01', e := CAST(-1 AS BIGINT))), false) AS awaiting FROM e GROUP BY thread"""


def _thread_events(events: DataFrame) -> DataFrame:
    kinds = F.array(*map(F.lit, ("pause", "resume", "step", "done")))
    return events.select(F.col("user_id").alias("thread"), "event_id", "ts", F.element_at(kinds, (1 + F.col("event_id") % 4).cast("int")).alias("kind"))


@registered(THREADS)
def thread_states(spark, d):
    """The state of every session's thread, from all its events."""
    return progress.thread_states(_thread_events(table(spark, d, "events")))


@registered(THREADS)
def stream_threads(spark, d):
    """The same state kept by a stream with a checkpoint."""
    return progress.run_to_end(progress.thread_states(_thread_events(progress.event_stream(spark, d))), f"threads-{uuid.uuid4().hex}")


@registered("""SELECT conv_id, turn, role = 'user' AS asks, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) WHERE i > 2""")
def thread_history(spark, d):
    """What a client that has seen two messages of each thread still lacks."""
    return study.history_from(table(spark, d, "conversations"), F.lit(2)).select("conv_id", "turn", (F.col("role") == "user").alias("asks"), "text")
