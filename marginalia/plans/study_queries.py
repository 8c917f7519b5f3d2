"""Queries over sessions, events and memory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import study
from ..sources.tables import table
from ..streaming import progress
from .catalogue import registered

QUIZ = """WITH a AS (SELECT event_id, user_id, event_type AS concept, CASE event_id % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'fill_blank' ELSE 'short' END AS type,
CASE event_id % 3 WHEN 0 THEN substr('ABCD', CAST(1 + event_id % 4 AS INTEGER), 1) ELSE event_type || '-' || (event_id % 5) END AS answer,
CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 3 = 0 THEN substr('abcd', CAST(1 + user_id % 4 AS INTEGER), 1) || '. x' WHEN event_id % 2 = 0 THEN upper(event_type) || ' ' || (event_id % 5) ELSE 'other' END AS given FROM events),
g AS (SELECT *, CASE WHEN trim(given) = '' THEN false WHEN type = 'mcq' THEN upper(trim(given))[1] = answer[1]
  WHEN type = 'fill_blank' AND regexp_replace(lower(given), '[^a-z0-9]', '', 'g') = regexp_replace(lower(answer), '[^a-z0-9]', '', 'g') THEN true END AS correct FROM a)"""


def quiz(spark, d):
    i, k = F.col("event_id"), F.col("event_id") % 3
    number = (i % 5).cast("string")
    letter = lambda letters, n: F.substr(F.lit(letters), (1 + n % 4).cast("int"), F.lit(1))
    return table(spark, d, "events").select(
        "event_id",
        "user_id",
        F.col("event_type").alias("concept"),
        F.when(k == 0, "mcq").when(k == 1, "fill_blank").otherwise("short").alias("type"),
        F.when(k == 0, letter("ABCD", i)).otherwise(F.concat("event_type", F.lit("-"), number)).alias("answer"),
        F.when(i % 11 == 0, " ").when(k == 0, F.concat(letter("abcd", F.col("user_id")), F.lit(". x"))).when(i % 2 == 0, F.concat(F.upper("event_type"), F.lit(" "), number)).otherwise("other").alias("given"),
    )


@registered(QUIZ + " SELECT event_id, correct, correct IS NULL AS needs_judge FROM g")
def grade_answers(spark, d):
    return study.graded(quiz(spark, d)).select("event_id", "correct", "needs_judge")


@registered(QUIZ + """ SELECT user_id, concept, round(avg(CASE WHEN coalesce(correct, false) THEN 1.0::DOUBLE ELSE 0 END), 6) AS score, count(*) AS n,
avg(CASE WHEN coalesce(correct, false) THEN 1.0::DOUBLE ELSE 0 END) < 0.6 AS weak FROM g GROUP BY user_id, concept""")
def concept_mastery(spark, d):
    rows = study.graded(quiz(spark, d)).withColumn("correct", F.coalesce("correct", F.lit(False)))
    return study.concept_scores(rows, ("user_id", "concept")).withColumn("score", F.round("score", 6))


@registered("""WITH a AS (SELECT user_id AS key, event_type AS concept, avg(value) AS score FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), b AS (SELECT user_id AS key, event_type AS concept, max(value) AS score FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
SELECT key, concept, round(coalesce(b.score, a.score), 6) AS score FROM a FULL JOIN b USING (key, concept)""")
def mastery_merge(spark, d):
    """The layer of the month's first half under that of the second."""
    e = table(spark, d, "events").select("ts", F.col("user_id").alias("key"), F.col("event_type").alias("concept"), "value")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    old, new = e.where(early).groupBy("key", "concept").agg(F.avg("value").alias("score")), e.where(~early).groupBy("key", "concept").agg(F.max("value").alias("score"))
    return study.merged_mastery(old, new).withColumn("score", F.round("score", 6))


@registered("""SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 8""")
def recent_topics(spark, d):
    return study.recent(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 8).select("user_id", "event_id", "rn")


@registered("""SELECT user_id AS doc_id, lower(event_type) AS topic, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_id % 10)), ',') AS pages, max(ts) AS last FROM events GROUP BY user_id, lower(event_type)""")
def topic_counts(spark, d):
    visits = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.concat(F.lit(" "), F.upper("event_type")).alias("topic"), F.array(F.col("event_id") % 10).alias("pages"), "ts")
    return study.saved_topics(visits).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@registered("""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM n WHERE n <= 7 OR list_contains(list_transform(range(7), lambda k: CAST(floor(k * (n / 7.0::DOUBLE)) AS BIGINT)), i)""")
def spread_k(spark, d):
    return study.spread(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 7)


@registered("""SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 40000""")
def context_budget(spark, d):
    blocks = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return study.within_budget(blocks, "source", "doc_id", F.col("n")).select("source", "doc_id", "used")


@registered("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(text, 1, 500), chr(10) ORDER BY turn) AS history FROM m WHERE n <= 6 GROUP BY conv_id""")
def history_last_n(spark, d):
    return study.history(table(spark, d, "conversations"))


@registered("SELECT conv_id, count(*) AS n, count(*) - 4 >= 2 AS fold FROM conversations GROUP BY conv_id")
def fold_due(spark, d):
    return study.fold_due(table(spark, d, "conversations"), F.lit(0), 4, 2)


@registered("SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, d):
    return study.last_user_message(table(spark, d, "conversations"))


@registered("""WITH o AS (SELECT c_custkey AS q, unnest(range(5)) AS pos FROM customer), o2 AS (SELECT q, pos, (q + pos) % 9 AS unit FROM o),
f AS (SELECT c_custkey AS q, unnest(range(3)) AS pos FROM customer), f2 AS (SELECT q, pos, (q * 2 + pos) % 9 AS unit FROM f),
fresh AS (SELECT * FROM f2 WHERE NOT EXISTS (SELECT 1 FROM o2 WHERE o2.q = f2.q AND o2.unit = f2.unit)), n AS (SELECT q, count(*) AS n FROM fresh GROUP BY q),
b AS (SELECT o2.q, o2.unit, 0 AS s, o2.pos FROM o2 LEFT JOIN n USING (q) WHERE o2.pos < greatest(0, 5 - coalesce(n.n, 0)) UNION ALL SELECT q, unit, 1, pos FROM fresh)
SELECT q, unit, CAST(row_number() OVER (PARTITION BY q ORDER BY s, pos) - 1 AS INTEGER) AS pos FROM b""")
def merge_context(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("q"))
    old = q.select("q", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")).withColumn("unit", (F.col("q") + F.col("pos")) % 9)
    new = q.select("q", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).withColumn("unit", (F.col("q") * 2 + F.col("pos")) % 9)
    return study.merged_context(old, new)


ROUTE = """CASE WHEN intent = 'summary' AND scope = 'document' THEN 'document_summary' WHEN intent = 'flashcards' THEN 'make_flashcards' WHEN intent = 'quiz' THEN 'make_quiz'
WHEN intent = 'follow_up' AND ctx THEN 'answer' ELSE 'retrieve' END"""


@registered(f"""SELECT conv_id, turn, {ROUTE} AS step FROM (SELECT conv_id, turn, ['summary', 'flashcards', 'quiz', 'follow_up', 'question'][CAST(1 + (conv_id + turn) % 5 AS INTEGER)] AS intent,
CASE WHEN conv_id % 2 = 0 THEN 'document' ELSE 'topic' END AS scope, turn > 2 AS ctx FROM conversations)""")
def routing(spark, d):
    intent = F.element_at(F.array(*map(F.lit, ("summary", "flashcards", "quiz", "follow_up", "question"))), (1 + (F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    scope = F.when(F.col("conv_id") % 2 == 0, "document").otherwise("topic")
    return table(spark, d, "conversations").select("conv_id", "turn", study.route_message(intent, scope, F.col("turn") > 2).alias("step"))


@registered("""SELECT event_id, CASE WHEN k = 0 THEN (event_id % 5 <> 0) AND (a = '' OR a IN ('A', 'B', 'C', 'D')) ELSE event_id % 7 <> 0 END AS valid FROM (SELECT event_id, event_id % 3 AS k, ['A', 'E', '', 'D'][CAST(1 + event_id % 4 AS INTEGER)] AS a FROM events)""")
def quiz_validity(spark, d):
    i, k = F.col("event_id"), F.col("event_id") % 3
    options = F.when(i % 5 == 0, F.array(F.lit("A. x"))).otherwise(F.array(*map(F.lit, ("A. x", "B. y", "C. z", "D. w"))))
    answer = F.when(k == 0, F.element_at(F.array(*map(F.lit, ("A", "E", "", "D"))), (1 + i % 4).cast("int"))).otherwise(F.when(i % 7 == 0, " ").otherwise("x"))
    kind = F.when(k == 0, "mcq").otherwise("short")
    return table(spark, d, "events").select("event_id", study.valid_question(kind, options, answer).alias("valid"))


@registered("SELECT event_id, '{\"id\":' || event_id || ',\"concept\":\"' || event_type || '\"}' AS sent FROM events")
def strip_answers(spark, d):
    q = F.array(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("concept"), F.lit("B").alias("answer")))
    sent = study.without_answers(table(spark, d, "events").select("event_id", q.alias("questions")))
    return sent.select("event_id", F.to_json(F.col("questions")[0]).alias("sent"))


@registered("SELECT user_id, max(ts) AS ts, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, arg_max(value, struct_pack(t := ts, e := event_id)) AS value FROM events GROUP BY user_id")
def latest_progress(spark, d):
    return progress.latest_progress(table(spark, d, "events"))


@registered("SELECT user_id, max(ts) AS ts, max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 300 SECOND AS stale FROM events GROUP BY user_id")
def stale_jobs(spark, d):
    latest = progress.latest_progress(table(spark, d, "events"))
    return progress.stale(latest, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select("user_id", "ts", "stale")


@registered("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id, event_type")
def event_counters(spark, d):
    return progress.counters(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@registered("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id, event_type")
def stream_counters(spark, d):
    found = progress.run_to_end(progress.counters(progress.event_stream(spark, d)), f"counters_{uuid.uuid4().hex}")
    return found.withColumn("total", F.round("total", 4))


@registered("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """All windows of a finished table: complete mode without a watermark; a live sink takes ``windowed`` in append mode."""
    found = progress.run_to_end(progress.windowed(progress.event_stream(spark, d), late=None), f"windows_{uuid.uuid4().hex}")
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
