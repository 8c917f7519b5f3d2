"""Queries over jobs, stores, prompts, routers and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, index, ingest, retrieval, rollup, study
from ..sources import store, tables
from ..sources.tables import table
from ..streaming import progress
from .catalogue import registered
from .retrieval_queries import ANSWERS, BM25, HITS, PERQ, SHOWN, _hits, _per_question, answers, asked, ranked_pages, shown, units
from .text_queries import _toc, pages


@registered(f"WITH {BM25} SELECT {SHOWN} FROM bmr WHERE rank <= 10")
def index_roundtrip(spark, d):
    """An index for BM25 written, opened again and searched."""
    path = store.workspace(spark, f"index-{uuid.uuid4().hex}")
    u = units(spark, d)
    index.written(u, path, kinds=("bm25",))
    return shown(retrieval.top_k(retrieval.bm25_hits(index.opened(u, path, kinds=("bm25",))["bm25"], asked(spark, d), 10), 10))


@registered("SELECT source AS scope FROM documents GROUP BY source HAVING bool_or(regexp_replace(text, '[ \\t]{2,}', ' ', 'g') <> text)".replace("\\\\", "\\"))
def index_stale(spark, d):
    """Scopes whose texts differ from those that the index was made of."""
    old = table(spark, d, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("unit"), "text")
    new = old.withColumn("text", F.regexp_replace("text", r"[ \t]{2,}", " "))
    return index.stale(index.fingerprints(old), index.fingerprints(new))


@registered("SELECT source AS scope, CASE WHEN length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) >= 0.15 * length(t) AND length(t) > 0 THEN 'char' ELSE 'word' END AS mode FROM (SELECT source, substr(string_agg(text, '' ORDER BY doc_id), 1, 20000) AS t FROM documents GROUP BY source)".replace("\\\\", "\\"))
def analyser_modes(spark, d):
    return index.analyser_modes(table(spark, d, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("unit"), "text"))


@registered("SELECT source AS doc_id, count(*) AS n_chunks, count(*) FILTER (regexp_replace(text, '[ \\t]{2,}', ' ', 'g') = text) AS n_cards FROM documents GROUP BY source".replace("\\\\", "\\"))
def replace_document(spark, d):
    """All documents put into a store with a card for each chunk, then replaced by their squeezed texts: cards of unchanged chunks stay."""
    path = store.workspace(spark, f"store-{uuid.uuid4().hex}")
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), (F.col("doc_id") + 1).cast("int").alias("page_no"), F.lit(0).alias("chunk_index"), "text")
    ids = chunks.select("doc_id").distinct()
    store.put(path, ids, {"chunks": chunks, "cards": chunks.select("chunk_id", "doc_id", F.lit("t").alias("topic"), F.lit("d").alias("description"))})
    store.replaced_content(path, ids, chunks.withColumn("text", F.regexp_replace("text", r"[ \t]{2,}", " ")), {})
    n = store.current(spark, path, "chunks", tables.CHUNK).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    m = store.current(spark, path, "cards", tables.CARD).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cards"))
    return n.join(m, "doc_id", "left").select("doc_id", "n_chunks", F.coalesce("n_cards", F.lit(0).cast("long")).alias("n_cards"))


@registered("SELECT source AS doc_id, count(*) AS num_pages, 'en' AS language, avg(CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 30 THEN 1.0::DOUBLE ELSE 0 END) >= 0.6 AS ocr_required FROM documents GROUP BY source".replace("\\\\", "\\"))
def ingest_pages(spark, d):
    """The whole ingest job over all pages; what it says of each document."""
    raw = pages(spark, d).select("doc_id", "page_no", F.col("text").alias("text_raw"))
    return ingest.ingested(raw, store.workspace(spark, f"ingest-{uuid.uuid4().hex}")).select("doc_id", "num_pages", "language", "ocr_required")


@registered("""WITH e AS (SELECT source AS doc_id, CAST(doc_id + 1 AS INTEGER) AS start FROM documents),
r AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, (SELECT CAST(max(doc_id) + 1 AS INTEGER) FROM documents x WHERE x.source = e.doc_id)) AS "end" FROM e)
SELECT d.source AS doc_id, r.start, substr(string_agg('[p.' || (d.doc_id + 1) || '] ' || d.text, chr(10) || chr(10) ORDER BY d.doc_id), 1, 40000) AS text FROM documents d JOIN r ON r.doc_id = d.source AND d.doc_id + 1 BETWEEN r.start AND r."end" GROUP BY d.source, r.start""")
def section_sources(spark, d):
    return rollup.source_text(pages(spark, d).select("doc_id", "page_no", "text"), _toc(spark, d))


@registered("""WITH c AS (SELECT source AS doc_id, doc_id AS page, text, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS INTEGER) AS batch FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, batch ORDER BY page) AS i FROM c)
SELECT doc_id, batch, string_agg('[c' || i || '] (p.' || (page + 1) || ') ' || text, chr(10) || chr(10) ORDER BY i) AS prompt FROM n GROUP BY doc_id, batch""")
def card_prompts(spark, d):
    chunks = rollup.batches(pages(spark, d).select("doc_id", "page_no", F.lit(0).alias("chunk_index"), "text"), "doc_id", "page_no")
    return rollup.card_prompts(chunks)


@registered(ANSWERS + " SELECT DISTINCT id AS q, page FROM (SELECT id, unnest(cited) AS page, shown FROM f) WHERE list_contains(shown, page)")
def shown_cards(spark, d):
    a = answers(spark, d)
    cards, pages_shown = a.select(F.col("id").alias("q"), F.explode("cited").alias("page")), a.select(F.col("id").alias("q"), F.explode("shown").alias("page"))
    return study.shown_cards(cards.distinct(), pages_shown).select("q", F.col("page").cast("long").alias("page"))


@registered(ANSWERS + """ SELECT id, hops > 1 AND len(list_filter(cited, lambda x: NOT list_contains(shown, x))) = 0 AS stalled,
CASE WHEN NOT (hops > 1 AND len(list_filter(cited, lambda x: NOT list_contains(shown, x))) = 0) AND found = 0 THEN 'retrieve' WHEN id % 4 = 0 THEN 'answer' WHEN id % 4 = 1 THEN 'topic_summary' WHEN id % 4 = 2 THEN 'make_flashcards' ELSE 'make_quiz' END AS step FROM f""")
def note_routing(spark, d):
    """Whether the search stalled, and the step after the notes; an answer that was not found asks for another search."""
    a = answers(spark, d)
    intent = F.element_at(F.array(*map(F.lit, ("ask", "summary", "flashcard", "quiz"))), (1 + F.col("id") % 4).cast("int"))
    stop = study.stalled(F.col("hops"), F.col("cited"), F.col("shown"))
    return a.select("id", stop.alias("stalled"), study.after_notes(intent, ~stop & (F.col("found") == 0)).alias("step"))


@registered(ANSWERS + """ SELECT id, CASE WHEN len(cited) > 0 THEN 'summarize_topic' ELSE 'no_context' END AS retrieved, CASE WHEN len(groups) > 0 THEN 'collect_answers' ELSE 'end' END AS quizzed,
CASE WHEN len(groups) > 0 AND hops < 2 THEN 'review' ELSE 'remember' END AS graded, CASE WHEN found = 1 THEN 'clean' WHEN hops = 1 THEN 'ocr' ELSE 'ocr_failed' END AS detected,
CASE WHEN len(groups) > 0 AND hops <= 1 THEN 'summarize' ELSE 'finalize' END AS checked FROM f""")
def state_routing(spark, d):
    """The other routers of sessions and ingest, over answer records."""
    scan, lang = F.col("found") == 0, F.when(F.col("hops") == 1, "zh")
    return answers(spark, d).select(
        "id", study.after_retrieve(F.col("cited")).alias("retrieved"), study.after_quiz(F.col("groups")).alias("quizzed"), study.after_grade(F.col("groups"), F.col("hops"), 2).alias("graded"),
        study.after_language(scan, lang).alias("detected"), rollup.next_after_check(F.col("groups"), F.col("hops")).alias("checked"),
    )


@registered("""WITH n AS (SELECT source AS doc_id, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS bad FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
SELECT doc_id, CASE WHEN bad > 2 THEN 'building' WHEN n = 0 THEN 'error' ELSE 'ready' END AS index, CASE WHEN good > 10 THEN 'ready' WHEN bad > 2 THEN 'building' WHEN bad > 0 THEN 'error' ELSE 'none' END AS summary FROM n""")
def document_status(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    n = docs.groupBy(F.col("source").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("toxic") == 1, 1)).alias("bad"))
    job, error = F.when(F.col("bad") > 2, "building"), F.when(F.col("bad") > 0, "failed")
    return n.select("doc_id", ingest.index_status(job, F.col("n")).alias("index"), ingest.summary_status(F.col("good") > 10, F.col("bad") > 2, error).alias("summary"))


@registered("""WITH c AS (SELECT source AS doc_id, doc_id AS pos, text, quality, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT doc_id, pos, substr(text, 1, 30) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM c WHERE quality = 1),
pick AS (SELECT doc_id, pos, text, i, n, 30 AS k FROM p UNION ALL SELECT doc_id, pos, text, i, n, 5 FROM c WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, pos, text FROM pick WHERE n <= k OR list_contains(list_transform(range(k), lambda j: CAST(floor(j * (n / k::DOUBLE)) AS BIGINT)), i)""")
def document_context(spark, d):
    """Points of the documents that have any, chunks of the others."""
    chunks = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("pos"), "text", "quality")
    points = chunks.where("quality = 1").withColumn("text", F.substring("text", 1, 30))
    return study.document_context(points, chunks.limit(0), chunks, chunks.select("doc_id").limit(0))


@registered("""SELECT conv_id, turn, '[p.' || turn || '] ' || CASE WHEN role = 'user' THEN 'Card: ' || role || ' - d' || chr(10) ELSE '' END || text AS block FROM conversations""")
def context_blocks(spark, d):
    topic = F.when(F.col("role") == "user", F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", study.context_block(F.col("turn"), F.col("text"), topic, F.lit("d")).alias("block"))


@registered("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), s AS (SELECT conv_id, arg_min(text, turn) AS summary FROM conversations WHERE role = 'system' GROUP BY conv_id),
h AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(text, 1, 500), chr(10) ORDER BY turn) AS history FROM m WHERE n <= 4 GROUP BY conv_id)
SELECT conv_id, CASE WHEN coalesce(summary, '') <> '' THEN 'Summary of earlier turns:' || chr(10) || summary || chr(10) || chr(10) ELSE '' END || 'Recent messages:' || chr(10) || history AS prompt FROM h LEFT JOIN s USING (conv_id)""")
def conversation_prompts(spark, d):
    m = table(spark, d, "conversations")
    summary = m.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("summary"))
    return study.history(m, 4).join(summary, "conv_id", "left").select("conv_id", study.conversation_text(F.col("summary"), F.col("history")).alias("prompt"))


@registered("""WITH t AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS v FROM events GROUP BY ALL)
SELECT user_id, string_agg('- ' || event_type || ': ' || n, chr(10) ORDER BY event_type) || coalesce(chr(10) || '- Concepts missed in quizzes: ' || string_agg(event_type, ', ' ORDER BY event_type) FILTER (v < 50), '') AS memory FROM t GROUP BY user_id""")
def memory_prompts(spark, d):
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    topics = F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("topic"), F.col("n").cast("string").alias("takeaway"))))
    weak = F.array_sort(F.collect_list(F.when(F.col("v") < 50, F.col("event_type"))))
    return t.groupBy("user_id").agg(topics.alias("topics"), weak.alias("weak")).select("user_id", study.memory_text(F.col("topics"), F.col("weak")).alias("memory"))


@registered(HITS + """, b AS (SELECT q, parent, arg_min(page, rank) AS page, arg_min(score, rank) AS score, min(rank) AS first FROM h GROUP BY q, parent),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY first) AS rank FROM b)
SELECT q, parent AS unit, page, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def search_entry(spark, d):
    """The application's search: child hits collapsed to parents, chunks for questions without any; a blank question finds nothing."""
    hits = _hits(spark, d)
    qs = asked(spark, d).unionByName(asked(spark, d).select((F.col("q") + 1_000_000).alias("q"), "scope", F.lit("  ").alias("text")))
    found = retrieval.search(qs, lambda live: hits.join(live.select("q"), "q"), lambda live: hits.join(live.select("q"), "q"), 8)
    return found.select("q", "unit", "page", F.round("score", 4).alias("score"), F.col("rank").cast("int").alias("rank"))


@registered(HITS + """ SELECT q, h.unit, lang AS card_topic, source AS card_description FROM h LEFT JOIN (SELECT doc_id AS unit, lang, source FROM documents JOIN labels USING (doc_id)) c ON c.unit = h.unit""")
def hits_with_cards(spark, d):
    cards = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("topic"), F.col("source").alias("description"))
    return retrieval.with_cards(_hits(spark, d), cards).select("q", "unit", "card_topic", "card_description")


@registered("SELECT d.doc_id AS chunk_id, d.source AS topic FROM documents d JOIN labels l USING (doc_id)")
def cards_in_order(spark, d):
    docs = table(spark, d, "documents")
    cards = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("topic"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") + 1).alias("page_no"), F.lit(0).alias("chunk_index"))
    ordered = rollup.cards_in_order(cards, chunks)
    return ordered.select("chunk_id", "topic")



@registered(PERQ + """, t AS (SELECT q, """ + ", ".join(f"max(CASE WHEN rank = {i} THEN CAST(page AS INTEGER) END) AS top{i}" for i in range(1, 6)) + """ FROM top GROUP BY q)
SELECT 'bm25' AS retriever, pq.q, doc, lang, level, n_groups, """ + ", ".join(f"top{i}" for i in range(1, 6)) + """, CASE WHEN n_groups > 0 AND first > 0 THEN first END AS first_rank, CASE WHEN n_groups > 0 AND "full" > 0 THEN "full" END AS full_rank,
""" + ", ".join(f'CASE WHEN n_groups > 0 THEN CASE WHEN "{c}" BETWEEN 1 AND {k} THEN 1 ELSE 0 END END AS {n}_{k}' for c, n in (("first", "hit"), ("full", "full")) for k in evaluation.KS) + """,
CASE WHEN n_groups > 0 THEN CASE WHEN first > 0 THEN round(1.0::DOUBLE / first, 4) ELSE 0 END END AS rr, CASE WHEN nothing THEN 1 ELSE 0 END AS nothing FROM pq LEFT JOIN t ON t.q = pq.q""")
def question_rows(spark, d):
    hits = ranked_pages(spark, d)
    return evaluation.question_rows(_per_question(spark, d, hits), hits)


@registered(HITS + """ SELECT q, page, rank, CASE WHEN page = q % 11 OR page = (q + 3) % 11 OR page = 1 THEN 1 ELSE 0 END AS is_gold FROM h WHERE rank <= 5""")
def top_texts(spark, d):
    q = F.col("item_id")
    groups = table(spark, d, "benchmark").select(q.alias("q"), F.array(F.array(q % 11), F.array((q + 3) % 11, F.lit(1).cast("long"))).alias("groups"))
    return evaluation.top_texts(_hits(spark, d).select("q", "page", "score", "rank"), groups).select("q", "page", "rank", "is_gold")


@registered(ANSWERS + """, s AS (SELECT DISTINCT unnest(list_concat(['ALL', 'doc=' || doc, 'lang=' || lang], CASE WHEN retrieval_hit = 1 THEN ['retrieval=hit'] WHEN retrieval_hit = 0 THEN ['retrieval=miss'] ELSE [] END)) AS slice FROM f)
SELECT slice, CASE WHEN slice = 'ALL' THEN 0 WHEN starts_with(slice, 'retrieval=') THEN 2 ELSE 1 END AS place FROM s""")
def summary_order(spark, d):
    f = evaluation.answer_flags(answers(spark, d))
    more = F.when(F.col("retrieval_hit") == 1, F.array(F.lit("retrieval=hit"))).when(F.col("retrieval_hit") == 0, F.array(F.lit("retrieval=miss"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array(F.lit("ALL"), F.concat(F.lit("doc="), "doc"), F.concat(F.lit("lang="), "lang")), more)
    return f.select(F.explode(names).alias("slice")).distinct().select("slice", evaluation.summary_order(F.col("slice")).alias("place"))


@registered("""SELECT retriever, items, round(seconds, 4) AS seconds, round(ms, 4) AS ms FROM (SELECT event_type AS retriever, count(*) AS items, sum(value) AS seconds, avg(value) AS ms FROM events GROUP BY event_type)""")
def index_costs(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("retriever"), F.lit(1).cast("long").alias("items"), F.col("value").alias("seconds"), F.col("value").alias("ms"))
    return evaluation.index_costs(e, e).select("retriever", "items", F.round("seconds", 4).alias("seconds"), F.round("ms", 4).alias("ms"))


@registered("""SELECT doc_id AS id, max(quality)::DOUBLE AS chunks, max(toxic)::DOUBLE AS truths FROM labels GROUP BY doc_id""")
def compared_rows(spark, d):
    lab = table(spark, d, "labels")
    rows = lab.select(F.col("doc_id").alias("id"), F.explode(F.array(F.struct(F.lit("chunks").alias("mode"), F.col("quality").cast("double").alias("score")), F.struct(F.lit("truths").alias("mode"), F.col("toxic").cast("double").alias("score")))).alias("r"))
    return evaluation.compared_rows(rows.select("id", "r.*"), ("chunks", "truths"))


@registered("""SELECT source AS doc_id, count(*) AS n FROM documents WHERE regexp_replace(text, '[ \\t]{2,}', ' ', 'g') <> text GROUP BY source""".replace("\\\\", "\\"))
def change_counts(spark, d):
    squeezed = F.regexp_replace("text", r"[ \t]{2,}", " ")
    return rollup.change_counts(table(spark, d, "documents").where(squeezed != F.col("text")).select(F.col("source").alias("doc_id")))


@registered("""WITH e AS (SELECT user_id, event_id, ts, ['building', 'ready', 'summarizing', 'summarized', 'error'][CAST(1 + event_id % 5 AS INTEGER)] AS state FROM events),
l AS (SELECT user_id, max(ts) AS ts, arg_max(state, struct_pack(t := ts, s := state)) AS last, max(CASE WHEN state = 'error' THEN 0 ELSE list_position(['building', 'ready', 'summarizing', 'summarized'], state) END) AS best FROM e GROUP BY user_id)
SELECT user_id AS doc_id, CASE WHEN last IN ('error', 'building') THEN last ELSE ['building', 'ready', 'summarizing', 'summarized'][best] END AS state, ts FROM l""")
def job_states(spark, d):
    names = F.array(*map(F.lit, (*progress.JOB_ORDER, "error")))
    return progress.job_states(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.element_at(names, (1 + F.col("event_id") % 5).cast("int")).alias("state"), "ts"))


@registered("SELECT user_id AS thread, event_type AS pause, min(ts) AS ts, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def accepted_answers(spark, d):
    return progress.accepted_answers(table(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("event_type").alias("pause"), "ts", "event_id"))


@registered(r"""SELECT doc_id, array_to_string(w[1:8], ' ') AS topic, array_to_string(w[1:40], ' ') AS description FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 1""")
def text_cards(spark, d):
    topic, description = study.text_card(F.col("text"))
    return table(spark, d, "documents").where(tx.word_count(F.col("text")) > 1).select("doc_id", topic.alias("topic"), description.alias("description"))
