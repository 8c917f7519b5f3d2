"""Queries over page text, chunks, sinks and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs
from ..operators import chunking, cleaning, rollup
from ..sources import tables
from ..sources.tables import corpus, table
from .catalogue import ORACLES, registered

SPACE = r"'^\s+|\s+$', '', 'g'"
CORPUS = "SELECT source AS book, CAST(doc_id + 1 AS INTEGER) AS page_no, text FROM documents"


def pages(spark, d):
    return corpus(spark, d).select(F.col("book").alias("doc_id"), "page_no", "text", "lang")


@registered(rf"""SELECT source AS doc_id, round(avg(CASE WHEN length(regexp_replace(text, {SPACE})) < 200 THEN 1.0::DOUBLE ELSE 0 END), 6) AS empty_ratio,
avg(CASE WHEN length(regexp_replace(text, {SPACE})) < 200 THEN 1.0::DOUBLE ELSE 0 END) >= 0.1 AS needs_ocr FROM documents GROUP BY source""")
def needs_ocr_by_source(spark, d):
    return cleaning.needs_ocr(pages(spark, d), 200, 0.1).withColumn("empty_ratio", F.round("empty_ratio", 6))


@registered(r"""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^\x{3400}-\x{9fff}]', '', 'g')) AS han,
len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents""")
def lang_ratio(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.latin_count(t).cast("long").alias("latin"), tx.han_count(t).cast("long").alias("han"), tx.word_count(t).cast("long").alias("words"))


@registered(rf"""WITH l AS (SELECT source AS doc_id, doc_id AS page, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(lower(regexp_replace(x, {SPACE})), '\s+', ' ', 'g')), lambda x: x <> '') AS l FROM documents),
e AS (SELECT doc_id, page, unnest(list_concat(l[1:2], l[greatest(1, len(l) - 1):len(l)])) AS key FROM l),
w AS (SELECT doc_id, key, sum(CASE WHEN regexp_matches(key, '(?i)^\s*(page\s*)?\d+\s*$') OR regexp_matches(key, '^\s*[-—_=]{{3,}}\s*$') THEN 2 ELSE 1 END) AS weight FROM e WHERE length(key) >= 3 GROUP BY doc_id, key),
n AS (SELECT source AS doc_id, count(*) AS n FROM documents GROUP BY source)
SELECT doc_id, key, CAST(weight AS BIGINT) AS weight FROM w JOIN n USING (doc_id) WHERE weight >= greatest(1, floor(n * 0.04))""")
def repeated_lines(spark, d):
    return cleaning.repeated_lines(pages(spark, d), 0.04)


REPEATED = ORACLES["repeated_lines"].removeprefix("WITH ")


@registered(rf"""WITH {REPEATED.replace("SELECT doc_id, key, CAST", ", rep AS (SELECT doc_id, key, CAST", 1)}),
line AS (SELECT source AS doc_id, CAST(doc_id + 1 AS INTEGER) AS page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM documents),
kept AS (SELECT l.* FROM line l ANTI JOIN rep r ON r.doc_id = l.doc_id AND r.key = regexp_replace(lower(regexp_replace(l.line, {SPACE})), '\s+', ' ', 'g'))
SELECT p.source AS doc_id, CAST(p.doc_id + 1 AS INTEGER) AS page_no, coalesce(regexp_replace(string_agg(k.line, chr(10) ORDER BY k.at), {SPACE}), '') AS text
FROM documents p LEFT JOIN kept k ON k.doc_id = p.source AND k.page_no = p.doc_id + 1 GROUP BY p.source, p.doc_id""")
def pages_without_repeated_lines(spark, d):
    return cleaning.without_repeated_lines(pages(spark, d), 0.04)


@registered(rf"""SELECT doc_id, regexp_replace(regexp_replace(list_aggregate(list_transform(string_split(text, chr(10)), lambda x:
  regexp_replace(regexp_replace(CASE WHEN length(regexp_replace(x, {SPACE})) <= 220 THEN regexp_replace(regexp_replace(x, {SPACE}), '^\s*([•·●▪◦‣]|(\(\d+\))|(\d+[\.\)]))\s+', '') ELSE regexp_replace(x, {SPACE}) END, '[ \t]{{2,}}', ' ', 'g'), {SPACE})),
  'string_agg', chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {SPACE}) AS text
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)(https?://\S+|www\.\S+)', '', 'g'), '[ \t]*\.(?:[ \t]+\.){{4,}}[ \t]*', ' ', 'g'), '([A-Za-z])-\n\s*([A-Za-z])', '\1\2', 'g') AS text FROM documents)""")
def clean_text_rules(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_page(F.col("text")).alias("text"))


@registered()
def nfkc_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_page(udfs.nfkc("text")).alias("text"))


@registered(r"""WITH n AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\(?\s*continue[sd] (?:from previous|on next) page\s*\)?', '', 'g'), '[ \t]*\.(?:[ \t]+\.){4,}[ \t]*', ' ', 'g'), '\s*↩→\s*', ' ', 'g') AS c1 FROM documents),
t AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c1, '[ \t]{2,}', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS new_text FROM n WHERE c1 <> text)
SELECT doc_id, new_text, CASE WHEN length(new_text) < 3 THEN 'delete' ELSE 'update' END AS action FROM t""")
def noise_diff(spark, d):
    return cleaning.noise_changes(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "new_text", "action")


@registered(rf"""SELECT book, max(page_no) AS last_page, count(*) AS n_chunks, substr(regexp_replace(regexp_replace(arg_min(text, page_no), '\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 60) AS preview FROM ({CORPUS}) GROUP BY book""")
def doc_listing(spark, d):
    preview = tx.snippet(F.min_by("text", "page_no"), 60)
    return corpus(spark, d).groupBy("book").agg(F.max("page_no").alias("last_page"), F.count(F.lit(1)).alias("n_chunks"), preview.alias("preview"))


@registered("SELECT source AS doc_id, CAST(doc_id + 1 AS INTEGER) AS page_no, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents".replace("\\\\", "\\"))
def page_text(spark, d):
    lines = pages(spark, d).select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return cleaning.page_text(lines).withColumn("text", tx.stripped(F.col("text")))


@registered("""SELECT CAST(pos AS INTEGER) AS pos, d.doc_id, d.source FROM (SELECT unnest([0, 1, 2, 3]) AS pos, unnest([5, 3, 99999999, 5]) AS doc_id) i JOIN documents d ON d.doc_id = i.doc_id""")
def ordered_lookup(spark, d):
    return tables.in_order(table(spark, d, "documents"), [5, 3, 99999999, 5], "doc_id").select("pos", "doc_id", "source")


@registered(r"SELECT doc_id AS card FROM documents WHERE regexp_replace(text, '[ \t]{2,}', ' ', 'g') = text")
def kept_cards(spark, d):
    """A card for each chunk; the new version of a chunk has its blanks squeezed, so cards of changed chunks go."""
    old = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    new = old.withColumn("text", F.regexp_replace("text", r"[ \t]{2,}", " "))
    return tables.kept_cards(old.select("chunk_id", F.col("chunk_id").alias("card")), old, new).select("card")


@registered("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_todo(spark, d):
    return tables.resumable(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@registered("SELECT source AS file_hash, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_wins_source(spark, d):
    return tables.first_hash_wins(table(spark, d, "documents").select(F.col("source").alias("file_hash"), "doc_id"), "file_hash", ["doc_id"])


@registered("SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def first_wins_hash(spark, d):
    return tables.first_hash_wins(table(spark, d, "documents").select(F.sha2("text", 256).alias("file_hash"), "doc_id"), "file_hash", ["doc_id"])


@registered("SELECT doc_id, sha1('max_length=512' || chr(0) || text) AS fingerprint FROM documents")
def fingerprint_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.fingerprint(F.array("text")).alias("fingerprint"))


@registered("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(100 + doc_id AS INTEGER) ELSE CAST(100 + doc_id AS INTEGER) END AS words, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE doc_id % 50 END AS INTEGER) AS overlap FROM documents""")
def unit_codec(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, (100 + F.col("doc_id")).cast("string")).otherwise(F.concat_ws("o", (100 + F.col("doc_id")).cast("string"), (F.col("doc_id") % 50).cast("string")))
    return table(spark, d, "documents").withColumn("name", name).select("doc_id", tx.unit_words(F.col("name")).alias("words"), tx.unit_overlap(F.col("name")).alias("overlap"))


@registered("""SELECT doc_id, CAST(len(list_filter(g, lambda x: len(x) > 0)) AS INTEGER) AS n, array_to_string(list_transform(list_filter(g, lambda x: len(x) > 0), lambda x: array_to_string(x, ' ')), '|') AS groups FROM (
SELECT doc_id, list_transform(string_split((doc_id % 9) || ' | ' || (doc_id % 7) || ' ' || (doc_id % 5) || ' ' || (doc_id % 7) || '| |x', '|'), lambda p: list_sort(list_distinct(list_transform(regexp_extract_all(p, '\\d+'), lambda y: y::INTEGER)))) AS g FROM documents)""".replace("\\\\", "\\"))
def parse_groups(spark, d):
    i = F.col("doc_id")
    raw = F.concat((i % 9).cast("string"), F.lit(" | "), (i % 7).cast("string"), F.lit(" "), (i % 5).cast("string"), F.lit(" "), (i % 7).cast("string"), F.lit("| |x"))
    g = tx.parsed_groups(raw)
    return table(spark, d, "documents").select("doc_id", F.size(g).alias("n"), F.array_join(F.transform(g, lambda x: F.array_join(x.cast("array<string>"), " ")), "|").alias("groups"))


@registered(r"""SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS answer_key, substr(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 40) AS snippet,
regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS has_han FROM documents""")
def text_scalars(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.answer_key(t).alias("answer_key"), tx.snippet(t, 40).alias("snippet"), tx.has_han(t).alias("has_han"))


@registered("""WITH e AS (SELECT source AS doc_id, doc_id AS pos, CAST(doc_id + 1 AS INTEGER) AS page, 't' || (doc_id % 13) AS title FROM documents),
s AS (SELECT doc_id, page AS start, arg_max(title, pos) AS title FROM e GROUP BY doc_id, page),
r AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS nxt FROM s), n AS (SELECT source AS doc_id, CAST(max(doc_id) + 1 AS INTEGER) AS num_pages FROM documents GROUP BY source)
SELECT doc_id, title, start, coalesce(nxt - 1, num_pages) AS "end" FROM r JOIN n USING (doc_id) WHERE start <= coalesce(nxt - 1, num_pages)""")
def toc_ranges(spark, d):
    return _toc(spark, d)


def _toc(spark, d):
    docs = table(spark, d, "documents")
    entries = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("pos"), F.lit(1).alias("level"), F.concat(F.lit("t"), (F.col("doc_id") % 13).cast("string")).alias("title"), (F.col("doc_id") + 1).cast("int").alias("page"))
    sizes = docs.groupBy(F.col("source").alias("doc_id")).agg((F.max("doc_id") + 1).cast("int").alias("num_pages"))
    return rollup.toc_ranges(entries, sizes)


@registered("""WITH e AS (SELECT source AS doc_id, CAST(doc_id + 1 AS INTEGER) AS start FROM documents),
r AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, (SELECT CAST(max(doc_id) + 1 AS INTEGER) FROM documents x WHERE x.source = e.doc_id)) AS "end" FROM e)
SELECT d.source AS doc_id, CAST(d.doc_id + 1 AS INTEGER) AS page_no, r.start FROM documents d JOIN r ON r.doc_id = d.source AND d.doc_id + 1 BETWEEN r.start AND r."end" """)
def range_join_sections(spark, d):
    return rollup.paged_ranges(pages(spark, d).select("doc_id", "page_no"), _toc(spark, d)).select("doc_id", "page_no", "start")


@registered("""WITH RECURSIVE p AS (SELECT source AS doc_id, CAST(doc_id + 1 AS INTEGER) AS page_no, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
w AS (SELECT doc_id, i, page_no, 1 AS part, size AS load FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, p.page_no, CASE WHEN w.load + p.size <= 12000 THEN w.part ELSE w.part + 1 END, CASE WHEN w.load + p.size <= 12000 THEN w.load + p.size ELSE p.size END
  FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id, CAST(part AS INTEGER) AS part, min(page_no) AS start, max(page_no) AS "end" FROM w GROUP BY doc_id, part""")
def section_windows(spark, d):
    return rollup.windows(pages(spark, d))


@registered("SELECT source AS doc_id, CAST(doc_id + 1 AS INTEGER) AS page_no, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS INTEGER) AS batch FROM documents")
def batch_slices(spark, d):
    return rollup.batches(pages(spark, d).select("doc_id", "page_no"), "doc_id", "page_no")


@registered("""SELECT source AS doc_id, CAST(doc_id // 10 AS INTEGER) AS page_no, string_agg('t' || doc_id || ': ' || lang, ' | ' ORDER BY doc_id) AS cards FROM documents GROUP BY source, doc_id // 10""")
def cards_by_page(spark, d):
    cards = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.expr("cast(doc_id div 10 as int)").alias("page_no"), F.col("doc_id").alias("chunk_index"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("topic"), F.col("lang").alias("description"))
    return rollup.cards_by_page(cards)


@registered("""WITH a AS (SELECT source AS doc_id, count(*) AS n_chunks FROM documents GROUP BY source), b AS (SELECT d.source AS doc_id, count(*) AS n_cards FROM documents d JOIN labels USING (doc_id) GROUP BY d.source)
SELECT doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_cards, 0) AS n_cards, coalesce(n_chunks, 0) > 0 AND coalesce(n_cards, 0) >= coalesce(n_chunks, 0) AS complete FROM a FULL JOIN b USING (doc_id)""")
def all_carded(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    cards = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("doc_id"))
    return rollup.all_carded(docs.select(F.col("source").alias("doc_id")), cards)


@registered()
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(udfs.sentence_split("text", F.lit("en"))).alias("i", "sentence"))


def _parents(spark, d):
    return chunking.parents(pages(spark, d).withColumn("lang", F.lit("en")))


@registered()
def pack_parents(spark, d):
    return _parents(spark, d)


@registered()
def children_balanced(spark, d):
    return chunking.children(_parents(spark, d).withColumn("lang", F.lit("en")), 150, 0)


@registered()
def children_overlap(spark, d):
    return chunking.children(_parents(spark, d).withColumn("lang", F.lit("en")), 150, 40)


@registered()
def salvage_replies(spark, d):
    reply = F.concat(F.lit('```json\n{"topic": {"id": '), F.col("doc_id").cast("string"), F.lit(', "formula": "\\alpha"}}\n```'))
    return table(spark, d, "documents").select("doc_id", udfs.salvage_json(reply).alias("reply"))
