"""Batched retrieval: every question of a batch at once, by joins and windows over (q, unit) rows.

Hits have the columns (q, unit, score, rank). Text is joined last. Orders are total: by score rounded to six places, then by unit.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shipping
from ..functions import text as tx
from ..sources import store
from . import index, streamed

K1, B = 1.5, 0.75
RRF_K, CANDIDATES, POOL = 60, 50, 30
#: Queries of a vector search that are broadcast together, and hits whose units are.
QUERIES, FEW = 1024, 200_000


def top_k(scores: DataFrame, k: int, *ties: Column | str) -> DataFrame:
    """The k best rows of each question with their rank; Spark cuts groups before and after the shuffle."""
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 6)), *(ties or ("unit",)))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def question_terms(questions: DataFrame) -> DataFrame:
    """(q, scope, term): the distinct terms of each question (q, scope, text). Blank questions have none."""
    return questions.select("q", "scope", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))


def bm25_hits(weights: DataFrame, questions: DataFrame, k: int | None = None) -> DataFrame:
    """(q, unit, score) > 0 of an index: of packed postings, shard by shard, with ``k`` at least the k best of each question; of BM25 weights
    (scope, term, unit, w) by one join and one sum."""
    if "shard" in weights.columns:
        return streamed.shard_hits(weights, questions, k)
    terms, keys = index.keys_of(weights, question_terms(questions))
    return weights.join(terms, keys).groupBy("q", "unit").agg(F.sum("w").alias("score")).where("score > 0")


def bm25_scores(units: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, unit, score) > 0 of units (scope, unit, text): idf is ln(n / df), so terms of every unit count nothing."""
    terms = question_terms(questions)
    tokens = index.tokenised(units)
    stats = index.statistics(tokens)
    posting = index.postings(tokens, terms.select("scope", "term").distinct())
    return bm25_hits(index.bm25_weights(posting, stats, K1, B), questions)


def bm25(units: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """The k best units of each question of a batch, in one scan of the texts and without an index."""
    return top_k(streamed.bm25(units, questions, k, K1, B), k)


def tfidf_hits(weights: DataFrame, idf: DataFrame, questions: DataFrame, char_mode: bool = False) -> DataFrame:
    """(q, unit, score) > 0: cosine of questions with the rows of an index (scope, unit, term, w). Terms that the index lacks are ignored."""
    asked = index.spread_grams(questions, "q", char_mode).groupBy("scope", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms, keys = index.keys_of(idf, asked)
    query = terms.join(idf, keys).select("scope", F.col("unit").alias("q"), "term", (F.col("tf") * F.col("idf")).alias("qraw"))
    norms = query.groupBy("q").agg(F.sqrt(F.sum(F.col("qraw") * F.col("qraw"))).alias("qnorm"))
    terms, keys = index.keys_of(weights, query)
    sums = weights.join(terms, keys).groupBy("q", "unit").agg(F.sum(F.col("w") * F.col("qraw")).alias("s"))
    return sums.join(norms, "q").select("q", "unit", (F.col("s") / F.col("qnorm")).alias("score")).where("score > 0")


def tfidf_scores(units: DataFrame, questions: DataFrame, char_mode: bool = False) -> DataFrame:
    """(q, unit, score) > 0 of units (scope, unit, text), their index made on the way."""
    return tfidf_hits(*index.tfidf_tables(units, char_mode), questions, char_mode)


def tfidf(units: DataFrame, questions: DataFrame, k: int = 10, char_mode: bool = False) -> DataFrame:
    """The k best units of each question of a batch by cosine, without an index."""
    return top_k(streamed.tfidf(units, questions, k, char_mode), k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact inner-product search of a query set (q, qv) against all vectors (unit, v).

    Vectors stream past the queries in Arrow blocks; every block keeps its own k best of each question, so the shuffle holds k
    rows for each block and question, never all pairs. Queries are broadcast ``QUERIES`` at a time, each block with its own pass over the vectors.
    """
    spark = vectors.sparkSession
    shipping.ship(spark)
    unit_type, q_type = vectors.schema["unit"].dataType.simpleString(), queries.schema["q"].dataType.simpleString()
    schema = f"q {q_type}, unit {unit_type}, score double"

    def best_of(sent):
        def run(frames):
            ids, matrix = sent.value
            for frame in frames:
                if not len(frame):
                    continue
                scores = np.stack(frame["v"].to_numpy()).astype(np.float64) @ matrix.T
                units = frame["unit"].to_numpy()
                parts = []
                for j, q in enumerate(ids):
                    best = np.lexsort((units, -np.round(scores[:, j], 6)))[:k]
                    parts.append(pd.DataFrame({"q": q, "unit": units[best], "score": scores[best, j]}))
                yield pd.concat(parts)

        return vectors.select("unit", "v").mapInPandas(run, schema)

    asked, found = queries.select("q", "qv").orderBy("q").toLocalIterator(), None
    while block := list(islice(asked, QUERIES)):
        part = best_of(spark.sparkContext.broadcast(([r["q"] for r in block], np.array([r["qv"] for r in block], dtype=np.float64))))
        found = part if found is None else found.unionByName(part)
    return top_k(spark.createDataFrame([], schema) if found is None else found, k)


def rrf(first: DataFrame, second: DataFrame, k: int, constant: int = RRF_K, depth: int = CANDIDATES) -> DataFrame:
    """Reciprocal rank fusion; ties keep the first list's order, then the second's."""
    both = first.select("q", "unit", F.col("rank").alias("r"), F.col("rank").alias("seen")).unionByName(second.select("q", "unit", F.col("rank").alias("r"), (F.lit(depth) + F.col("rank")).alias("seen")))
    fused = both.groupBy("q", "unit").agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("r"))).alias("score"), F.min("seen").alias("seen"))
    return top_k(fused, k, "seen", "unit").drop("seen")


def threshold_for(mode: Column) -> Column:
    """Least cosine by analyser."""
    return F.when(mode == "char", 0.03).when(mode == "word", 0.08).otherwise(0.05)


def deduped_pages(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Hits (q, unit, page, score, rank): the first-ranked unit of each page, with the page's best score, ranked anew."""
    best = hits.groupBy("q", "page").agg(F.min_by("unit", "rank").alias("unit"), F.max("score").alias("score"), F.min("rank").alias("first"))
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("first"))).drop("first")
    return out if k is None else out.where(F.col("rank") <= k)


def collapsed_parents(hits: DataFrame, k: int) -> DataFrame:
    """Child hits (q, unit, parent, page, score, rank) to parents, each once at its best child's place."""
    best = hits.groupBy("q", "parent").agg(F.min_by(F.struct("page", "score", "unit"), "rank").alias("b"), F.min("rank").alias("first"))
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("first")))
    return out.where(F.col("rank") <= k).select("q", F.col("parent").alias("unit"), "b.page", "b.score", "rank")


def page_capped(hits: DataFrame, k: int, per_page: int = 2) -> DataFrame:
    """At most ``per_page`` hits of a page in rank order; pages without a number are skipped."""
    inside = Window.partitionBy("q", "page").orderBy("rank")
    left = hits.where("page > 0").withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= per_page).drop("_n")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("rank") <= k)


def mmr_order(relevance: np.ndarray, similarity: np.ndarray, size: int, trade: float = 0.75) -> list[int]:
    """Maximal marginal relevance: best first, then relevance against the closest chosen one; first maximum wins."""
    if not len(relevance):
        return []
    chosen = [int(relevance.argmax())]
    closest = np.maximum(similarity[chosen[0]], 0.0)
    while len(chosen) < min(size, len(relevance)):
        value = trade * relevance - (1 - trade) * closest
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
        closest = np.maximum(closest, similarity[chosen[-1]])
    return chosen


def mmr(units: DataFrame, candidates: DataFrame, size: int, trade: float = 0.75, char_mode: bool = False) -> DataFrame:
    """(q, unit, page, score, rank): each question's candidates (q, unit, score, scope, norm, rank), of one block of questions, in the order of ``mmr_order``."""
    return streamed.reordered(units, candidates, lambda relevance, similarity: mmr_order(relevance, similarity, size, trade), char_mode)


def tfidf_pipeline(units: DataFrame, questions: DataFrame, k: int = 10, mode: str = "word") -> DataFrame:
    """5 k candidates, threshold, MMR to 3 k by cosine, at most two per page, k hits; the score stays the cosine. Units carry ``page``.
    Texts stream past the questions: no index of all terms is made."""
    ordered = None
    for hits in streamed.tfidf_blocks(units, questions, 5 * k, mode == "char"):
        first = top_k(hits, 5 * k).where(F.col("score") >= threshold_for(F.lit(mode)))
        part = mmr(units, first, 3 * k, char_mode=mode == "char")
        ordered = part if ordered is None else ordered.unionByName(part)
    if ordered is None:
        types = {c: df.schema[c].dataType.simpleString() for df, c in ((questions, "q"), (units, "unit"), (units, "page"))}
        ordered = units.sparkSession.createDataFrame([], f"q {types['q']}, unit {types['unit']}, page {types['page']}, score double, rank int")
    return page_capped(ordered, k)


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def lexical_overlap(questions: pd.Series, texts: pd.Series) -> pd.Series:
    """The default re-ranker: the share of a question's words that a text holds. Deterministic; no model is bundled."""
    def one(q: str, t: str) -> float:
        asked = set(q.lower().split())
        return len(asked & set(t.lower().split())) / len(asked) if asked else 0.0

    return pd.Series([one(q, t) for q, t in zip(questions, texts, strict=True)])


def reranked(hits: DataFrame, questions: DataFrame, texts: DataFrame, k: int, scorer: Scorer = lexical_overlap, pool: int = POOL) -> DataFrame:
    """The pool's hits rescored by ``scorer(question texts, unit texts)``; equal scores keep their order. At most ``pool`` come back.

    Hits are stored first: where they are few, their units are broadcast, and no other texts are shuffled.
    """
    shipping.ship(hits.sparkSession)
    score = F.pandas_udf(scorer, "double")
    held = store.scratch(hits.where(F.col("rank") <= pool).select("q", "unit", "rank"), "pool")
    found = held.select("unit").distinct()
    found = texts.join(F.broadcast(found) if held.count() <= FEW else found, "unit", "left_semi")
    few = held.join(questions.select("q", F.col("text").alias("_qt")), "q").join(found.select("unit", F.col("text").alias("_ut")), "unit")
    scored = few.select("q", "unit", F.col("rank").alias("_was"), score("_qt", "_ut").alias("score"))
    return top_k(scored, k, "_was").drop("_was")


def with_text(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Late enrichment: ids without a row are dropped, ranks stay."""
    return hits.join(texts, "unit")


def agent_rounds(search: Callable[[DataFrame, int], DataFrame], questions: DataFrame, rounds: int = 3, first: int = 5, extra: int = 2, keep: int = 5) -> DataFrame:
    """The bounded loop of an answering agent: ``first`` hits, then ``extra`` new ones a round for the follow-up query, ``keep`` at most.

    ``questions``: (q, scope, text, follow_ups array<string>); a blank or repeated follow-up ends a question's loop.
    """
    found = search(questions.select("q", "scope", "text"), first).select("q", "unit", F.lit(0).alias("hop"), "rank")
    for hop in range(1, rounds):
        asked = F.get("follow_ups", F.lit(hop - 1))
        earlier = F.concat(F.array("text"), F.slice("follow_ups", 1, hop - 1)) if hop > 1 else F.array("text")
        live = questions.where(asked.isNotNull() & (F.trim(asked) != "") & ~F.array_contains(earlier, asked)).select("q", "scope", asked.alias("text"))
        new = search(live, extra).join(found.select("q", "unit"), ["q", "unit"], "left_anti").select("q", "unit", F.lit(hop).alias("hop"), "rank")
        merged = found.unionByName(new)
        room = Window.partitionBy("q").orderBy(F.desc(F.col("hop") == hop), "hop", "rank")
        found = merged.withColumn("_n", F.row_number().over(room)).where(F.col("_n") <= keep).drop("_n")
    return found


def search(questions: DataFrame, chunks: Callable[[DataFrame], DataFrame], children: Callable[[DataFrame], DataFrame] | None = None, k: int = 8) -> DataFrame:
    """The entry of an application: (q, unit, page, score, rank) for questions (q, scope, text).

    Blank questions and k of at most 0 find nothing. Child hits (q, unit, parent, page, score, rank) are collapsed to parents where
    a question's scope has children, else its chunks are searched.
    """
    live = questions.where(F.trim(F.coalesce("text", F.lit(""))) != "").where(F.lit(k) > 0)
    if children is None:
        return chunks(live).where(F.col("rank") <= k).select("q", "unit", "page", "score", "rank")
    found = collapsed_parents(children(live), k).select("q", "unit", "page", "score", "rank")
    rest = live.join(found.select("q").distinct(), "q", "left_anti")
    return found.unionByName(chunks(rest).where(F.col("rank") <= k).select("q", "unit", "page", "score", "rank"))


def with_cards(hits: DataFrame, cards: DataFrame) -> DataFrame:
    """Hits with their chunk's card (chunk_id, topic, description), null where there is none."""
    return hits.join(cards.select(F.col("chunk_id").alias("unit"), F.col("topic").alias("card_topic"), F.col("description").alias("card_description")), "unit", "left")


def retriever_parts(name: Column) -> tuple[Column, Column]:
    """``bm25@150o40`` to its retriever and its unit; without a unit it searches chunks."""
    parts = F.split(name, "@")
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit("chunks"))
