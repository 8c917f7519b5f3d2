"""Retrieval and answer metrics over slices, as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20, 50)


def gold_groups(groups: Column, pages: Column) -> Column:
    """Non-empty groups; else the old single page list as one group; else none."""
    none = F.array().cast("array<array<int>>")
    full = F.filter(groups, lambda g: F.size(g) > 0)
    return F.when(F.size(F.coalesce(full, none)) > 0, full).when(F.size(F.coalesce(pages, F.array().cast("array<int>"))) > 0, F.array(pages)).otherwise(none)


def hit_ranks(ranking: Column, groups: Column) -> tuple[Column, Column]:
    """(first, full): the best place of any gold page, and the place by which every group is hit; 0 where there is none."""
    def place(group: Column) -> Column:
        spots = F.filter(F.transform(group, lambda p: F.array_position(ranking, p)), lambda x: x > 0)
        return F.coalesce(F.array_min(spots), F.lit(0).cast("long"))

    spots = F.transform(groups, place)
    hit = F.filter(spots, lambda x: x > 0)
    first = F.coalesce(F.array_min(hit), F.lit(0).cast("long"))
    full = F.when((F.size(spots) > 0) & (F.size(hit) == F.size(spots)), F.array_max(spots)).otherwise(F.lit(0).cast("long"))
    return first, full


def per_question(rankings: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question and retriever: (retriever, q, doc, lang, level, n_groups, first, full, nothing)."""
    ranked = rankings.groupBy("retriever", "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"]).alias("ranking"))
    names = rankings.select("retriever").distinct()
    base = questions.crossJoin(F.broadcast(names)) if "retriever" not in questions.columns else questions
    joined = base.join(ranked, ["retriever", "q"], "left").withColumn("ranking", F.coalesce("ranking", F.array().cast("array<int>")))
    first, full = hit_ranks(F.col("ranking"), F.col("groups"))
    return joined.select("retriever", "q", "doc", "lang", "level", F.size("groups").alias("n_groups"), first.alias("first"), full.alias("full"), (F.size("ranking") == 0).alias("nothing"))


def slices(level: str = "L5") -> Column:
    """Slices of a question; one without gold enters only its level's."""
    base = F.array(F.lit("ALL"), F.concat(F.lit("doc="), "doc"), F.concat(F.lit("lang="), "lang"), F.concat(F.lit("level="), "level"))
    several = F.when(F.col("n_groups") > 1, F.array(F.lit("multi-part"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("n_groups") > 0, F.concat(base, several)).otherwise(F.array(F.concat(F.lit("level="), F.coalesce("level", F.lit(level)))))


def summary(rows: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Recall@k, MRR, Full@k and NoAnswer of each retriever and slice; questions without gold count only for NoAnswer."""
    has_gold = F.col("n_groups") > 0

    def share(name: str, k: int) -> Column:
        return F.round(F.avg(F.when(has_gold, F.col(name).between(1, k).cast("double"))), 4)

    return (
        rows.withColumn("slice", F.explode(slices()))
        .groupBy("retriever", "slice")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *(share("first", k).alias(f"recall_{k}") for k in ks),
            F.round(F.avg(F.when(has_gold, F.when(F.col("first") > 0, 1.0 / F.col("first")).otherwise(0.0))), 4).alias("mrr"),
            *(share("full", k).alias(f"full_{k}") for k in ks),
            F.round(F.avg(F.col("nothing").cast("double")), 4).alias("no_answer"),
        )
    )


def size_comparison(summaries: DataFrame) -> DataFrame:
    """(retriever@unit rows) to one row per retriever and unit with level and language MRR as columns, the best MRR marked."""
    named = summaries.withColumn("base", F.split("retriever", "@")[0]).withColumn("unit", F.coalesce(F.get(F.split("retriever", "@"), F.lit(1)), F.lit("512")))
    wide = named.groupBy("base", "unit").agg(
        F.max(F.when(F.col("slice") == "ALL", F.col("mrr"))).alias("mrr"),
        *(F.max(F.when(F.col("slice") == f"lang={g}", F.col("mrr"))).alias(f"mrr_{g}") for g in ("en", "fr")),
        *(F.max(F.when(F.col("slice") == f"level=L{i}", F.col("mrr"))).alias(f"mrr_l{i}") for i in (1, 2, 3, 4)),
    )
    return wide.withColumn("best", F.col("mrr").eqNullSafe(F.max("mrr").over(Window.partitionBy("base"))))


def answer_flags(answers: DataFrame) -> DataFrame:
    """Citation and retrieval flags of answers (…, shown, cited, groups)."""
    gold = F.array_distinct(F.flatten("groups"))
    has_gold = F.size("groups") > 0
    return answers.withColumns(
        {
            "cite_valid": ((F.size("cited") > 0) & (F.size(F.array_except("cited", "shown")) == 0)).cast("int"),
            "cite_gold": F.when(has_gold, F.arrays_overlap("cited", gold).cast("int")),
            "retrieval_hit": F.when(has_gold, F.arrays_overlap("shown", gold).cast("int")),
            "retrieval_full": F.when(has_gold, F.forall("groups", lambda g: F.arrays_overlap(g, F.col("shown"))).cast("int")),
        }
    )


def faithfulness(verdicts: Column) -> Column:
    """Supported claims over claims; an ambiguous verdict supports nothing; null without claims."""
    return F.when(F.size(verdicts) > 0, F.size(F.filter(verdicts, lambda v: v["verdict"] == "yes")) / F.size(verdicts))


def unsupported(claims: Column, verdicts: Column) -> Column:
    """Claims whose verdict is not yes, with the reason."""
    pairs = F.arrays_zip(claims.alias("claim"), verdicts.alias("v"))
    return F.transform(F.filter(pairs, lambda x: x["v"]["verdict"] != "yes"), lambda x: F.concat(x["claim"], F.lit(" — "), F.coalesce(x["v"]["reason"], F.lit(""))))


def generation_summary(rows: DataFrame) -> DataFrame:
    """Answer metrics of each slice; the mean of nothing is null."""
    gold, judged, found = F.col("retrieval_hit").isNotNull(), F.col("faithfulness").isNotNull(), F.col("found") == 1
    names = F.array(F.lit("ALL"), F.concat(F.lit("doc="), "doc"), F.concat(F.lit("lang="), "lang"), F.concat(F.lit("level="), "level"))
    more = F.when(F.col("retrieval_hit") == 1, F.array(F.lit("retrieval=hit"))).when(gold, F.array(F.lit("retrieval=miss"))).otherwise(F.array().cast("array<string>"))

    def mean(when: Column, value: Column) -> Column:
        return F.round(F.avg(F.when(when, value.cast("double"))), 4)

    return (
        rows.withColumn("slice", F.explode(F.concat(names, more)))
        .groupBy("slice")
        .agg(
            F.count(F.lit(1)).alias("n"),
            mean(F.col("hops").isNotNull(), F.col("hops")).alias("hops"),
            mean(gold, F.col("retrieval_hit")).alias("retrieval_hit"),
            mean(gold, F.col("found")).alias("answered"),
            mean(~gold, 1 - F.col("found")).alias("abstain"),
            F.count(F.when(judged, 1)).alias("judged"),
            mean(judged, F.col("faithfulness")).alias("faithfulness"),
            mean(judged, F.col("faithfulness") == 1.0).alias("fully_faithful"),
            mean(found, F.col("cite_valid")).alias("cite_valid"),
            mean(found & F.col("cite_gold").isNotNull(), F.col("cite_gold")).alias("cite_gold"),
        )
    )


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Confusion counts, observed and expected agreement, Cohen's kappa (1 where chance alone agrees always)."""
    counts = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count(F.when((F.col(a) == x) & (F.col(b) == y), 1)).alias(f"n{x}{y}") for x in (1, 0) for y in (1, 0)),
    )
    n = F.col("n").cast("double")
    po = (F.col("n11") + F.col("n00")) / n
    pe = ((F.col("n11") + F.col("n10")) / n) * ((F.col("n11") + F.col("n01")) / n) + ((F.col("n00") + F.col("n01")) / n) * ((F.col("n00") + F.col("n10")) / n)
    safe = counts.where("n > 0").withColumn("po", po).withColumn("pe", pe)
    return safe.withColumn("kappa", F.when(F.col("pe") == 1.0, 1.0).otherwise((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))))


def label_sheet(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Half unfaithful, half faithful answers for human labels, by a seeded hash."""
    judged, half = rows.where("faithfulness is not null"), size // 2
    picked = [judged.where(kind).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(half) for kind in ("faithfulness < 1.0", "faithfulness >= 1.0")]
    return picked[0].unionByName(picked[1])


def question_rows(rows: DataFrame, rankings: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Per-question rows with the first five pages, hits at each k and the reciprocal rank; without gold all of these are null."""
    top = rankings.where("rank <= 5").groupBy("retriever", "q").agg(*(F.max(F.when(F.col("rank") == i, F.col("page"))).alias(f"top{i}") for i in range(1, 6)))
    gold = F.col("n_groups") > 0
    at = [F.when(gold, F.col(c).between(1, k).cast("int")).alias(f"{n}_{k}") for c, n in (("first", "hit"), ("full", "full")) for k in ks]
    rr = F.when(gold, F.when(F.col("first") > 0, F.round(1.0 / F.col("first"), 4)).otherwise(0.0)).alias("rr")
    rank = [F.when(gold & (F.col(c) > 0), F.col(c)).alias(f"{c}_rank") for c in ("first", "full")]
    return rows.join(top, ["retriever", "q"], "left").select("retriever", "q", "doc", "lang", "level", "n_groups", *(f"top{i}" for i in range(1, 6)), *rank, *at, rr, F.col("nothing").cast("int").alias("nothing"))


def top_texts(hits: DataFrame, groups: DataFrame, n: int = 5) -> DataFrame:
    """The first n hits (q, page, score, rank) of each question and whether their page is gold (q, groups)."""
    gold = F.array_distinct(F.flatten("groups"))
    few = hits.where(F.col("rank") <= n).join(groups.select("q", gold.alias("_gold")), "q", "left")
    return few.select(*hits.columns, F.coalesce(F.array_contains("_gold", F.col("page")), F.lit(False)).cast("int").alias("is_gold"))


def summary_order(slice_: Column) -> Column:
    """Sort key of a slice: ALL first, retrieval slices last."""
    return F.when(slice_ == "ALL", 0).when(slice_.startswith("retrieval="), 2).otherwise(1)


def index_costs(builds: DataFrame, searches: DataFrame) -> DataFrame:
    """(retriever, items, seconds, ms): builds (retriever, items, seconds) summed, mean milliseconds of searches (retriever, ms)."""
    made = builds.groupBy("retriever").agg(F.sum("items").alias("items"), F.sum("seconds").alias("seconds"))
    return made.join(searches.groupBy("retriever").agg(F.avg("ms").alias("ms")), "retriever", "left")


def compared_rows(judged: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Scores (id, mode, score) of several judging modes side by side; an id that a mode lacks is null there."""
    return judged.groupBy("id").agg(*(F.max(F.when(F.col("mode") == m, F.col("score"))).alias(m) for m in modes))
