"""Language-model steps as row operators: a prompt column goes in, a checked reply struct comes out.

No model is bundled. A model is ``call(step, prompts) -> replies`` over pandas strings. Replies that do not fit a step's schema are repaired, then
asked for again; what never fits is null, and each step's rule for a missing reply applies. ``extractive`` is the default: it copies from the
prompt and makes no quality claims. Prompts end with their pages (``[p.N] text`` blocks), so whatever else they hold comes before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shipping
from ..functions.udfs import salvaged

Model = Callable[[str, pd.Series], pd.Series]


class Step(NamedTuple):
    schema: str
    temperature: float
    order: str


POINTS = "array<struct<text: string, page: int>>"
# The fields of each step's reply, and temperatures.
STEPS = {
    "route": Step("intent string, scope string, follow_up boolean, topic string", 0.0, "Say what the message asks for and rewrite it as a search query."),
    "notes": Step(f"main_idea string, key_points {POINTS}, covered boolean, missing string, next_query string", 0.2, "Take notes on the topic and say whether the pages cover it."),
    "answer": Step("answer string, pages array<int>, found boolean", 0.2, "Answer from the pages alone and name the pages."),
    "flashcards": Step("cards array<struct<front: string, back: string, page: int>>", 0.5, "Write at most 8 flashcards."),
    "quiz": Step("questions array<struct<id: string, type: string, concept: string, question: string, options: array<string>, answer: string, page: int>>", 0.4, "Write 5 questions: 3 of type mcq, 1 fill_blank, 1 short."),
    "grade": Step("correct boolean, feedback string", 0.0, "Say whether the answer means what the reference answer means."),
    "review": Step(f"main_idea string, key_points {POINTS}", 0.3, "Explain the missed concepts again."),
    "fold": Step("summary string", 0.0, "Fold the messages into the running summary."),
    "cards": Step("cards array<struct<id: string, topic: string, description: string>>", 0.2, "Write one card for each chunk."),
    "section": Step(f"title string, main_idea string, key_points {POINTS}, key_terms array<string>", 0.3, "Summarise the section and mend what the reviewer lists."),
    "faithful": Step("unsupported array<string>", 0.0, "List the points that the pages do not support."),
    "overview": Step("subject string, overview string", 0.3, "Say what the whole document covers."),
    "claims": Step("claims array<string>", 0.0, "List the claims of the answer."),
    "verdicts": Step("verdicts array<string>", 0.0, "Judge each claim by the pages: yes, no or idk."),
}
ALLOWED = {"intent": ("ask", "summary", "flashcard", "quiz"), "scope": ("document", "topic"), "type": ("mcq", "fill_blank", "short")}
OPTIONAL = {"options"}
# End of fixed values.
TRIES = 3


def language_rule(lang: Column) -> Column:
    """The prompt's line on the language to write in."""
    return F.when(lang == "zh", "Write in Chinese.").otherwise("Write in English.")


def prompt(step: str, lang: Column, pages: Column | None = None, **parts: Column) -> Column:
    """A step's prompt: its order, the language, named parts, and the pages last. Null and blank parts are left out."""
    pieces = [F.lit(STEPS[step].order), language_rule(lang)]
    pieces += [F.when(F.trim(F.coalesce(part, F.lit(""))) != "", F.concat(F.lit(f"{name.capitalize()}:\n"), part)) for name, part in parts.items()]
    if pages is not None:
        pieces.append(F.concat(F.lit("Pages:\n"), F.coalesce(pages, F.lit(""))))
    return F.concat_ws("\n\n", *pieces)


def fitted(value, kind: T.DataType, name: str = ""):
    """A reply's value as a schema has it: integers and truth values may come as text. Raises ValueError where it does not fit."""
    if value is None and name in OPTIONAL:
        return None
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return {f.name: fitted(value.get(f.name), f.dataType, f.name) for f in kind.fields}
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [fitted(v, kind.elementType, name) for v in value]
    if isinstance(kind, T.StringType) and isinstance(value, str) and value in ALLOWED.get(name, (value,)):
        return value
    if isinstance(kind, T.IntegerType) and not isinstance(value, bool) and re.fullmatch(r"\s*[+-]?[0-9]+(\.0+)?\s*", str(value)):
        return int(float(str(value)))
    if isinstance(kind, T.BooleanType) and str(value).strip().lower() in ("true", "false"):
        return str(value).strip().lower() == "true"
    raise ValueError(name)


def usable(reply: str | None, kind: T.StructType) -> str | None:
    """A reply as JSON text that fits the schema, repaired if need be, or null."""
    found = salvaged(reply) if isinstance(reply, str) else None
    try:
        return None if found is None else json.dumps(fitted(found, kind), ensure_ascii=False)
    except ValueError:
        return None


def replied(rows: DataFrame, step: str, model: Model | None = None, tries: int = TRIES) -> DataFrame:
    """Rows with a column ``prompt`` and the step's ``reply``, a struct; null where the prompt is null or no try gave a usable one.

    The model sees whole Arrow batches; only rows without a usable reply are asked again.
    """
    shipping.arrow(rows.sparkSession)
    kind, call = T.DataType.fromDDL(STEPS[step].schema), model or extractive

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            done = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
            for _ in range(tries):
                left = done.isna() & prompts.notna()
                if left.any():
                    done[left] = call(step, prompts[left]).map(lambda r: usable(r, kind))
            yield done

    run = shipping.lean(run)
    # Pandas tells an iterator function by its hints, which must be real types here.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("reply", F.from_json(F.pandas_udf(run, "string")("prompt"), STEPS[step].schema))


_WORD = re.compile(r"[^ \t\n\r\f\v]+")


def _head(text: str, n: int) -> str:
    return " ".join(_WORD.findall(text)[:n])


def _part(prompt_: str, name: str) -> str:
    found = re.search(rf"(?:\A|\n\n){name}:\n(.*?)(?=\n\n[A-Z][a-z]+:\n|\Z)", prompt_, re.DOTALL)
    return found.group(1) if found else ""


def blocks(prompt_: str) -> list[tuple[int, str]]:
    """The pages of a prompt: (number, text)."""
    _, mark, pages = prompt_.partition("Pages:\n")
    parts = re.split(r"(?:\A|\n\n)\[p\.([0-9]+)\] ", pages)[1:] if mark else []
    return [(int(n), t) for n, t in zip(parts[::2], parts[1::2], strict=True)]


def _extracted(step: str, asked: str) -> dict:
    shown = [(page, text) for page, text in blocks(asked) if _WORD.search(text)]
    heads = [(page, _head(text, 12)) for page, text in shown]
    points = [{"text": head, "page": page} for page, head in heads[:7]]
    idea = heads[0][1] if heads else ""
    if step == "route":
        message = _part(asked, "Message")
        low = message.lower()
        intent = next((i for i, mark in (("quiz", "quiz"), ("flashcard", "flashcard"), ("summary", "summar")) if mark in low), "ask")
        whole = "document" in low
        return {"intent": intent, "scope": "document" if whole else "topic", "follow_up": "more" in low, "topic": "" if whole else message}
    if step == "answer":
        return {"answer": idea, "pages": [page for page, _ in heads], "found": bool(heads)}
    if step == "flashcards":
        return {"cards": [{"front": _head(text, 3), "back": _head(text, 12), "page": page} for page, text in shown[:8]]}
    if step == "quiz":
        return {"questions": [{"id": "q", "type": "fill_blank", "concept": _head(text, 2), "question": " ".join(_WORD.findall(text)[1:12]), "options": None, "answer": _head(text, 1), "page": page} for page, text in shown[:5]]}
    if step == "grade":
        given, wanted = _part(asked, "Given").lower().split(), _part(asked, "Reference").lower().split()
        return {"correct": bool(wanted) and set(wanted) <= set(given), "feedback": "" if given else "no answer"}
    if step == "cards":
        return {"cards": [{"id": f"c{i}", "topic": _head(text, 8), "description": _head(text, 40)} for i, (_, text) in enumerate(shown, 1)]}
    if step == "fold":
        lines = [line for line in _part(asked, "Messages").split("\n") if _WORD.search(line)]
        before = _part(asked, "Summary")
        return {"summary": "\n".join(([before] if before else []) + [f"- {_head(line, 12)}" for line in lines])}
    if step == "section":
        return {"title": "", "main_idea": idea, "key_points": points, "key_terms": _head(shown[0][1], 3).split(" ") if shown else []}
    if step == "faithful":
        text = "\n".join(_head(t, 10**9) for _, t in shown)
        return {"unsupported": [p for p in _part(asked, "Points").split("\n") if p and p not in text]}
    if step == "overview":
        lines = _part(asked, "Sections").split("\n")
        return {"subject": _head(lines[0], 8), "overview": " ".join(_head(line, 8) for line in lines[:5])}
    if step == "claims":
        return {"claims": [c for c in re.split(r"(?<=[.!?])\s+", _part(asked, "Answer").strip()) if c]}
    if step == "verdicts":
        text = "\n".join(_head(t, 10**9) for _, t in shown)
        return {"verdicts": ["yes" if c in text else "idk" for c in _part(asked, "Claims").split("\n") if c]}
    return {"main_idea": idea, "key_points": points, "covered": bool(heads), "missing": "", "next_query": ""}


def extractive(step: str, prompts: pd.Series) -> pd.Series:
    """The default stand-in for a model: replies copied from the prompt's own text."""
    return prompts.map(lambda p: json.dumps(_extracted(step, p), ensure_ascii=False))


def decided(reply: Column, message: Column, button: Column, subject: Column, has_context: Column) -> Column:
    """What a turn does: a pressed button's intent wins, a whole-document quiz or card set is about the document's subject, and there is always a query."""
    intent = F.coalesce(button, reply["intent"])
    whole = (reply["scope"] == "document") & intent.isin("quiz", "flashcard")
    told = F.when(whole, F.coalesce(F.nullif(subject, F.lit("")), F.lit("the whole document"))).otherwise(F.trim(reply["topic"]))
    topic = F.coalesce(F.nullif(told, F.lit("")), message)
    return F.struct(intent.alias("intent"), reply["scope"].alias("scope"), (reply["follow_up"] & (reply["scope"] == "topic") & has_context).alias("follow_up"), topic.alias("topic"))


def answer_text(reply: Column) -> Column:
    """An answer and its source pages, which are named only where something was found."""
    pages = F.array_sort(F.array_distinct(F.filter(reply["pages"], lambda p: p != 0)))
    source = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("p."), p.cast("string"))), ", ")
    named = reply["found"] & (F.size(reply["pages"]) > 0)
    return F.concat(reply["answer"], F.when(named, F.concat(F.lit("\n\n(Source: "), source, F.lit(")"))).otherwise(""))


def _points(points: Column) -> Column:
    return F.transform(points, lambda p: F.concat(F.lit("- "), p["text"], F.lit(" (p."), p["page"].cast("string"), F.lit(")")))


def summary_text(reply: Column, head: str | None = None) -> Column:
    """A topic's summary, or a review under its head line: the main idea, an empty line, the points."""
    first = F.array(*([F.lit(head)] if head else []), reply["main_idea"], F.lit(""))
    return F.array_join(F.concat(first, _points(reply["key_points"])), "\n")


def document_text(subject: Column, overview: Column, sections: Column, building: Column) -> Column:
    """A document's summary with its sections (title, start, end, main_idea), or why there is none."""
    lines = F.transform(sections, lambda s: F.concat(F.lit("- "), s["title"], F.lit(" (p."), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit("): "), s["main_idea"]))
    made = F.array_join(F.concat(F.array(subject, F.lit(""), F.coalesce(overview, F.lit("")), F.lit("")), lines), "\n")
    return F.when(sections.isNotNull(), made).when(building, "The summary is being built.").otherwise("There is no summary yet.")


def shown_flashcards(reply: Column, pages: Column) -> Column:
    """Cards of pages that were shown."""
    return F.filter(reply["cards"], lambda c: F.array_contains(pages, c["page"]))


def flashcards_text(cards: Column) -> Column:
    """Numbered cards, or why there are none."""
    lines = F.transform(cards, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["front"], F.lit(" — "), c["back"], F.lit(" (p."), c["page"].cast("string"), F.lit(")")))
    return F.when(F.size(cards) > 0, F.array_join(lines, "\n")).otherwise("No flashcards could be made from these pages.")


def quiz_text(questions: Column, number: Column) -> Column:
    """A quiz as text: questions (id, question, options) of round ``number``."""
    asked = F.transform(questions, lambda q: F.concat(F.lit("\n"), q["id"], F.lit(". "), q["question"], F.array_join(F.transform(F.coalesce(q["options"], F.array().cast("array<string>")), lambda o: F.concat(F.lit("\n   "), o)), "")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Quiz round "), number.cast("string"), F.lit(":"))), asked), "\n")


def valid_questions(reply: Column) -> Column:
    """A reply's usable questions, renumbered q1 to qn."""
    from .study import valid_question

    good = F.filter(reply["questions"], lambda q: F.coalesce(valid_question(q["type"], q["options"], q["answer"]), F.lit(False)))
    return F.transform(good, lambda q, i: q.withField("id", F.concat(F.lit("q"), (i + 1).cast("string"))))


def folded(messages: DataFrame, state: DataFrame, model: Model | None = None, keep: int = 4, least: int = 8, most: int = 500) -> DataFrame:
    """(conv_id, summary, upto): running summaries after a fold, for conversations where one is due; a failed reply leaves the state as it was.

    ``messages``: (conv_id, turn, role, text), ``state``: (conv_id, summary, upto), absent for new conversations. The last ``keep`` messages stay
    out; ``least`` older ones that no summary has yet make a fold due. Messages are counted by their place, not by ``turn``.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    placed = messages.withColumn("_at", F.row_number().over(w.orderBy("turn", "role", "text")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    known = placed.join(state.select("conv_id", "summary", "upto"), "conv_id", "left").withColumn("upto", F.coalesce("upto", F.lit(0)))
    older = known.where((F.col("_n") - keep - F.col("upto") >= least) & (F.col("_at") >= F.col("upto")) & (F.col("_at") < F.col("_n") - keep))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring(F.coalesce("text", F.lit("")), 1, most))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", line.alias("line")))), lambda x: x["line"]), "\n")
    due = older.groupBy("conv_id", "summary", "upto", "_n").agg(told.alias("told"))
    asked = due.withColumn("prompt", prompt("fold", F.lit("en"), summary=F.col("summary"), messages=F.col("told")))
    fresh = F.col("reply").isNotNull()
    return replied(asked, "fold", model).select(
        "conv_id", F.when(fresh, F.col("reply.summary")).otherwise(F.col("summary")).alias("summary"), F.when(fresh, F.col("_n") - keep).otherwise(F.col("upto")).cast("long").alias("upto")
    )


def faithfulness_issues(reply: Column) -> Column:
    """What a section's faithfulness check asks to mend; a failed check asks nothing."""
    return F.transform(F.coalesce(reply["unsupported"], F.array().cast("array<string>")), lambda u: F.concat(F.lit("Not supported by the text, remove or correct: "), u))


def overview_or(reply: Column, filename: Column) -> tuple[Column, Column]:
    """Subject and overview of a document; where the reply failed, its file name and nothing."""
    return F.coalesce(reply["subject"], filename, F.lit("")), F.coalesce(reply["overview"], F.lit(""))


def section_titles(toc: Column, reply: Column, start: Column, end: Column) -> Column:
    """A section's title: the contents' one, else the model's, else its pages."""
    return F.coalesce(F.nullif(toc, F.lit("")), F.nullif(reply["title"], F.lit("")), F.format_string("Pages %d-%d", start, end))


def judged_by_chunks(answers: DataFrame, model: Model | None = None) -> DataFrame:
    """Answers (id, answer, pages text) with ``claims`` and ``verdicts``: claims are judged by the raw chunks, no facts are extracted from them first."""
    cols = answers.columns
    claimed = replied(answers.withColumn("prompt", prompt("claims", F.lit("en"), answer=F.col("answer"))), "claims", model)
    known = claimed.select(*cols, F.coalesce("reply.claims", F.array().cast("array<string>")).alias("claims"))
    asked = known.withColumn("prompt", F.when(F.size("claims") > 0, prompt("verdicts", F.lit("en"), pages=F.col("pages"), claims=F.array_join("claims", "\n"))))
    return replied(asked, "verdicts", model).select(*cols, "claims", F.col("reply.verdicts").alias("verdicts"))


def provider(spark: SparkSession, default: str = "extractive") -> dict[str, str]:
    """The model that a session names in ``marginalia.model`` as ``provider:name``; without one the stand-in."""
    name, _, model = spark.conf.get("marginalia.model", default).partition(":")
    return {"provider": name, "model": model or name}


def failure_text(step: str, tries: int = TRIES) -> str:
    """What is said of a step that gave no usable reply."""
    return f"No usable {step} reply after {tries} tries"


def page_blocks(page: Column, text: Column) -> Column:
    """One page as a prompt shows it."""
    return F.concat(F.lit("[p."), page.cast("string"), F.lit("] "), F.coalesce(text, F.lit("")))


def cited_pages(reply: Column) -> Column:
    """The distinct pages of a reply's points in order: what the next round's stall test compares with."""
    return F.array_sort(F.array_distinct(F.transform(reply["key_points"], lambda p: p["page"])))
