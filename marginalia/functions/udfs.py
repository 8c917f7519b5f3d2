"""Functions that have no built-in form: Arrow-batched, never row by row."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import shipping

#: Abbreviations after which a full stop ends no sentence (fixed values).
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc e.g i.e fig figs eq eqs no vol pp al inc ltd co dept approx cf".split())
_END = re.compile(r"([.!?]+[\"')\]”’]*)\s+(?=[\"'(\[“‘]*[A-Z0-9])")
_ZH = re.compile(r".+?(?:[。！？；!?;]+[”’」』）)]*|$)", re.S)
_CJK = re.compile(r"[㐀-鿿]")


def split_english(text: str) -> list[str]:
    """Sentences of one paragraph. A stop after an abbreviation, an initial or a number before a digit ends none."""
    found, start = [], 0
    for m in _END.finditer(text):
        before = text[start : m.start()].rsplit(None, 1)
        last = before[-1].lower().lstrip("(\"'[") if before else ""
        ahead = text[m.end() : m.end() + 1]
        if m[1].startswith(".") and (last in ABBREVIATIONS or (len(last) == 1 and last.isalpha())):
            continue
        if m[1] == "." and last.isdigit() and ahead.isdigit():
            continue
        found.append(text[start : m.end(1)].strip())
        start = m.end()
    found.append(text[start:].strip())
    return [s for s in found if s]


def sentences(text: str | None, lang: str) -> list[str]:
    """Paragraph by paragraph; Chinese lines are glued, with a space only between two non-CJK ends."""
    out: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text or ""):
        lines = [line.strip() for line in paragraph.split("\n") if line.strip()]
        if not lines:
            continue
        if lang == "zh":
            glued = lines[0]
            for line in lines[1:]:
                apart = not _CJK.match(glued[-1]) and not _CJK.match(line[0])
                glued += (" " if apart else "") + line
            out += [m.strip() for m in _ZH.findall(glued) if m.strip()]
        else:
            out += split_english(" ".join(lines))
    return out


def words_in(sentence: str, lang: str) -> int:
    """White-space words; for Chinese each Han character and each other run counts."""
    if lang == "zh":
        return len(re.findall(r"[㐀-鿿]|[^\W㐀-鿿]+", sentence))
    return len(sentence.split())


def _hinted(run, batch: type):
    """An iterator function with real types as hints: by them Pandas functions are told apart."""
    run.__annotations__ = {"batches": Iterator[batch], "return": Iterator[pd.Series]}
    return run


def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from shipping.lean(lambda found: map(_nfkc_batch, found))(batches)


def _nfkc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column | str) -> Column:
    """Compatibility normalisation; null stays null."""
    shipping.arrow()
    return F.pandas_udf(_hinted(_nfkc, pd.Series), "string")(text)


def _sentence_split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from shipping.lean(lambda found: (_sentence_batch(*x) for x in found))(batches)


def _sentence_batch(texts: pd.Series, langs: pd.Series) -> pd.Series:
    return pd.Series([sentences(t, g) for t, g in zip(texts, langs, strict=True)])


def sentence_split(text: Column | str, lang: Column | str) -> Column:
    """Sentences of each text by its language; null has none."""
    shipping.arrow()
    return F.pandas_udf(_hinted(_sentence_split, tuple[pd.Series, pd.Series]), "array<string>")(text, lang)


def salvaged(text: str | None) -> dict | None:
    """An object from a model's reply: code fences off, lone backslashes doubled, one nested object unwrapped."""
    if text is None:
        return None
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    first, last = body.find("{"), body.rfind("}")
    if first < 0 or last <= first:
        return None
    body = body[first : last + 1]
    for candidate in (body, re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", body)):
        try:
            found = json.loads(candidate, strict=False)
        except ValueError:
            continue
        if isinstance(found, dict):
            inner = next(iter(found.values())) if len(found) == 1 else None
            return inner if isinstance(inner, dict) else found
    return None


def _salvage_json(texts: pd.Series) -> pd.Series:
    found = texts.map(salvaged)
    return found.map(lambda x: None if x is None else json.dumps(x, sort_keys=True, ensure_ascii=False))


def salvage_json(text: Column | str) -> Column:
    """The object in a model's reply as JSON text with sorted keys, or null."""
    shipping.arrow()
    return F.pandas_udf(_salvage_json, "string")(text)
