"""Text functions as Column expressions: they stay inside code generation and push through scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the cleaning rules, which results depend on.
URL = r"(?i)(https?://\S+|www\.\S+)"
LOG_LINE = (
    r"\[\d{2}:\d{2}:\d{2}\]\s*\.\./src/[^\s:]+:\d+:\s*(?:Using Pooled \(Naive\) StorageManager for [CG]PU|GPU context requested, but no GPUs found\."
    r"|Auto-tuning cuDNN op, set MXNET_CUDNN_AUTOTUNE_DEFAULT to\s*␣?(?:\s*,?→?\s*0 to disable)?)"
)
CONTINUED = r"(?i)(?:表\s*[\d.]+\s*[–-]\s*)?\(?\s*continue[sd] (?:from previous|on next) page\s*\)?"
DOT_LEADER = r"[ \t]*\.(?:[ \t]+\.){4,}[ \t]*"
WRAPS = ((r"␣\s*,→", " "), (r"\s*,→", ""), (r"\s*↩→\s*", " "))
HYPHEN = r"([A-Za-z])-\n\s*([A-Za-z])"
BULLET = r"^\s*([•·●▪◦‣]|(\(\d+\))|(\d+[\.\)]))\s+"
CONTROL = r"[\p{C}&&[^\n\t]]"
PAGE_NUMBER = r"^\s*(page\s*)?\d+\s*$"
SEPARATOR = r"^\s*[-—_=]{3,}\s*$"
CJK = r"[\x{4e00}-\x{9fff}]"
WORD = r"[\p{L}\p{N}]+"
#: Han characters one by one, other letters and digits in runs: the stand-in for a Chinese segmenter.
TOKEN = r"[\x{3400}-\x{9fff}]|[\p{L}\p{N}&&[^\x{3400}-\x{9fff}]]+"


def tokens(text: Column) -> Column:
    """Lower-cased search tokens; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def normal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def without_noise(text: Column) -> Column:
    """Known extraction noise: logger lines, page-continuation markers, dot leaders, wrap marks of code listings."""
    text = F.regexp_replace(text, LOG_LINE, "")
    text = F.regexp_replace(text, CONTINUED, "")
    text = F.regexp_replace(text, DOT_LEADER, " ")
    for pattern, instead in WRAPS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, HYPHEN, "$1$2")


def stripped(text: Column) -> Column:
    """Without white space at both ends, all of it and not spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_line(line: Column) -> Column:
    """Strip; drop a bullet from lines of at most 220 characters; squeeze blanks."""
    bare = stripped(line)
    bare = F.when(F.length(bare) <= 220, F.regexp_replace(bare, BULLET, "")).otherwise(bare)
    return stripped(F.regexp_replace(bare, r"[ \t]{2,}", " "))


def clean_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), clean_line), "\n")


def joined_cjk(text: Column) -> Column:
    """White space between two CJK characters goes."""
    return F.regexp_replace(text, rf"(?<={CJK})\s+(?={CJK})", "")


def squeezed_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def clean_page(text: Column) -> Column:
    """All cleaning rules in order, but for compatibility normalisation, which needs ``functions.udfs.nfkc`` first."""
    out = normal_newlines(F.coalesce(text, F.lit("")))
    for rule in (without_urls, without_noise, without_controls, dehyphenated, clean_lines, joined_cjk, squeezed_newlines, stripped):
        out = rule(out)
    return out


def tidied(text: Column) -> Column:
    """Noise repair for stored text: unchanged text comes back as it is, changed text is squeezed."""
    cleaned = without_noise(text)
    return F.when(cleaned.eqNullSafe(text), text).otherwise(stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(cleaned, "[ \t]{2,}", " "), "\n[ \t]+", "\n"), "\n{3,}", "\n\n")))


def han_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x{3400}-\x{9fff}]", ""))


def latin_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def is_zh_page(text: Column) -> Column:
    """Some Han, and at least a tenth of Han and Latin letters."""
    han, latin = han_count(text), latin_count(text)
    return (han > 0) & (han / (han + latin) >= 0.10)


def has_han(text: Column) -> Column:
    return text.rlike(r"[\x{4e00}-\x{9fff}]")


def word_count(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def answer_key(text: Column) -> Column:
    """An answer without case, white space, punctuation and underscores."""
    return F.regexp_replace(F.lower(text), r"(?U)[\s\W_]+", "")


def snippet(text: Column, size: int) -> Column:
    return F.substring(stripped(F.regexp_replace(text, r"(?U)\s+", " ")), 1, size)


def page_list(pages: Column) -> Column:
    """``p.3, p.7``: distinct and sorted."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(pages)), lambda p: F.concat(F.lit("p."), p.cast("string"))), ", ")


def parsed_pages(text: Column) -> Column:
    """All numbers in a text, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))))


def parsed_groups(text: Column) -> Column:
    """``508 | 509 | 516 518`` to one sorted array per non-empty group."""
    return F.filter(F.transform(F.split(text, r"\|"), parsed_pages), lambda g: F.size(g) > 0)


def unit_words(name: Column) -> Column:
    """Words of a child-set name such as ``150o40``; anything else raises when evaluated."""
    good = name.rlike(r"^\d+(?:o\d+)?$")
    return F.when(good, F.regexp_extract(name, r"^(\d+)", 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a child set: "), name)).cast("int"))


def unit_overlap(name: Column) -> Column:
    return F.when(name.contains("o"), F.regexp_extract(name, r"o(\d+)$", 1).cast("int")).otherwise(F.lit(0))


def unit_name(words: Column, overlap: Column) -> Column:
    return F.when(overlap > 0, F.concat_ws("o", words.cast("string"), overlap.cast("string"))).otherwise(words.cast("string"))


def fingerprint(texts: Column, max_length: int = 512) -> Column:
    """SHA-1 over the encoder's setting and each text after a zero character."""
    return F.sha1(F.concat(F.lit(f"max_length={max_length}"), F.array_join(F.transform(texts, lambda t: F.concat(F.lit("\0"), t)), "")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def first_words(text: Column, words: int, characters: int) -> Column:
    """The first words, or the first characters where there is only one word."""
    parts = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, words), " ")).otherwise(F.substring(text, 1, characters))


def unit_vector(vector: Column) -> Column:
    """L2-normalised; the norm is at least 1e-12."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def line_key(line: Column) -> Column:
    """A line as repeated headers are compared: stripped, lower-cased, single spaces."""
    return F.regexp_replace(F.lower(stripped(line)), r"(?U)\s+", " ")
