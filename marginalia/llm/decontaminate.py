"""Operator 7: benchmark passages in documents, by a prefix-filtered set join. DataFrame operations only.

An item's windows are sets of positioned word shingles. A document holds a window only if it holds all of the window's shingles, so one
of them is a sufficient prefix: the rarest in the corpus. Documents' shingles are joined with these prefixes alone. A match
fixes where the window would start; it must lie inside the document (length and positional bounds), and the words there must equal a
window's exactly.

One pass over the texts keeps the positions whose shingle passes a bit array of the benchmark's shingles; rarity and prefixes work on these.
Only documents with a match are read again for their words, so neither texts nor words of the others are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SHINGLE = 3

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of digits, letters and non-ASCII characters. Null has none."""
    return F.array_remove(F.split(shared.ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _key(words: str, at: str, size: int) -> Column:
    """A 64-bit key of the shingle of ``size`` words at a 0-based position; exact comparison follows."""
    return F.expr(f"xxhash64({', '.join([str(size), *(f'get({words}, {at} + {k})' for k in range(size))])})")


def item_windows(items: DataFrame, window: int, item_id: str, item_text: str) -> DataFrame:
    """(item_id, words): every run of ``window`` words of an item; a shorter item is one window, an empty one none."""
    split = items.select(items[item_id].alias("item_id"), words_of(items[item_text]).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return split.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("words"))


def _row(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What a row is known by: its id, which may be null or repeated, and a hash of its text. Structs with null fields compare as equal."""
    return F.struct(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("h"))


def _row_hash(row: Column) -> Column:
    return F.xxhash64(row["id"], row["h"])


def _prefixes(windows: DataFrame, places: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, p, n): the rarest shingle of each window, its place in it and the window's length. A window with a shingle that no document holds has none."""
    shingles = None
    for q in sizes:
        part = windows.where(F.least("n", F.lit(SHINGLE)) == q).select("window", "n", F.split("window", " ").alias("w"))
        part = part.select("window", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - q)).alias("p")).select("window", "n", "p", _key("w", "p", q).alias("key"))
        shingles = part if shingles is None else shingles.unionByName(part)
    rarity = places.groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    return (
        shingles.join(rarity, "key", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "key", "p", "n")).alias("rarest"))
        .where("rarest.seen > 0")
        .select("rarest.key", "rarest.p", "rarest.n")
        .distinct()
    )


def _hits(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """(row, n_hit, n_items, items_sha256) of the rows that hold a window, as a stored table."""
    listed = item_windows(items, window, item_id, item_text).select(F.concat_ws(" ", "words").alias("window"), F.size("words").alias("n"), F.col("item_id").cast("string").alias("item"))
    # Windows of the same items are one class, so documents carry classes instead of items.
    owners = listed.groupBy("window", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = shared.stored(owners.withColumn("class", F.sha2(F.to_json(F.struct("items")), 256)), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least(F.col("n"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    spots = windows.select("n", F.split("window", " ").alias("w")).select("n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - F.least("n", F.lit(SHINGLE)))).alias("p"))
    keys = F.coalesce(*(F.when(F.least("n", F.lit(SHINGLE)) == q, _key("w", "p", q)) for q in sizes))
    sought = shared.sieve(shared.stored(spots.select(keys.alias("key")).distinct(), "keys"), "key")

    row = _row(docs, id_col, text_col)
    spread = docs.select(row.alias("row"), words_of(docs[text_col]).alias("words")).select("row", "words", F.posexplode("words").alias("i", "w"))
    keyed = spread.select("row", "i", _key("words", "i", sizes[0]).alias("key")) if len(sizes) == 1 else spread.select("row", "i", F.explode(F.array(*(_key("words", "i", q) for q in sizes))).alias("key"))
    places = shared.stored(keyed.where(sought(F.col("key"))), "places")

    prefixes = shared.stored(_prefixes(windows, places, sizes), "prefixes")
    found = places.join(prefixes, "key").select("row", (F.col("i") - F.col("p")).alias("start"), "n").where("start >= 0")
    candidates = shared.stored(found.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("spots")), "candidates")
    touched = shared.sieve(candidates.select(_row_hash(F.col("row")).alias("hash")), "hash")
    again = docs.where(touched(_row_hash(row))).select(row.alias("row"), docs[text_col].alias("text")).groupBy("row").agg(F.first("text").alias("text"))
    runs = (
        again.join(candidates, "row")
        .select("row", words_of(F.col("text")).alias("words"), "spots")
        .select("row", "words", F.inline("spots"))
        .where("start + n <= size(words)")
        .select("row", "start", (F.col("start") + F.col("n")).alias("end"), F.concat_ws(" ", F.expr("slice(words, start + 1, n)")).alias("window"))
    )
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("hit"), F.greatest(a["reach"], s["end"]).alias("reach")
        ),
    )
    hits = shared.stored(
        runs.join(windows.select("window", "class"), "window")
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("class")).alias("classes"))
        .select("row", merged["hit"].cast("long").alias("n_hit"), "classes"),
        "hits",
    )
    # Items are listed once for each distinct set of classes, not for each document.
    of_class = windows.select("class", "items").dropDuplicates(["class"])
    sets = (
        hits.select("classes").distinct()
        .select("classes", F.explode("classes").alias("class"))
        .join(of_class, "class")
        .groupBy("classes")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("classes", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    )
    return shared.stored(hits.join(shared.stored(sets, "sets"), "classes").drop("classes"), "hits")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Return (id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A word is hit if it lies inside any occurrence of an item's window. Null and wordless texts: no words, no hits. Items
    without words have no windows. Repeated documents each get their own row; items that repeat an id count once; null item ids mark words
    as hit but are not listed. Empty documents give an empty table, an empty benchmark gives no hits. Only the named columns are read, so
    others may have any name.
    """
    hits = _hits(docs, items, window, id_col, text_col, item_id, item_text)
    light = docs.select(_row(docs, id_col, text_col).alias("row"), F.size(words_of(docs[text_col])).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return light.join(hits, "row", "left").select(
        F.col("row.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that hold a benchmark passage.

    A row is known by its id and its text, so others of its id, or of no id, stay; a repeated row goes or stays with its copies. Null and
    wordless texts stay. An empty table gives an empty one, an empty benchmark keeps all. Rows that no hit can mean pass by without a shuffle.
    """
    found = _hits(docs, items, window, id_col, text_col, item_id, item_text).select("row")
    row = _row(docs, id_col, text_col)
    doubtful = shared.sieve(found.select(_row_hash(F.col("row")).alias("hash")), "hash")(_row_hash(row))
    rest = docs.where(doubtful)
    return docs.where(~doubtful).unionAll(rest.join(found, _row(rest, id_col, text_col) == found["row"], "left_anti"))
