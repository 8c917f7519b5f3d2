"""Search indexes as tables: postings, lengths, document frequencies, term weights, vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shipping
from ..functions import text as tx

#: Folders of an index table by hash of the term: a few questions read only the folders of their terms.
BUCKETS = 32
#: Retrievers that an index has tables for, and words of the units of a shard of packed postings.
KINDS, SHARD = ("bm25", "tfidf"), 1 << 18


def tokenised(units: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(scope, unit, toks, len[, extra]) of units (scope, unit, text); units without tokens keep length 0."""
    toks = tx.tokens(F.col("text"))
    return units.select("scope", "unit", *extra, toks.alias("toks")).withColumn("len", F.size("toks").cast("long"))


def statistics(lengths: DataFrame) -> DataFrame:
    """(scope, n, avg_len): one row per scope."""
    return lengths.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))


def postings(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(scope, unit, len, term, tf). With ``terms`` (scope, term) only theirs: the join comes before the counting shuffle."""
    spread = tokens.select("scope", "unit", "len", F.explode("toks").alias("term"))
    if terms is not None:
        spread = spread.join(terms, ["scope", "term"], "left_semi")
    return spread.groupBy("scope", "unit", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def frequencies(posting: DataFrame) -> DataFrame:
    """(scope, term, df)."""
    return posting.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))


def spread_grams(df: DataFrame, key: str, char_mode: bool = False, longest: int = 2) -> DataFrame:
    """(scope, unit, term) of (scope, key, text): words of two characters or more in runs of up to ``longest``, or characters in runs of 2 to 4.

    The parts are an array column first; one row per start then reads its runs from the array, all inside code generation.
    """
    if char_mode:
        parts, sizes, mark = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?s)."), F.lit(0)), (2, 3, 4), ""
    else:
        parts, sizes, mark = F.filter(tx.tokens(F.col("text")), lambda w: F.length(w) >= 2), tuple(range(1, longest + 1)), " "
    starts = df.select("scope", F.col(key).alias("unit"), parts.alias("_p")).select("scope", "unit", "_p", F.posexplode("_p").alias("_i", "_w"))
    runs = [F.when(F.col("_i") + n <= F.size("_p"), F.concat_ws(mark, *(F.get("_p", F.col("_i") + k) for k in range(n)))) for n in sizes]
    return starts.select("scope", "unit", F.explode(F.array(*runs)).alias("term")).where("term is not null")


def bm25_weights(posting: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    """(scope, term, unit, w): what a term adds to a unit's BM25 score. A term of every unit adds nothing and has no rows."""
    weight = F.log(F.col("n") / F.col("df")) * (k1 + 1) * F.col("tf") / (k1 * (1 - b + b * F.col("len") / F.col("avg_len")) + F.col("tf"))
    joined = posting.join(frequencies(posting), ["scope", "term"]).join(stats, "scope")
    return joined.select("scope", "term", "unit", weight.alias("w")).where("w > 0")


def tfidf_tables(units: DataFrame, char_mode: bool = False) -> tuple[DataFrame, DataFrame]:
    """((scope, unit, term, w), (scope, term, df, idf)): raw counts, smooth idf, L2-normalised rows."""
    sizes = units.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    counted = spread_grams(units, "unit", char_mode).groupBy("scope", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = idf_table(counted, sizes)
    raw = counted.join(idf, ["scope", "term"]).select("scope", "unit", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norms = raw.groupBy("scope", "unit").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, ["scope", "unit"]).select("scope", "unit", "term", (F.col("raw") / F.col("norm")).alias("w")), idf


def idf_table(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(scope, term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    df = counted.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(sizes, "scope").select("scope", "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def stale(old_meta: DataFrame, new_meta: DataFrame) -> DataFrame:
    """Scopes whose fingerprint differs or is new: only these are rebuilt."""
    return new_meta.join(old_meta.select("scope", "fingerprint"), ["scope", "fingerprint"], "left_anti").select("scope")


def fingerprints(units: DataFrame) -> DataFrame:
    """(scope, items, fingerprint) of what an index is made of, in any order: one aggregate over hashes of ids and texts."""
    h = F.xxhash64("unit", "text").cast("decimal(38,0)")
    return units.groupBy("scope").agg(F.count(F.lit(1)).alias("items"), F.sha1(F.concat_ws(":", F.count(F.lit(1)), F.sum(h))).alias("fingerprint"))


def bucketed(terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with their term's ``bucket``, the folder that an index of as many buckets keeps the term in."""
    return terms.withColumn("bucket", F.pmod(F.xxhash64("scope", "term"), F.lit(buckets)).cast("int"))


def keys_of(table: DataFrame, terms: DataFrame) -> tuple[DataFrame, list[str]]:
    """Terms as an index table is joined with them, and the join's columns: by bucket too where the table has any, so that a scan skips the other folders."""
    if "bucket" not in table.columns:
        return terms, ["scope", "term"]
    return bucketed(terms).where("term <> ''"), ["bucket", "scope", "term"]


def packed(units: DataFrame, k1: float, b: float) -> DataFrame:
    """BM25 postings of units (scope, unit, text), a row for each term of a shard: (scope, term, shard, df, units, tfs, lens, n, avg_len, k1, b).

    A shard is a run of a task's units, so postings are made where texts are read and are not shuffled; a search scores each shard by itself. ``df`` is
    the term's units in the shard; ``n`` and ``avg_len`` are those of the whole scope. A unit without a key counts, but is never found.
    """
    spark = shipping.arrow(units.sparkSession)
    tokens = tokenised(units)
    stats = spark.sparkContext.broadcast({r["scope"]: (r["n"], r["avg_len"]) for r in statistics(tokens).toLocalIterator()})

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        held, words, made = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(batch["toks"].value_lengths().to_numpy(zero_copy_only=False)) // SHARD
            first = 0
            for last in (*(np.flatnonzero(np.diff(sizes)) + 1), batch.num_rows):  # at most SHARD words and one unit
                part = batch.slice(int(first), int(last - first))
                held.append(part)
                words, first = words + len(part["toks"].flatten()), last
                if words >= SHARD:
                    yield made, pa.Table.from_batches(held)
                    held, words, made = [], 0, made + 1
        if held:
            yield made, pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in shards(batches):
            whole = table.combine_chunks().to_batches()[0] if table.num_rows else None
            coded = whole["scope"].dictionary_encode() if whole else None
            for i, scope in enumerate(coded.dictionary.to_pylist() if whole else ()):
                part = whole.filter(pc.equal(coded.indices, i))
                words = part["toks"].flatten().dictionary_encode()
                if not len(words):
                    continue
                at = pc.list_parent_indices(part["toks"]).to_numpy(zero_copy_only=False).astype(np.int64)
                keys, times = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * part.num_rows + at, return_counts=True)
                terms, rows = np.divmod(keys, part.num_rows)
                sizes = np.bincount(terms, minlength=len(words.dictionary))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, v) for v in (part["unit"].take(pa.array(rows)), pa.array(times, pa.int32()), part["len"].take(pa.array(rows)).cast(pa.int32()))]
                n = len(sizes)
                n_units, avg_len = stats.value[scope]
                same = [pa.array([n_units] * n, pa.int64()), *(pa.array([v] * n, pa.float64()) for v in (avg_len, k1, b))]
                columns = [pa.array([scope] * n, part["scope"].type), words.dictionary, pa.array([shard] * n, pa.int64()), pa.array(sizes, pa.int32()), *lists, *same]
                yield from pa.Table.from_arrays(columns, ["scope", "term", "shard", "df", "units", "tfs", "lens", "n", "avg_len", "k1", "b"]).to_batches(max_chunksize=50_000)

    return tokens.mapInArrow(shipping.lean(run), _packed_schema(units))


def _packed_schema(units: DataFrame) -> str:
    scope, unit = (units.schema[c].dataType.simpleString() for c in ("scope", "unit"))
    return f"scope {scope}, term string, shard long, df int, units array<{unit}>, tfs array<int>, lens array<int>, n long, avg_len double, k1 double, b double"


def written(units: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, kinds: tuple[str, ...] = KINDS) -> None:
    """Write an index of units (scope, unit, text), in folders by hash of the term: packed BM25 postings, and TF-IDF rows and idf, as ``kinds`` name; the
    fingerprint comes last and makes it valid. TF-IDF tables have a row for each gram of a unit, which takes several times the disk of the texts.
    Adaptive execution cuts a folder's TF-IDF rows into files of its advisory size, so a common term is not one task."""
    if "bm25" in kinds:
        dealt = bucketed(packed(units, k1, b)).sortWithinPartitions("bucket", "scope", "term")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/bm25")
    if "tfidf" in kinds:
        for name, df in zip(("tfidf", "idf"), tfidf_tables(units), strict=True):
            dealt = bucketed(df).hint("rebalance", "bucket").sortWithinPartitions("bucket", "scope", "term")
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/{name}")
    fingerprints(units).write.mode("overwrite").parquet(f"{path}/meta")


def opened(units: DataFrame, path: str, scan: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> dict[str, DataFrame]:
    """The tables of an index that ``kinds`` of retrievers search, built first where they are absent, unfinished or of other units than these.
    ``scan``: the same units for the comparison, which needs no dealing out."""
    spark = units.sparkSession

    def there(name: str) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    names = {"bm25": ("bm25",), "tfidf": ("tfidf", "idf")}
    if not there("meta") or stale(spark.read.parquet(f"{path}/meta"), fingerprints(units if scan is None else scan)).take(1):
        forgotten(spark, path)  # tables of other kinds are of other units too
    if missing := tuple(kind for kind in kinds if not all(map(there, names[kind]))):
        written(units, path, kinds=missing)
    scope, unit = (units.schema[c].dataType.simpleString() for c in ("scope", "unit"))
    # Named, since an index of no units has no files to tell them.
    schemas = {"bm25": f"{_packed_schema(units)}, bucket int", "tfidf": f"scope {scope}, term string, unit {unit}, w double, bucket int", "idf": f"scope {scope}, term string, df long, idf double, bucket int"}
    return {name: spark.read.schema(schemas[name]).parquet(f"{path}/{name}") for kind in kinds for name in names[kind]} | {"meta": spark.read.parquet(f"{path}/meta")}


def forgotten(spark, path: str) -> None:
    """Delete an index."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def analyser_modes(units: DataFrame, order: str = "unit", sample: int = 20_000, least: float = 0.15) -> DataFrame:
    """(scope, mode): ``char`` where enough of the first ``sample`` characters of a scope's texts, in order, are Chinese, else ``word``."""
    before = Window.partitionBy("scope").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sized = units.select("scope", order, F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    head = sized.where(F.col("at") < sample).select("scope", F.expr(f"substring(text, 1, cast({sample} - at as int))").alias("text"))
    han = F.length(F.regexp_replace("text", r"[^\x{4e00}-\x{9fff}]", ""))
    ratio = F.sum(han) / F.nullif(F.sum(F.length("text")), F.lit(0))
    return head.groupBy("scope").agg(F.when(F.coalesce(ratio, F.lit(0.0)) >= least, "char").otherwise("word").alias("mode"))
