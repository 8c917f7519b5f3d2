"""Scans, registration and sinks over Parquet, JSON lines, CSV and binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = "doc_id string, page_no int, text_raw string, text_clean string"
CHUNK = "chunk_id string, doc_id string, page_no int, chunk_index int, text string"
CARD = "chunk_id string, doc_id string, topic string, description string"
QUESTION = "id string, doc_id string, doc string, lang string, level string, q string, gold_pages array<int>, gold_groups array<array<int>>, excluded boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallel(df: DataFrame) -> DataFrame:
    """Deal a scan of far fewer splits than cores to all cores; a larger one stays as it is, since a shuffle of whole texts costs more disk than idle cores cost time."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (book, page_no, text): a source is a book, and a page's number is its document id plus one."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book"), (F.col("doc_id") + 1).cast("int").alias("page_no"), "text", "lang")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, file_hash) of PDF files. Text extraction is a function passed to ``pdf_pages``; none is bundled."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content", F.sha2("content", 256).alias("file_hash"))


def pdf_pages(files: DataFrame, extract, schema: str = "path string, page_no int, text_raw string") -> DataFrame:
    """Pages by ``extract(iterator of pandas frames)``: the plug for a text-layer or OCR reader."""
    return files.mapInPandas(extract, schema)


def questions(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Benchmark questions from JSON lines: blank lines and excluded rows dropped, document names joined in."""
    rows = spark.read.schema(QUESTION).option("mode", "PERMISSIVE").json(path).where("id is not null and not coalesce(excluded, false)")
    short = F.substring("doc_id", 1, 8)
    if not names:
        return rows.withColumn("doc", F.coalesce("doc", short))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.withColumn("doc", F.coalesce(F.try_element_at(known, F.col("doc_id")), F.col("doc"), short))


def registered(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """First registration wins for each content hash: existing rows, then the earliest of the batch for new hashes."""
    first = Window.partitionBy("file_hash").orderBy("created_at", "doc_id")
    fresh = batch.join(existing.select("file_hash"), "file_hash", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return existing.unionByName(fresh)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replaced(old: DataFrame, new: DataFrame, key: str, value: str) -> tuple[DataFrame, Column]:
    """A document's rows or a child set replaced, and the condition of rows that go."""
    gone = F.col(key) == F.lit(value)
    return old.where(~gone).unionByName(new), gone


def kept_cards(cards: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Cards whose chunk is still there with the same text."""
    same = old_chunks.select("chunk_id", "text").join(new_chunks.select("chunk_id", "text"), ["chunk_id", "text"], "left_semi")
    return cards.join(same.select("chunk_id"), "chunk_id", "left_semi")


def resumable(todo: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """What a resume log does not hold yet."""
    return todo.join(log.select(key), key, "left_anti")


def last_records(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key of an append log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*(c for c in log.columns if c != key)), order).alias("_r")).select(key, "_r.*")


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV with a header; the header's first name starts with a byte-order mark, which spreadsheets need."""
    first, *rest = df.columns
    df.select(df[first].alias(f"\ufeff{first}"), *rest).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header in UTF-8, with or without a byte-order mark, or in GBK: a replacement character in the UTF-8 reading decides."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # GBK is not among the encodings that Spark takes otherwise

    def read(encoding: str) -> DataFrame:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", encoding).csv(path)

    utf = read("UTF-8")
    texts = [F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in utf.schema.fields]
    return read("GBK") if utf.where(F.concat(*texts).contains("\ufffd")).take(1) else utf


def save_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; the write is committed as a whole."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def appended_log(df: DataFrame, path: str) -> None:
    """Records appended to a JSON-lines log that ``resumable`` and ``last_records`` read."""
    df.write.mode("append").json(path)


def in_order(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows by a list of ids: its order kept, repeats kept, unknown ids left out."""
    spark = rows.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("pos", key)) if ids else spark.createDataFrame([], f"pos int, {key} {rows.schema[key].dataType.simpleString()}")
    return wanted.join(rows, key).orderBy("pos")


def documents_listing(documents: DataFrame, chunks: DataFrame, cards: DataFrame) -> DataFrame:
    """Documents with their counts, newest first."""
    n_chunks = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    n_cards = cards.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cards"))
    zero = F.lit(0).cast("long")
    return (
        documents.join(n_chunks, "doc_id", "left")
        .join(n_cards, "doc_id", "left")
        .withColumns({"n_chunks": F.coalesce("n_chunks", zero), "n_cards": F.coalesce("n_cards", zero)})
        .orderBy(F.desc("created_at"), "doc_id")
    )


def first_hash_wins(rows: DataFrame, hash_col: str, order: list[str]) -> DataFrame:
    """The first row of each content hash: one aggregate, no window, so copies combine before the shuffle."""
    rest = [c for c in rows.columns if c != hash_col]
    return rows.groupBy(hash_col).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(hash_col, "_r.*")
