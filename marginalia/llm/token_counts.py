"""Operator 3: token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pieces, shared


def default_vocabulary() -> str:
    """Where the word-end vocabulary of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Return (id, n_bytes, n_tokens, over_limit) for each row of ``docs``, counts as the library gives them.

    Null and empty texts: 0 bytes, 0 tokens. Null ids are kept. Repeated rows are each counted. An empty table gives an
    empty one. Only the two named columns are read, so other columns may have any name. Whole texts are counted: a
    long one is split at white space, where no token can reach across, and its pieces' lengths are added up. No
    shuffle: each task encodes its own rows, whose sizes the scan balances by bytes.
    """
    shared.ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = picked.schema["id"].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = pieces.cache_for(path, "count")
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            counts: list[int] = []
            for _, part in pieces.text_slices(texts):
                cut = [pieces.without_space(text) for text in part]
                cache.fill(piece for parts in cut for piece in parts)
                counts += [sum(map(cache.__getitem__, parts)) for parts in cut]
            n_tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    return picked.mapInArrow(shared.lean(lengths), schema)
