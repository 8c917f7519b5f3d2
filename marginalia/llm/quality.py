"""Operator 9: document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its score depends on its own features and on its neighbours', a transition score ties it to the line before.
Forward-backward marginals are averaged by line length into the document's quality. The model is trained here, by maximum conditional
likelihood on a bounded sample of labelled documents, whose lines take the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Labelled rows and bytes of text that training may take at most, and passes over them.
SAMPLE, SAMPLE_BYTES, EPOCHS = 4000, 48 << 20, 60
FOLDS, HELD_OUT = 5, 0
#: Lines of one padded block in training and scoring.
_LINES = 200_000

_UPPER, _LOWER, _DIGIT, _SPACE, _OTHER, _WIDE = b"uldspw"
_KINDS = bytes(
    _UPPER if 65 <= b <= 90 else _LOWER if 97 <= b <= 122 else _DIGIT if 48 <= b <= 57 else _SPACE if b in (9, 32) else _WIDE if b >= 128 else _OTHER
    for b in range(256)
)
#: Features of a line by itself, and how many of them its neighbours contribute.
OWN, NEAR = 14, 8


def _features(line: bytes, seen: set[bytes]) -> list[float]:
    """Numbers in about 0 to 1. ``seen``: words of the document so far; the line's own are added."""
    kinds, words = line.translate(_KINDS), line.split()
    n, total = len(kinds), max(1, len(words))
    upper, lower, digit, other, wide = (kinds.count(bytes([k])) for k in (_UPPER, _LOWER, _DIGIT, _OTHER, _WIDE))
    letters = max(1, upper + lower + wide)
    distinct = set(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    known = len(distinct & seen)
    seen |= distinct
    return [
        upper / letters,
        other / max(1, n),
        digit / max(1, n),
        1 - len(distinct) / total,
        repeats / total,
        known / max(1, len(distinct)),
        min(1.0, (kinds.count(b"pp")) / total),
        min(1.0, line.count(b"|") / total),
        min(2.0, n / total / 8),
        float(kinds.endswith(b"p")),
        min(1.0, total / 5),
        min(1.0, total / 50),
        min(1.5, total / 500),
        1.0,
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line weights). Blank lines are left out; a blank text is one empty line."""
    lines = [line for line in (text or "").encode("utf-8", "replace").split(b"\n") if line.strip()] or [b""]
    seen: set[bytes] = set()
    own = np.array([_features(line, seen) for line in lines])
    bounds = np.zeros((1, NEAR))
    before, after = np.vstack([bounds, own[:-1, :NEAR]]), np.vstack([own[1:, :NEAR], bounds])
    return np.hstack([own, before, after, own[:, :NEAR] ** 0.5]), np.array([max(1, len(line)) for line in lines], dtype=np.float64)


def marginals(scores: list[np.ndarray], turn: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded chains of two states.

    ``scores``: for each chain the good-minus-bad score of its lines; ``turn``: transition scores (from, to). Returns log normalisers,
    P(good) padded to (chains, lines), and expected transitions summed over lines, each weighted by 1 / lines.
    """
    n, sizes = len(scores), np.array([len(s) for s in scores])
    width = int(sizes.max())
    emit = np.zeros((n, width))
    for i, s in enumerate(scores):
        emit[i, : len(s)] = s
    alive = np.arange(width)[None, :] < sizes[:, None]
    forward, backward = np.zeros((width, n, 2)), np.zeros((width, n, 2))
    forward[0, :, 1] = emit[:, 0]
    for t in range(1, width):
        step = np.logaddexp(forward[t - 1, :, :1] + turn[0], forward[t - 1, :, 1:] + turn[1])
        step[:, 1] += emit[:, t]
        forward[t] = np.where(alive[:, t : t + 1], step, forward[t - 1])
    for t in range(width - 2, -1, -1):
        ahead = backward[t + 1].copy()
        ahead[:, 1] += emit[:, t + 1]
        step = np.logaddexp(ahead[:, :1] + turn[:, 0], ahead[:, 1:] + turn[:, 1])
        backward[t] = np.where(alive[:, t + 1 : t + 2], step, 0.0)
    total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    good = np.exp(np.minimum(0.0, forward[:, :, 1] + backward[:, :, 1] - total)).T * alive
    moves = np.zeros((2, 2))
    share = (1.0 / sizes)[:, None]
    for t in range(1, width):
        on = alive[:, t]
        if not on.any():
            break
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(forward[t - 1, on, a] + turn[a, b] + (emit[on, t] if b else 0.0) + backward[t, on, b] - total[on])
                moves[a, b] += (p * share[on, 0]).sum()
    return total, good, moves


class Model:
    """Standardised features' weights and the transition scores."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, turn: np.ndarray):
        self.centre, self.spread, self.weights, self.turn = centre, spread, weights, turn

    def quality(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean of P(good) for each document."""
        result = np.zeros(len(docs))
        for part in blocks([len(w) for _, w in docs]):
            scores = [((docs[i][0] - self.centre) / self.spread) @ self.weights for i in part]
            _, good, _ = marginals(scores, self.turn)
            for row, i in enumerate(part):
                w = docs[i][1]
                result[i] = good[row, : len(w)] @ w / w.sum()
        return np.clip(result, 0.0, 1.0)


def blocks(sizes: list[int]) -> Iterator[list[int]]:
    """Documents in runs of like length, so that padding stays small and memory bounded."""
    part: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if part and (len(part) + 1) * sizes[i] > _LINES:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def trained(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Adam on the mean log-likelihood; each document counts the same, the classes are balanced by weight, and weights are shrunk a little."""
    width = OWN + 3 * NEAR
    if not docs:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)))
    every = np.vstack([x for x, _ in docs])
    centre, spread = every.mean(0), np.maximum(every.std(0), 0.05)
    centre[OWN - 1], spread[OWN - 1] = 0.0, 1.0
    x = [(d - centre) / spread for d, _ in docs]
    y = np.array(labels)
    balance = np.array([0.5 / max(1, (y == k).sum()) for k in (0, 1)])
    parts = list(blocks([len(d) for d in x]))
    weights, turn = np.zeros(width), np.zeros((2, 2))
    theta, first, second = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for epoch in range(1, epochs + 1):
        gradient = np.zeros(width + 4)
        for part in parts:
            for label in (0, 1):
                own = [i for i in part if y[i] == label]
                if not own:
                    continue
                _, good, moves = marginals([x[i] @ weights for i in own], turn)
                real = np.zeros((2, 2))
                real[label, label] = sum((len(x[i]) - 1) / len(x[i]) for i in own)
                slope = sum((((label - good[r, : len(x[i])]) @ x[i]) / len(x[i]) for r, i in enumerate(own)), np.zeros(width))
                gradient += balance[label] * np.concatenate([slope, (real - moves).ravel()])
        gradient -= 1e-3 * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.15 * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-8)
        weights, turn = theta[:width], theta[width:].reshape(2, 2)
    return Model(centre, spread, weights, turn)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on at most ``sample`` labelled rows and ``sample_bytes`` of text outside the held-out fold.

    Rows are taken in order of a hash of the id while their whole texts fit; rows without a label, an id or a text are left out. Without any
    labelled rows the model scores every text 0.5.
    """
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = marks.where(fold(F.col("id")) != HELD_OUT).withColumn("o", F.xxhash64("id")).orderBy("o", "id", "y").limit(sample)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    # Both broadcasts hold at most ``sample`` short rows.
    sizes = texts.join(F.broadcast(chosen), "id").select("id", "o", F.octet_length("text").alias("n")).orderBy("o", "id", "n").limit(sample).collect()
    taken, total = [], 0
    for row in sizes:
        if total + row["n"] <= sample_bytes:
            taken.append(row["id"])
            total += row["n"]
    if not taken:
        return trained([], [])
    short = chosen.where(F.col("id").isin(taken)) if len(taken) < len(sizes) else chosen
    rows = texts.join(F.broadcast(short), "id").select("id", "y", "o", "text").limit(sample).collect()
    rows.sort(key=lambda r: (r["o"], r["id"], r["y"], r["text"]))
    return trained([document_features(r["text"]) for r in rows], [r["y"] for r in rows])


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, held_out, score, predicted) for each row of ``docs``.

    The text alone decides the score. Null and blank texts are scored as one empty line. Repeated rows get equal scores. An empty table gives
    an empty one. Only the two named columns are read. Nothing is shuffled.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    picked = docs.select(docs[id_col].alias("id"), (fold(docs[id_col]) == HELD_OUT).alias("held_out"), docs[text_col].alias("text"))
    schema = T.StructType(
        [T.StructField(id_col, picked.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = own.quality([document_features(t) for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"]
                )

    return picked.mapInArrow(shared.lean(score), schema)


def kept(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose score is below the threshold."""
    spark = docs.sparkSession
    shared.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = own.quality([document_features(t) for t in part.column(place).to_pylist()])
                yield part.filter(pa.array(found >= threshold))

    return docs.mapInArrow(shared.lean(keep), docs.schema)
