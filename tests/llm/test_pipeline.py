"""Each stage of the pipeline on its own input."""

import pytest

import corpus_pipeline
from marginalia.llm import pii, quality

from ..conftest import SF
from . import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows."""
    folder, docs, found = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{folder}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        found[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return found


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, stages):
    before, after, _ = stages["quality"]
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(after))
    right = [(r.doc_id in kept) == bool(marks[r.doc_id]) for r in before if r.doc_id in marks]
    assert sum(right) / len(right) > 0.95
    model = quality.fitted(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.quality([quality.document_features(r.text) for r in before])
    assert ids(after) == sorted(r.doc_id for r, s in zip(before, scores) if s >= 0.3)


def test_dedup(stages):
    before, after, _ = stages["near_dedup"]
    found = brute.near([(r.doc_id, r.text) for r in before])
    assert ids(after) == sorted(i for i, (_, c) in found.items() if c == i)


def test_decontamination(spark, stages):
    before, after, _ = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination([(r.doc_id, r.text) for r in before], items)
    assert ids(after) == sorted(d for d, _, n, *_ in found if not n)


def test_pii(stages):
    before, after, _ = stages["pii"]
    assert ids(before) == ids(after)
    texts = {r.doc_id: r for r in after}
    for r in before:
        spans = pii._found(r.text, pii.trained())[1]
        assert texts[r.doc_id].text == pii.redacted_text(r.text, spans)
        assert not pii.base_spans(texts[r.doc_id].text) and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)


def test_packing(stages):
    before, after, _ = stages["packing"]
    assert sorted({r.doc_id for r in after}) == ids(before)
    loads = {}
    for r in after:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert max(loads.values()) <= 2048


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["packing"][1])
