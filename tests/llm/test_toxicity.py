from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pytest

from rideflow.llm import toxicity
from tests.llm.fixtures import no_documents, odd_documents

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels")]


@pytest.fixture(scope="module")
def field(tables):
    return toxicity.learn(*tables)


def test_marginals_are_those_of_all_paths(field):
    """Forward-backward against the sum over all state sequences, texts of many lengths at once."""
    reader = toxicity.Reader(field)
    texts = [b"", b"idiot", b"the idiot of clown", b"  the\n", b"a b c d e f moron h", b"x y"]
    to, back, stay = field.moves
    move = {(0, 0): 0.0, (0, 1): to, (1, 0): back, (1, 1): stay}
    for text, p in zip(texts, reader.marginals(texts)):
        evidence = reader._evidence(text.split())
        total, each = 0.0, np.zeros(len(evidence))
        for path in itertools.product((0, 1), repeat=len(evidence)):
            weight = sum(e for e, s in zip(evidence, path) if s)
            weight += sum(move[a, b] for a, b in zip((0, *path), path))
            total += math.exp(weight)
            each += math.exp(weight) * np.array(path)
        assert np.allclose(p, each / total if len(evidence) else [], atol=1e-9)


def test_held_out_accuracy(spark):
    """On a table with some hundred toxic documents to learn from."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    field = toxicity.learn(docs, labels)
    rows = toxicity.scored(docs.select("doc_id", "text"), field).join(labels, "doc_id")
    rows = rows.select("doc_id", "toxic", "toxicity.score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 500
    right = [(r.score >= 0.5) == bool(r.toxic) for r in held]
    assert sum(right) > 0.98 * len(right)
    clean = [r for r in held if not r.toxic]
    assert sum(r.score >= 0.5 for r in clean) <= 0.01 * len(clean)


def test_spans_are_offending_words(field):
    text = "Ünd the idiot, of the\tmoron was 🙂 here idiot"
    p = toxicity.Reader(field).marginals([text.encode()])[0]
    found = [text[s["start"] : s["end"]] for s in toxicity.spans(text.encode(), p)]
    assert found == ["idiot,", "moron", "idiot"]


def test_odd_rows(spark, field):
    docs = odd_documents(spark)
    rows = toxicity.scored(docs, field).collect()
    assert len(rows) == docs.count() and all(0 <= r.toxicity.score < 0.5 for r in rows)
    empty = {r.toxicity.score for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1
    assert toxicity.scored(no_documents(spark), field).count() == 0


def test_without_examples_nothing_is_rejected(spark, tables):
    docs, labels = tables
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert toxicity.learn(no_documents(spark), labels) is None
    kept = toxicity.without_toxic(odd_documents(spark), labels.limit(0))
    assert kept.columns == odd_documents(spark).columns and kept.count() == 12


def test_toxic_documents_go(tables):
    docs, labels = tables
    kept = toxicity.without_toxic(docs, labels).select("doc_id")
    bad = labels.where("toxic = 1")
    assert bad.join(kept, "doc_id").count() < 0.15 * bad.count()
    assert kept.count() > 0.8 * docs.count()


def test_held_out_labels_are_not_read(tables):
    docs, labels = tables
    from pyspark.sql import functions as F
    from rideflow.llm.common import in_fold

    flipped = labels.withColumn(
        "toxic", F.when(in_fold(F.col("doc_id"), 5), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.logistic, b.logistic)
