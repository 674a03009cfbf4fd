"""The factorisation machine: its scores against all pairs, its gradient against differences, held-out accuracy, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.llm import factor

KIND = "doc_id long, text string, n_chars long, row string, score double, quality int"


def test_score_equals_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    model = factor.new_model() | {"bias": 0.3, "linear": rng.standard_normal(factor.SLOTS + factor.STATISTICS)}
    texts = ["one two three two", "", None, "x " * 50, "a b"]
    owner, slot, value, stats = factor.inputs_of(texts, [1, None, 3, 4, 5], factor.Words())
    model |= {"mean": stats.mean(axis=0), "spread": np.where(stats.std(axis=0) > 0, stats.std(axis=0), np.inf)}
    inputs = factor.with_statistics(owner, slot, value, factor.standardised(model, stats))
    got = factor.logits(model, *inputs, len(texts))
    for i in range(len(texts)):
        own = [(s, v) for o, s, v in zip(*inputs) if o == i]
        want = model["bias"] + sum(model["linear"][s] * v for s, v in own)
        want += sum(model["factors"][a] @ model["factors"][b] * x * y for k, (a, x) in enumerate(own) for b, y in own[:k])
        assert got[i] == pytest.approx(want)


def prose(i, junk):
    r = np.random.default_rng(i)
    words = r.choice(["The", "house", "by", "water", "is", "green.", "Rivers", "flow"], 30 + i % 40)
    return " ".join(w.upper() + "!!" if junk else w for w in words)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, prose(i, i % 5 == 1), 100, "x", 0.5, 7) for i in range(300)]
    rows += [(900, None, None, "x", 0.5, 7), (901, "", 0, None, None, None), (None, prose(5, False), 5, "x", 0.5, 7), (902, prose(3, False) * 3000, 9, "x", 0.5, 7)]
    labels = [(i, 0 if i % 5 == 1 else 1) for i in range(0, 300, 2)] + [(2, 0), (4, None), (None, 1), (901, 1)]
    return spark.createDataFrame(rows + rows[:2], KIND), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents_are_told_apart(spark, tables):
    docs, labels = tables
    model = factor.fit(*factor.training_examples(docs.select("doc_id", "text", "n_chars"), labels))
    out = factor.score_texts(docs, model).select("row.doc_id", "score", factor.is_held_out("row.doc_id").alias("held")).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    told = [(r.score >= factor.THRESHOLD) == (r.doc_id % 5 != 1) for r in out if r.held and r.doc_id is not None and r.doc_id < 300]
    assert len(told) > 30 and np.mean(told) >= 0.95
    again = factor.fit(*factor.training_examples(docs.select("doc_id", "text", "n_chars").repartition(5), labels))
    assert all(np.array_equal(model[k], again[k]) for k in model)


def test_held_out_labels_are_never_read(spark, tables):
    docs, labels = tables
    docs = docs.select("doc_id", "text", "n_chars")
    flipped = labels.withColumn("quality", F.when(factor.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (factor.fit(*factor.training_examples(docs, x)) for x in (labels, flipped))
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_sample_is_bounded_and_long_texts_teach(spark, tables):
    docs, labels = tables
    examples, y = factor.training_examples(docs.select("doc_id", "text", "n_chars"), labels, bound=20)
    assert 5 < len(y) < 80 and set(y.tolist()) == {0, 1}
    long = spark.createDataFrame([(1, "word " * 300_000, 5), (2, "x", 1)], "doc_id long, text string, n_chars long")
    examples, y = factor.training_examples(long, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert len(y) == 2 and len(examples[0][0]) == 1


def test_without_rows_or_labels(spark, tables):
    docs, labels = tables
    model = factor.fit(*factor.training_examples(docs.limit(0).select("doc_id", "text", "n_chars"), labels))
    assert factor.score_texts(docs.limit(0), model).collect() == []
    assert {r.score for r in factor.score_texts(docs, model).collect()} == {0.5}
