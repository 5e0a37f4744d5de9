"""Training samples are bounded without a preference for short texts, and models are made in a task."""

import numpy as np

from fathomline.llm import toxicity
from fathomline.llm.common import labelled_sample, trained

SCHEMA = "doc_id long, text string"


def sample_of(spark, docs, rows, chars, each=False):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    return {r.doc_id: r.text for r in labelled_sample(spark.createDataFrame(docs, SCHEMA), labels, "toxic", rows=rows, chars=chars, each=each).collect()}


def test_long_texts_are_not_left_out_first(spark):
    docs = [(i, "x" * (5000 if i % 2 else 50)) for i in range(400)]
    whole = sample_of(spark, docs, 100, 1 << 26)
    cut = sample_of(spark, docs, 100, 100_000)
    assert len(whole) == 100 and set(cut) < set(whole)
    assert sum(map(len, cut.values())) <= 100_000 and 25 < len(cut) < 60
    long = np.mean([len(t) == 5000 for t in cut.values()])
    assert 0.25 < long < 0.75  # half of them are long, and the draw does not see it
    assert len(sample_of(spark, [(i, "y" * 9000) for i in range(50)], 10, 100)) == 1  # one is always kept
    both = sample_of(spark, docs, 20, 1 << 26, each=True)
    assert sum(i % 2 for i in both) == 20 and len(both) == 40


def test_models_come_back_from_a_task(spark):
    docs = [(i, "you idiotic scumbag w" if i % 2 else f"plain words {i}") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, SCHEMA)
    model = trained(labelled_sample(frame, labels, "toxic"), toxicity.Model)
    here = toxicity.Model(sorted((r.doc_id, r.text, r.y) for r in labelled_sample(frame, labels, "toxic").collect()))
    assert model.features == here.features and np.allclose(model.weights, here.weights) and np.allclose(model.layer, here.layer)
    empty = trained(labelled_sample(frame.where("false"), labels, "toxic"), toxicity.Model)
    assert empty.constant == 0.5
