import binascii
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest_data import FOLDER

from touchline.llm import boosting, quality_classifier


def test_trees_learn_an_interaction_and_walk_alike_in_any_batch():
    random = np.random.default_rng(3)
    rows = random.normal(size=(4000, 5)).astype(np.float32)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0)).astype(float)
    model = boosting.train(rows[:3000], labels[:3000])
    p = model.probability(rows[3000:])
    assert ((p >= 0.5) == labels[3000:]).mean() > 0.95
    assert np.allclose(p, [model.probability(rows[i:i + 1])[0] for i in range(3000, 4000)])


def test_nothing_to_learn():
    none = boosting.train(np.zeros((0, 3)), np.zeros(0))
    assert none.probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = boosting.train(np.ones((50, 3)), np.ones(50))
    assert (one.probability(np.zeros((2, 3))) > 0.9).all()


def test_statistics_of_small_texts():
    zero = dict(zip(quality_classifier.FEATURES, quality_classifier.statistics(b"")))
    assert zero["lower"] == zero["log_chars"] == zero["log_words"] == zero["longest_word"] == 0
    one = dict(zip(quality_classifier.FEATURES, quality_classifier.statistics(b"AB ab\nAB ab\n!!")))
    assert one["upper"] == 4 / 14 and one["newline"] == 2 / 14 and one["shout"] == 2 / 14
    assert one["repeated_lines"] == pytest.approx(1 / 3) and one["distinct_words"] == 3 / 5


def test_held_out_accuracy_on_the_given_tables(spark):
    docs, marks = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_classifier.classify(docs, marks).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (binascii.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in marks.collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.9


def test_labels_of_held_out_rows_do_not_matter(spark, documents, labels):
    rows = [(i, ("good prose and words " if i % 2 else "### $$$ ") * (3 + i % 7)) for i in range(200)]
    truth = [(i, i % 2, 0) for i in range(200)]
    flipped = [(i, 1 - q if binascii.crc32(str(i).encode()) % 3 == 1 else q, 1) for i, q, _ in truth]
    docs = documents(rows)
    a, b = ({r.doc_id: r.score for r in quality_classifier.classify(docs, labels(t)).collect()} for t in (truth, flipped))
    assert a == b
    kept = quality_classifier.keep_good(docs, labels(truth))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in a if a[i] >= 0.5}


def test_edges(documents, labels, edge_rows):
    docs = documents(edge_rows)
    got = quality_classifier.classify(docs, labels([(5, 1, 0), (4, 0, 0), (7, None, 0)])).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.classify(docs, labels([])).select("score").distinct().collect()[0][0] == 0.5
    assert quality_classifier.classify(documents([]), labels([])).count() == 0
    assert quality_classifier.keep_good(documents([]), labels([])).count() == 0


def test_a_batch_is_judged_in_little_memory(monkeypatch):
    rows = np.random.default_rng(7).random((500, len(quality_classifier.FEATURES))).astype(np.float32)
    model = boosting.train(rows, (rows[:, 0] > 0.5).astype(np.float64))
    texts = [f"{i} some words " * 40 for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(texts)], ["doc_id", "text"])

    class Docs:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, _):
            return run

    for name, value in (("train", lambda *_: model), ("measure", lambda _: None), ("stored", lambda *_: None)):
        monkeypatch.setattr(quality_classifier, name, value)
    run = quality_classifier.keep_good(Docs(), None)
    tracemalloc.start()
    kept = [x for part in run(iter([batch])) for x in part.column("doc_id").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    values = quality_classifier._matrix(batch.column("text")).astype(np.float32)
    assert kept == np.flatnonzero(model.probability(values) >= quality_classifier.ACCEPT).tolist()
    assert peak < 6e6
