"""The pipeline against its parts worked out in plain Python, and the queries against their SQL."""

import re
import string

import pytest
from conftest import PROSE
from conftest_data import FOLDER

import __spark_entry__ as entry
import check
import corpus_pipeline
from touchline.llm import mixing, quality_classifier
from touchline.llm.common import stored
from touchline.llm.oracle import ORACLE
from touchline.llm.queries import QUERIES


def test_operators_and_stages():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert check.compare(spark, check.duck(FOLDER), FOLDER, name) == ""


def five_words(text):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def not_first(sets):
    """Of documents linked at 0.8, directly or through others, all but the first."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) != i}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality_classifier.classify(docs, marks).collect() if r.predicted}

    def first(ids, same):
        kept = []
        for i in sorted(ids):
            if not any(same(i, j) for j in kept):
                kept.append(i)
        return kept

    text = {i: " ".join((rows[i].text or "").replace("\n", " ").split(" ")) for i in good}
    unlike = first(good, lambda i, j: text[i] == text[j])
    later = not_first({i: five_words(rows[i].text) for i in unlike})
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "piece_ids"]
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(times) == set(unlike) - later
    alone = docs.where(docs.doc_id.isin([int(i) for i in times]))
    assert times == {r.doc_id: r.copies for r in mixing.plan(alone, marks).collect()}


def test_odd_rows_through_all_stages(spark, documents, labels, edge_rows, folder):
    docs = documents([*edge_rows, (10, PROSE * 9, "en"), (11, PROSE * 9 + "and more", "en"), (12, "an odd one out " * 30, "fr")])
    docs.write.parquet(f"{folder}/documents.parquet")
    labels([(5, 1, 0), (8, 0, 0), (None, 1, None), (99, 0, 1)]).write.parquet(f"{folder}/labels.parquet")
    step = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, folder)
        assert name == "pieces" or step.columns == docs.columns
        step = stored(step, "stage")
        sizes.append(step.count())
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*[c for c in docs.columns if c != "text"], "piece_ids"]
    assert out.count() == sizes[-1]
    # Equal rows are one, and of the near copies the first stays.
    kept = [r.doc_id for r in out.select("doc_id").distinct().collect()]
    assert 11 not in kept and len(kept) == len(set(kept))


def test_empty_tables_through_all_stages(spark, documents, labels, folder):
    documents([]).write.parquet(f"{folder}/documents.parquet")
    labels([]).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
