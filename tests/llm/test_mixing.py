import pytest
from pyspark.sql import functions as F

from touchline.llm import mixing

WORDS = {
    "en": "the thing that hath to be of it not ", "de": "der zu und schön groß für über ihn ",
    "fr": "où été forêt ça là déjà élève à ", "es": "año niño así más según señor está ",
}


def corpus(counts):
    rows, i = [], 0
    for lang, n in counts.items():
        for k in range(n):
            rows.append((i, WORDS[lang] * (5 + k % 4), lang))
            i += 1
    return rows


def test_expected_tokens_meet_the_targets(documents, labels):
    rows = corpus({"en": 120, "de": 30, "fr": 30, "es": 20})
    got = mixing.plan(documents(rows), labels([(r[0], 1, 0) for r in rows[::2]]))
    sums = got.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in mixing.TARGETS]).first()
    whole = sum(sums)
    for d, share in mixing.TARGETS.items():
        assert sums[d] / whole == pytest.approx(share, abs=1e-3)
    rows_out = {r.doc_id: r for r in got.collect()}
    assert all(rows_out[i].asDict()[f"p_{lang}"] > 0.9 for i, _, lang in rows)
    assert all(r.rate >= 1 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows_out.values())


def test_descent_equals_a_direct_solution(spark):
    """Two domains with soft members: compare with projected gradient descent on plain lists."""
    weights = [(10, 32, 0), (30, 0, 32), (20, 16, 16), (5, 24, 8)]
    placed = spark.createDataFrame(weights, "tokens long, a int, b int").select(
        F.struct("tokens").alias("x"), F.struct(F.col("a").alias("q_a"), F.col("b").alias("q_b")).alias("q")
    )
    targets = {"a": 0.7, "b": 0.3}
    steps = mixing.fit(placed, targets, floor=0.0, tokens=60.0)
    got = placed.select("x.tokens", "q", mixing.rate(F.col("q"), steps, ["a", "b"], 0.0).alias("r")).collect()
    w = [x[0] for x in weights]
    p = [(x[1] / 32, x[2] / 32) for x in weights]
    present = [sum(wi * pi[d] for wi, pi in zip(w, p)) for d in range(2)]
    r = [1.0] * 4
    for _ in range(2000):
        g = [(sum(wi * pi[d] * ri for wi, pi, ri in zip(w, p, r)) - t) / present[d] for d, t in enumerate((42.0, 18.0))]
        r = [max(0.0, ri - pi[0] * g[0] - pi[1] * g[1]) for ri, pi in zip(r, p)]
    assert {x.tokens: x.r for x in got} == pytest.approx(dict(zip(w, r)), abs=1e-2)
    assert all(x.r >= 0 for x in got)


def test_rows_are_repeated_whole(documents, labels):
    rows = corpus({"en": 60, "de": 6, "fr": 6, "es": 6})
    docs = documents(rows)
    marks = labels([(r[0], 1, 0) for r in rows])
    mixed = mixing.mix(docs, marks)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {r.doc_id: r.copies for r in mixing.plan(docs, marks).collect()}
    assert len(times) == len(rows)


def test_many_copies_are_made_in_parts(documents, labels):
    """One document of a domain wanted at a tenth of all tokens: its copies are dealt out, none is lost."""
    rows = corpus({"en": 300, "de": 100, "fr": 100, "es": 1})
    docs, marks = documents(rows), labels([(r[0], 1, 0) for r in rows])
    want = {r.doc_id: r.copies for r in mixing.plan(docs, marks).collect()}
    assert max(want.values()) > 20
    mixed = mixing.mix(docs, marks, at_once=7)
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    assert "REPARTITION" not in mixing.mix(docs, marks)._jdf.queryExecution().executedPlan().toString()


def test_missed_targets_are_said(documents, labels):
    """There is no Spanish to repeat."""
    rows = corpus({"en": 20, "de": 20, "fr": 20})
    with pytest.warns(UserWarning, match="'es'"):
        mixing.plan(documents(rows), labels([(r[0], 1, 0) for r in rows]))


def test_edges(documents, labels, edge_rows):
    docs = documents(edge_rows)
    for marks in ([], [(5, 1, 0)], [(5, 1, 0), (8, 0, 1), (None, 1, 1)]):
        got = mixing.plan(docs, labels(marks)).collect()
        assert len(got) == len(edge_rows) and all(r.rate >= 1 for r in got)
        assert all(r.tokens == 0 for r in got if r.doc_id in (1, 2, 3))
    assert mixing.plan(documents([]), labels([])).count() == 0
    assert mixing.mix(documents([]), labels([])).count() == 0


def test_no_python_on_the_way(documents, labels):
    plan = mixing.mix(documents(corpus({"en": 3, "de": 3, "fr": 3, "es": 3})), labels([(1, 1, 0)]))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
