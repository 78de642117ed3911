import re
from collections import defaultdict

from touchline.llm import exact_dedup
from touchline.llm.common import stored


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    return groups


def test_equals_brute_force_with_edges(documents, edge_rows):
    rows = edge_rows + [(20, "a  b"), (11, "a b"), (12, "a\tb"), (13, "a b "), (14, "A b")]
    got = exact_dedup.deduplicate(documents(rows)).collect()
    assert len(got) == len(rows)
    groups = brute(rows)
    by_id = {r.doc_id: r for r in got}
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            assert by_id[i].keep_id == keep and by_id[i].group_size == len(ids)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_one_row_of_each_text_stays_with_all_columns(documents, edge_rows):
    docs = documents(edge_rows)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(brute(edge_rows))
    assert {r.kept for r in kept.collect()} == {"x"}


def test_empty_table(documents):
    assert exact_dedup.deduplicate(documents([])).count() == 0
    assert exact_dedup.keep_first(documents([])).count() == 0


def test_a_hot_text_never_meets_in_one_task(spark, documents):
    docs = documents([(i, "same" if i % 3 == 0 else f"text {i}") for i in range(3000)])
    got = exact_dedup.deduplicate(docs).where("group_size > 1")
    assert got.count() == 1000 and got.where("kept").collect()[0].doc_id == 0
    plan = exact_dedup.merge_runs(exact_dedup.numbered(exact_dedup.fingerprints(docs)))._jdf.queryExecution().executedPlan().toString()
    # Every round combines on the map side, and none gathers rows.
    assert plan.count("partial_min") == exact_dedup.ROUNDS + 1
    assert "collect_" not in plan and "Python" not in plan


def test_runs_are_sorted_and_merged_in_binomial_rounds(spark, documents):
    docs = documents([(i, f"text {i % 700}") for i in range(2000)]).repartition(8)
    prints = exact_dedup.numbered(exact_dedup.fingerprints(docs))
    for part in prints.select("run", *exact_dedup.KEY).rdd.glom().collect():
        assert part == sorted(part)
    merged = exact_dedup.merge_runs(stored(prints, "runs"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate(") == 2 * (exact_dedup.ROUNDS + 1) and "HashAggregate(" not in plan
    assert plan.count("Exchange hashpartitioning(run") == exact_dedup.ROUNDS + 1
    assert merged.count() == 700 and merged.agg({"group_size": "sum"}).first()[0] == 2000


def test_the_row_that_stays_does_not_depend_on_order(spark):
    rows = [(1, "a b", "z", {"k": 1}), (1, "a  b", "y", None), (1, "a b", "x", {"k": 2}), (2, "a b", "w", None), (None, None, "v", None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, more map<string,int>").repartition(3)
        got = sorted(((r.doc_id, r.text, r.source) for r in exact_dedup.keep_first(docs).collect()), key=repr)
        assert got == [(1, "a  b", "y"), (None, None, "v")]
