import re
from collections import Counter

from conftest_data import FOLDER
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from touchline.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def check(docs):
    want = sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    got = quality_rules.judge(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    return got


def test_equals_brute_force_on_the_given_documents(spark):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_edges(documents, edge_rows):
    long = " ".join(f"w{i % 700}" for i in range(20_000))  # more repeated windows than are looked up
    check(documents(edge_rows + [(50, long), (51, "a b c a b c a b"), (52, "x\nx\n y\n\n\n \nx"), (53, "a a a a")]))
    assert quality_rules.judge(documents([])).count() == 0


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "\n", " ", "#", "é"]), max_size=40).map(" ".join), max_size=6))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_text(documents, texts):
    check(documents(list(enumerate(texts))))


def test_documents_unlike_their_language_fail_and_ordinary_ones_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs).join(marks, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert all(good) and sum(bad) < 0.8 * len(bad)


def test_short_and_unlisted_documents_are_compared_too(spark, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    salad = " ".join(f"lorem{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70))
    junk = " ".join(f"#{i}$%{i * 7}|" for i in range(80))
    more = documents([(-1, salad, "en"), (-2, junk, None), (-3, junk, "xx")]).select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in quality_rules.judge(docs.unionByName(more)).where("doc_id < 0").collect()}
    assert len(got) == 3 and not any(r.base_failed or r.kept for r in got.values())


def test_no_python(documents):
    plan = quality_rules.measure(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
