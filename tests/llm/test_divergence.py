"""The audit against dictionaries and whole fractions, the perfect hash against its definition."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def brute_force(rows, least=30, top=50):
    """Rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    frequency, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(FOLD))
        frequency[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in counts:
        kept = sorted(t for t, n in frequency[lang].items() if n >= least)
        own = [g for g in counts if g[0] == lang]

        def shares(count):
            n, v = sum(count[t] for t in kept), len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * v) for t in kept}

        p, whole = shares(counts[lang, source]), shares(sum((counts[g] for g in own), Counter()))
        pairs = []
        for _, other in own:
            if other != source:
                q = shares(counts[lang, other])
                pairs.append((-sum(abs(p[t] - q[t]) for t in kept), other.encode()))
        more = [
            (whole[t] - p[t], t.encode()) for t in kept if counts[lang, source][t] > 0 and p[t] > whole[t]
        ]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
            out += [(lang, source, part, item.decode(), -f, n) for n, (f, item) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame(
        [(i, *r, "x", 1) for i, r in enumerate(rows)],
        "doc_id long, text string, lang string, source string, item string, value int",
    )
    got = divergence.audit(docs, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def corpus(n=500, sources=6):
    words = ["the", "cat", "Ähre", "été", "of", "x" * 70, "Zeit", "don", "and", "zebra", "ñu", "ab"]
    return [
        (" ".join(words[(i * j + i // 7 + j * j) % (3 + i % 9)] for j in range(i % 40)) + f" rare{i}",
         ("en", "de", "fr")[i % 3 if i % 11 else 0], f"src{i * i % sources}")
        for i in range(n)
    ]


def test_whole_audit_equals_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute_force(rows)


def test_edges(spark):
    rows = corpus(200, 3) + [
        (None, None, None), ("", "en", None), ("the cat " * 3000, "en", "src0"), ("A" * 50_000, "en", "long"),
        ("1 2 3 ...", "en", "no terms"), ("lonely", "xx", "alone"), ("two", "yy", "a"), ("two", "yy", "b"),
        ("two", "yy", "b"), ("nul\0byte The the", "en", "src1"),
    ]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, rows, min_documents=1, top_terms=3) == brute_force(rows, 1, 3)
    assert run(spark, []) == []


def test_no_kept_terms(spark):
    rows = [("a b", "en", "s1"), ("c", "en", "s2"), (None, "de", "s1")]
    assert run(spark, rows) == brute_force(rows) == [
        ("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1),
    ]


def test_shards_rounds_tiles_and_flushes_make_no_difference(spark):
    rows = corpus(400, 7)
    small = divergence.Limits(shard=3, round_bytes=300, task_bytes=500, task_slots=10, sources=2, terms=4)
    assert run(spark, rows, min_documents=2, limits=small) == brute_force(rows, 2)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(max_size=12), max_size=300))
def test_perfect_hash_is_minimal_and_verified(keys):
    keys = sorted(keys)
    made = divergence.PerfectHash.build(keys)
    assert sorted(made.find(keys).tolist()) == list(range(len(keys)))
    strangers = [k + b"?" for k in keys if k + b"?" not in set(keys)] + [b"another one"]
    assert (made.find(strangers) == -1).all()


@pytest.mark.parametrize("n", [1, 2**40])
def test_shares_are_exact_for_large_counts(n):
    counts = np.array([0, 1, n, 3 * n], dtype=np.int64)
    total = int(counts.sum())
    got = divergence._share(counts, np.int64(total), 4)
    assert got.tolist() == [1 + 10**9 * (int(c) + 5) // (total + 20) for c in counts]
