"""Importance resampling against plain Python: dictionaries, math and a sort."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import importance

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def buckets(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute_force(rows, targets):
    """{row index: (n_features, weight, score, rank)} of (doc_id, text) rows."""
    source, target = Counter(), Counter()
    for _, text in rows:
        source.update(buckets(text))
    for text in targets:
        target.update(buckets(text))
    s_all, t_all = sum(source.values()), sum(target.values())

    def gain(b):
        return math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000))))

    out, able = {}, []
    for i, (doc_id, text) in enumerate(rows):
        found = buckets(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        name = f"7:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [doc_id, len(found), weight, score, None]
        if len(words(text)) >= 20:
            able.append(i)
    able.sort(key=lambda i: (-out[i][3], rows[i][0] is not None, rows[i][0] or 0))
    for rank, i in enumerate(able[:25 * len(able) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out.values()), key=repr)


def run(spark, docs, targets):
    benchmark = spark.createDataFrame(list(enumerate(targets)), "item_id long, text string")
    got = importance.resample(docs, benchmark)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, got.collect()), key=repr)


TEXT = st.text(alphabet="abzAZ09 .-é😀\n_", max_size=120)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 200))
def test_words_and_buckets_are_those_of_plain_python(texts, size):
    kept, importance.SLICE_BYTES = importance.SLICE_BYTES, size
    try:
        got = []
        for n, data, offsets in importance._slices(pa.array(texts, pa.string())):
            n_words, owner, bucket = importance._features(data, offsets)
            got += [(int(n_words[k]), sorted(bucket[owner == k].tolist())) for k in range(n)]
    finally:
        importance.SLICE_BYTES = kept
    assert got == [(len(words(t)), sorted(buckets(t))) for t in texts]


def test_long_words_take_the_other_road_to_the_same_sum():
    text = " ".join("x" * n + " y" for n in (1, 47, 48, 49, 50_000))
    (_, data, offsets), = importance._slices(pa.array([text]))
    assert sorted(importance._features(data, offsets)[2].tolist()) == sorted(buckets(text))


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_bit_planes_add_up_to_the_product(seed):
    random = np.random.default_rng(seed)
    gains = random.integers(-9000, 9000, importance.N_BUCKETS)
    counts = random.poisson(0.02, (5, importance.N_BUCKETS))
    counts[0, 7] = 123_456
    assert (importance.weigh_counts(counts, importance.gain_planes(gains)) == counts @ gains).all()
    assert (importance.weigh_counts(counts, importance.gain_planes(gains * 0)) == 0).all()


def test_whole_table_equals_brute_force(spark, documents, edge_rows):
    vocabulary = [f"w{i}" for i in range(60)] + ["Ähre", "ßt", "ÉTÉ"]
    rows = [
        (i, " ".join(vocabulary[(i * i + 7 * j * (1 + i % 5)) % len(vocabulary)] for j in range(5 + i % 60)))
        for i in range(300)
    ]
    rows += [(r[0], r[1]) for r in edge_rows]
    rows += [(1000 + i, rows[50][1]) for i in range(40)] + [(2000, rows[60][1])] * 30
    targets = [rows[3][1], rows[3][1], "w1 w2 w3", None, ""]
    assert run(spark, documents(rows), targets) == brute_force(rows, targets)


def test_empty_tables(spark, documents):
    assert run(spark, documents([]), ["a b"]) == []
    rows = [(i, "some words " * 12) for i in range(8)]
    assert run(spark, documents(rows), []) == brute_force(rows, [])


def test_selected_rows_keep_their_columns(spark, documents):
    docs = documents([(i, f"word{i} and others " * 10) for i in range(40)])
    benchmark = spark.createDataFrame([(1, "word3 and word4")], "item_id long, text string")
    got = importance.selected(docs, benchmark)
    drawn = importance.resample(docs, benchmark).where("rank IS NOT NULL")
    assert got.columns == docs.columns and got.count() == 10
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in drawn.collect()}


def test_one_doc_id_on_a_third_of_all_rows_falls_into_many_ranges(spark, documents):
    text = "the same words again and again " * 5
    rows = [(7, text)] * 400 + [(100 + i, f"other{i} words " * 15) for i in range(800)]
    scored = importance.with_score(importance.weigh(documents(rows), spark.createDataFrame([(1, "a")], "i int, text string")))
    ranks = importance.ranked(scored.select("doc_id", "score"))
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(1, 1201))
