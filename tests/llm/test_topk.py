"""Histogram selection against sorting all scores in plain Python."""

import math
import random

import pytest

from touchline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def single(x):
    """A float as 32 bits keep it."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def brute_force(rows, k=10, every=100):
    valid = [
        (i, [math.floor(1024 * single(x)) for x in v]) for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in valid:
        if q is None or q % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in valid if i != q and len(a) == len(b)
        )
        out += [(q, n, None if null else i, -s) for n, (s, null, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, **options):
    got = topk.search(table(spark, rows), **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.2) for _ in range(dim)]) for i in range(n)]


def test_random_vectors(spark):
    rows = vectors(700, 16)
    assert run(spark, rows) == brute_force(rows)


def test_copies_ties_nulls_and_odd_lengths(spark):
    rows = vectors(150, 4)
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # one vector on most rows
    rows += [(2000 + i, [0.0] * 4) for i in range(50)]
    rows += [(3000, None), (3100, [1.0, None, 0.0, 0.0]), (3200, [float("nan")] * 4), (3300, [float("inf")] * 4)]
    rows += [(400, []), (401, []), (500, [1.0, 2.0]), (501, [0.5, -1.0]), (None, rows[0][1]), (None, [9.0] * 4)]
    rows += [(600, [0.25] * 4)] * 2  # a repeated query
    assert run(spark, rows) == brute_force(rows)


def test_fewer_rows_than_asked_and_other_sizes(spark):
    rows = vectors(7, 3)
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, rows, k=2, every=1) == brute_force(rows, 2, 1)
    assert run(spark, [(1, [1.0])]) == run(spark, [(100, [1.0])]) == run(spark, []) == []


def test_small_blocks_make_no_difference(spark, monkeypatch):
    rows = vectors(300, 5, seed=3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    assert run(spark, rows, every=10) == brute_force(rows, every=10)


def test_products_beyond_double_precision_stay_exact(spark):
    rows = [(i, [1.5e4 * (i % 7 + 1), -3.0e4 + i, 2.0e4]) for i in range(120)]
    assert run(spark, rows) == brute_force(rows)


def test_products_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(100, [1e20]), (1, [1e20])])
