"""Tables merged batch by batch, against dictionaries."""

import os
import random
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from touchline.sources.runs import KeyedTable, SummedTable, runs_after

VALUES = "id string, value long"


@given(st.integers(0, 5000))
def test_runs_cover_all_batches_once(n):
    runs = runs_after(n)
    assert [b for first, last in runs for b in range(first, last + 1)] == list(range(n))
    assert len(runs) <= n.bit_length()


def keyed(spark, folder, buckets=4):
    return KeyedTable(spark, f"{folder}/keyed", spark.createDataFrame([], VALUES).schema, "id", buckets)


def put(spark, table, batch, rows, gone=()):
    table.put_changes(
        spark.createDataFrame(rows, VALUES), batch, spark.createDataFrame([(g,) for g in gone], "id string")
    )


def content(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_newest_batch_wins_and_gone_keys_go(spark, folder):
    rng, table, want = random.Random(5), keyed(spark, folder), {}
    for batch in range(8):
        ids = rng.sample([None, "a", "b", "c", "d", "e", "f"], 3)
        changed = {i: [batch * 10 + n for n in range(rng.randint(1, 2))] for i in ids[:2]}
        put(spark, table, batch, [(i, v) for i, values in changed.items() for v in values], ids[2:])
        want.update(changed)
        want.pop(ids[2], None)
        assert content(table.latest()) == sorted(((i, v) for i, vs in want.items() for v in vs), key=repr)
        assert content(table.changed_in(batch)) == sorted(((i, v) for i, vs in changed.items() for v in vs), key=repr)
    assert table.batches() == 8
    # One run is left, and what the last merge has made superfluous.
    assert sum(name == "run=0-7" for name in os.listdir(table.path)) == 1
    assert len(os.listdir(table.path)) <= 5


def test_a_repeated_batch_changes_nothing(spark, folder):
    table = keyed(spark, folder)
    for batch, value in enumerate((1, 2, 3)):
        put(spark, table, batch, [("a", value), (f"b{batch}", 0)])
    before = content(table.latest())
    put(spark, table, 2, [("a", 3), ("b2", 0)])
    assert content(table.latest()) == before
    assert content(table.latest(2)) == [("a", 2), ("b0", 0), ("b1", 0)]  # as of two batches


def test_named_keys_are_read_from_their_buckets_only(spark, folder):
    table = keyed(spark, folder, buckets=8)
    for batch in range(3):
        put(spark, table, batch, [(f"id{n}", batch) for n in range(40)])
    wanted = spark.createDataFrame([("id7",)], "id string")
    mine = wanted.select(table.bucket()).first()[0]
    for run in os.listdir(table.path):
        for bucket in os.listdir(f"{table.path}/{run}"):
            if bucket.startswith("_bucket=") and bucket != f"_bucket={mine}":
                for name in os.listdir(f"{table.path}/{run}/{bucket}"):
                    if name.endswith(".parquet"):
                        with open(f"{table.path}/{run}/{bucket}/{name}", "w") as f:
                            f.write("not parquet")
                    else:
                        os.remove(f"{table.path}/{run}/{bucket}/{name}")
    assert content(table.latest(keys=wanted)) == [("id7", 2)]


def test_empty_batches(spark, folder):
    table = keyed(spark, folder)
    put(spark, table, 0, [])
    put(spark, table, 1, [], ["never there"])
    assert content(table.latest()) == [] and table.batches() == 2
    put(spark, table, 2, [("a", 1)])
    assert content(table.latest()) == [("a", 1)]


def test_signed_sums_cancel(spark, folder):
    schema = "name string, event_date date, rows long, amount decimal(28,6)"
    table = SummedTable(spark, f"{folder}/sums", schema, ["rows", "amount"])
    rng, want = random.Random(2), Counter()
    for batch in range(6):
        added = [(rng.choice([None, "x", "y"]), rng.randint(1, 2), rng.choice([-1, 1, 2])) for _ in range(4)]
        frame = spark.createDataFrame(
            [(name, f"2024-01-0{day}", n, n / 4) for name, day, n in added],
            "name string, event_date string, rows long, amount double",
        ).selectExpr("name", "cast(event_date as date) event_date", "rows", "cast(amount as decimal(28,6)) amount")
        table.put(table.combine(frame), batch)
        for name, day, n in added:
            want[name, day] += n
    got = {(r.name, r.event_date.day): (r.rows, float(r.amount)) for r in table.totals().collect()}
    assert got == {key: (n, n / 4) for key, n in want.items() if n > 0}
