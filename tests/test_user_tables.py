"""Attribution from tables laid out by user and block."""

import random
import re
import uuid
from datetime import timedelta

import pytest
from builders import P, at, conversions, impressions

from touchline.plans import attribution
from touchline.plans.user_tables import CELL, NotStored, UserTables


def events(spark, seed=1, n=400):
    """Users of different size, one with a third of all rows; some without an id or conversions."""
    rng = random.Random(seed)
    start = at("2024-01-01 00:00:00")

    def some(key):
        return {
            "user_id": rng.choice(["hot"] * 6 + [None] + [f"u{k}" for k in range(12)]),
            "event_timestamp": start + timedelta(seconds=rng.randrange(30 * 86400) // 600 * 600),
        } | key

    touches = [
        some({"channel": rng.choice(["Search", "Video", None]), "campaign_id": rng.choice(["a", "b"])}) for _ in range(n)
    ]
    buys = [some({"conversion_value_usd": float(rng.randrange(200))}) for _ in range(n // 4)]
    return impressions(spark, touches), conversions(spark, buys)


@pytest.fixture
def tables(spark):
    made = UserTables(spark, f"users_{uuid.uuid4().hex}")
    yield made
    made.drop()


def rows(frame):
    return sorted((
        tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.collect()
    ), key=repr)


@pytest.mark.parametrize("hot_rows", [1, 30, 10_000])
@pytest.mark.parametrize("unattributed", [True, False])
def test_shares_are_those_of_the_events(spark, tables, hot_rows, unattributed):
    touches, buys = events(spark)
    p = P.with_(attribution_window_days=9)
    tables.store(touches, buys, p, buckets=4, hot_rows=hot_rows)
    want = attribution.credit_shares(buys, touches, p, unattributed)
    got = tables.credit_shares(p, unattributed)
    assert got.columns == want.columns
    assert rows(got) == rows(want)
    cells = spark.table(tables.table("hot_cells"))
    assert {1: 5, 30: 3, 10_000: 0}[hot_rows] <= cells.count() <= 1000


def test_cells_of_many_rows_lie_in_no_bucket(spark, tables):
    touches, buys = events(spark)
    tables.store(touches, buys, P.with_(attribution_window_days=9), buckets=4, hot_rows=30)
    assert {r.user_id for r in spark.table(tables.table("hot_cells")).collect()} == {"hot"}
    largest = spark.table(tables.table("touches")).groupBy(*CELL).count().agg({"count": "max"}).first()[0]
    assert largest <= 30


# A shuffle for a join or an aggregate by user and block, and not for what comes after it on the time line.
MEETING = re.compile(r"Exchange hashpartitioning\(user_id#\d+(, block#\d+L)?(, channel#\d+, campaign_id#\d+)?, \d+\)")


def test_stored_events_meet_without_a_shuffle(spark, tables):
    touches, buys = events(spark)
    tables.store(touches, buys, P, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored, raw = (
            shares._jdf.queryExecution().executedPlan().toString()
            for shares in (tables.credit_shares(P), attribution.credit_shares(buys, touches, P))
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(MEETING.findall(raw)) >= 4
    assert MEETING.findall(stored) == []
    assert stored.count("Bucketed: true") >= 4


def test_buckets_follow_the_rows(spark, tables):
    touches, buys = events(spark, n=100)
    tables.store(touches, buys, P, rows_per_bucket=20)
    made = dict(
        (r.col_name, r.data_type) for r in spark.sql(f"DESCRIBE FORMATTED {tables.table('touches')}").collect()
    )
    assert int(made["Num Buckets"]) > 4


def test_another_window_is_refused(spark, tables):
    with pytest.raises(NotStored, match="not there"):
        tables.credit_shares(P)
    touches, buys = events(spark, n=40)
    tables.store(touches, buys, P, buckets=2)
    with pytest.raises(NotStored, match="28, not 7 days"):
        tables.credit_shares(P.with_(attribution_window_days=7))
    spark.sql(f"ALTER TABLE {tables.table('touches')} UNSET TBLPROPERTIES ('touchline.attribution_window_days')")
    with pytest.raises(NotStored, match="unknown"):
        tables.credit_shares(P)


def test_tables_without_rows(spark, tables):
    touches, buys = events(spark, n=40)
    tables.store(touches.limit(0), buys, P, buckets=2)
    assert tables.credit_shares(P, unattributed=False).isEmpty()
    assert tables.credit_shares(P).count() == buys.count()
    tables.store(touches, buys.limit(0), P)
    assert tables.credit_shares(P).isEmpty()
