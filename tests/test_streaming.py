from datetime import timedelta

import pytest
from builders import P, at, clicks, conversions, impressions, window_brute_force
from pyspark.sql import functions as F

from touchline.operators import rollups, staging
from touchline.operators.dedup import version_order
from touchline.operators.staging import IMPRESSION_MEASURES
from touchline.plans import campaign_mart, quality
from touchline.sources import readers, schemas
from touchline.streaming import counts, jobs


class Feed:
    """A folder of parquet files read as a stream, a batch per file."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def add(self, rows):
        self.n += 1
        rows.coalesce(1).write.parquet(f"{self.folder}/{self.n:03d}")

    def stream(self):
        return readers.stream_files(
            self.spark, f"{self.folder}/*", self.schema, files_per_trigger=1
        )


@pytest.fixture
def feed(spark, folder):
    return Feed(spark, f"{folder}/in", schemas.IMPRESSIONS)


def run(stream, folder, mode="append", **options):
    query = jobs.append_batches(stream, f"{folder}/out", f"{folder}/state", mode, **options)
    query.awaitTermination()
    return query


def test_redelivery_is_dropped_across_batches_and_restarts(spark, folder, feed):
    feed.add(impressions(spark, [{"impression_id": i} for i in ("a", "b", "a")]))
    feed.add(impressions(spark, [{"impression_id": i} for i in ("b", "c")]))
    run(jobs.first_arrivals(feed.stream(), "impression_id", P), folder)
    feed.add(impressions(spark, [{"impression_id": i} for i in ("a", "d")]))
    run(jobs.first_arrivals(feed.stream(), "impression_id", P), folder)
    got = sorted(r.impression_id for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == ["a", "b", "c", "d"]


def test_rows_later_than_the_window_are_dropped_and_counted(spark, folder, feed):
    feed.add(impressions(spark, [{"impression_id": "new", "event_timestamp": at("2024-01-20 00:00:00")}]))
    feed.add(impressions(spark, [{"impression_id": "tick", "event_timestamp": at("2024-01-20 01:00:00")}]))
    feed.add(impressions(spark, [
        {"impression_id": "in_time", "event_timestamp": at("2024-01-17 02:00:00")},
        {"impression_id": "too_late", "event_timestamp": at("2024-01-16 00:00:00")},
    ]))
    query = run(jobs.daily_counts(feed.stream(), P), folder, "update")
    dropped = sum(o.numRowsDroppedByWatermark for b in query.recentProgress for o in b.stateOperators)
    assert dropped == 1
    rows = jobs.read_latest_update(
        spark, f"{folder}/out", ["campaign_id", "campaign_name", "channel", "event_date"]
    ).collect()
    assert {str(r.event_date): r.impressions for r in rows} == {"2024-01-20": 2, "2024-01-17": 1}


def test_daily_counts_equal_batch_when_nothing_is_late(spark, folder, feed):
    rows = [
        {"impression_id": f"i{n}", "user_id": f"u{n % 5}", "impression_cost": n / 10, "is_bot": n % 7 == 0,
         "campaign_id": f"c{n % 2}", "event_timestamp": at("2024-01-18 00:00:00") + timedelta(hours=n)}
        for n in range(60)
    ]
    for start in range(0, 60, 20):
        feed.add(impressions(spark, rows[start:start + 20]))
    run(jobs.daily_counts(feed.stream(), P, approximate_reach=True), folder, "update")
    keys = ["campaign_id", "campaign_name", "channel", "event_date"]
    streamed = {
        (r.campaign_id, r.event_date): (r.impressions, r.spend, r.approximate_users)
        for r in jobs.read_latest_update(spark, f"{folder}/out", keys).collect()
    }
    staged = staging.stage_impressions(impressions(spark, rows), P)
    batch = {
        (r.campaign_id, r.event_date): (r.impressions, r.spend, r.unique_users)
        for r in rollups.impression_counts(staged).collect()
    }
    assert streamed == batch


def test_latest_version_wins_whatever_the_arrival_order(spark, folder, feed):
    def version(cost, synced):
        return {"impression_id": "x", "impression_cost": cost, "_synced_at": at(synced)}

    feed.add(impressions(spark, [version(2.0, "2024-01-22 00:00:00")]))
    feed.add(impressions(spark, [version(1.0, "2024-01-21 00:00:00")]))
    run(feed.stream(), folder)
    rows = jobs.latest_arrivals(
        spark, f"{folder}/out", "impression_id", version_order(IMPRESSION_MEASURES)
    ).collect()
    assert [r.impression_cost for r in rows] == [2.0]


def history():
    end = at("2024-01-30 12:00:00")
    touches = [
        (f"i{n}", f"u{n % 2}", end - timedelta(days=n), "Search" if n % 3 else "Video", f"c{n % 2}") for n in range(40)
    ]
    convs = [(f"v{n}", f"u{n % 3}", end - timedelta(days=2 * n), 10.0 + n) for n in range(6)]
    return convs, touches


def as_frames(spark, convs, touches):
    return (
        conversions(spark, [
            {"conversion_id": i, "user_id": u, "event_timestamp": t, "conversion_value_usd": v} for i, u, t, v in convs
        ]),
        impressions(spark, [
            {"impression_id": i, "user_id": u, "event_timestamp": t, "channel": ch, "campaign_id": ca}
            for i, u, t, ch, ca in touches
        ]),
    )


def test_attributed_batches_equal_pairing(spark, folder):
    convs, touches = history()
    arriving = Feed(spark, f"{folder}/in", schemas.CONVERSIONS)
    served = as_frames(spark, [], touches)[1]
    arriving.add(as_frames(spark, convs[:3], [])[0])
    arriving.add(as_frames(spark, convs[3:], [])[0])
    jobs.attribute_batches(
        arriving.stream(), lambda: served, f"{folder}/out", f"{folder}/state", P
    ).awaitTermination()
    got = {}
    for r in jobs.read_credits(spark, f"{folder}/out").where("n_touches > 0").collect():
        got.setdefault(r.conversion_id, {})[r.channel, r.campaign_id] = r.time_decay
    expected = window_brute_force(convs, touches)
    for cid, *_ in convs:
        assert got.get(cid, {}) == pytest.approx(expected[cid, "time_decay"])


@pytest.mark.parametrize("hot", [(), ("u0", "u1")])
def test_streaming_interval_join(spark, folder, hot):
    convs, touches = history()
    # A later pair of events moves the watermark past the conversions.
    end = at("2024-03-30 00:00:00")
    arriving = Feed(spark, f"{folder}/conversions", schemas.CONVERSIONS)
    shown = Feed(spark, f"{folder}/impressions", schemas.IMPRESSIONS)
    first = as_frames(spark, convs, touches)
    arriving.add(first[0])
    shown.add(first[1])
    pairs = lambda: jobs.touch_pairs(arriving.stream(), shown.stream(), P, hot, salts=3)
    run(pairs(), folder)
    later = as_frames(spark, [("tick", "tick", end, 0.0)], [("tick", "tick", end, "Search", "c0")])
    arriving.add(later[0])
    shown.add(later[1])
    run(pairs(), folder)
    rows = spark.read.parquet(f"{folder}/out").where("conversion_id <> 'tick'").collect()
    got = sorted((r.conversion_id, r.impression_id or "") for r in rows)
    want = []
    for cid, user, time, _ in convs:
        mine = [i for i, u, t, *_ in touches if u == user and time - timedelta(days=28) <= t <= time]
        want += [(cid, i) for i in mine or [""]]
    assert got == sorted(want)


def test_hot_users(spark):
    imps = impressions(spark, [{"user_id": "big"}] * 50 + [{"user_id": f"u{n}"} for n in range(50)])
    assert [r.user_id for r in jobs.hot_users(imps, 0.1).collect()] == ["big"]


def test_freshness_of_a_stream(spark, folder, feed):
    feed.add(impressions(spark, [{"event_timestamp": at("2024-01-29 00:00:00")}]))
    feed.add(impressions(spark, [{"event_timestamp": at("2024-01-30 14:00:00")}]))
    run(jobs.newest_events(feed.stream(), "impressions"), folder, "update")
    row = jobs.staleness(jobs.read_latest_update(spark, f"{folder}/out", ["source"]), P).first()
    assert (row.staleness_hours, row.is_stale, row.alert) == (10.0, False, True)


def test_watermark_needs_an_instant(spark):
    local = impressions(spark, [{}]).withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))
    conformed = readers.conform(local, schemas.IMPRESSIONS)
    assert dict(conformed.dtypes)["event_timestamp"] == "timestamp"


def test_redelivered_impressions_count_once(spark, folder, feed):
    row = {"impression_id": "i1", "impression_cost": 1.0, "event_timestamp": at("2024-01-20 10:00:00")}
    feed.add(impressions(spark, [row]))
    feed.add(impressions(spark, [row]))
    run(jobs.daily_counts(feed.stream(), P), folder, "update")
    rows = jobs.read_latest_update(spark, f"{folder}/out", ["campaign_id", "campaign_name", "channel", "event_date"])
    assert [(r.impressions, r.spend) for r in rows.collect()] == [(1, 1.0)]


def test_redelivered_conversions_and_late_touches_give_the_batch_result(spark, folder):
    convs, touches = history()
    arriving = Feed(spark, f"{folder}/in", schemas.CONVERSIONS)
    known = touches[3:]  # the newest three arrive after their conversions
    arriving.add(as_frames(spark, convs, [])[0])
    arriving.add(as_frames(spark, convs[2:5], [])[0])
    served = {"now": as_frames(spark, [], known)[1]}

    def go():
        jobs.attribute_batches(
            arriving.stream(), lambda: served["now"], f"{folder}/out", f"{folder}/state", P
        ).awaitTermination()

    go()
    served["now"] = as_frames(spark, [], touches)[1]
    # Another conversion, shortly after: the open ones are credited anew.
    late = ("v9", "u2", at("2024-01-30 13:00:00"), 3.0)
    arriving.add(as_frames(spark, [late], [])[0])
    go()
    got = {}
    for r in jobs.read_credits(spark, f"{folder}/out").collect():
        got.setdefault(r.conversion_id, []).append(r)
    assert set(got) == {c[0] for c in [*convs, late]}
    expected = window_brute_force(convs, touches)
    for cid, _, _, value in convs:
        assert sum(r.linear for r in got[cid]) == pytest.approx(value)
        credit = {(r.channel, r.campaign_id): r.time_decay for r in got[cid] if r.n_touches}
        assert credit == pytest.approx(expected[cid, "time_decay"])


def test_future_and_expired_conversions_get_no_credit(spark, folder):
    arriving = Feed(spark, f"{folder}/in", schemas.CONVERSIONS)
    arriving.add(as_frames(spark, [
        ("now", "u", at("2024-01-30 00:00:00"), 1.0), ("future", "u", at("2024-02-20 00:00:00"), 1.0),
        ("old", "u", at("2023-06-01 00:00:00"), 1.0),
    ], [])[0])
    jobs.attribute_batches(
        arriving.stream(), lambda: as_frames(spark, [], [])[1], f"{folder}/out", f"{folder}/state", P
    ).awaitTermination()
    assert [r.conversion_id for r in jobs.read_credits(spark, f"{folder}/out").collect()] == ["now"]


CREDIT = ["conversion_id", "user_id", "conversion_ts", "value", "channel", "campaign_id", "n_touches", "last_touch", "linear"]


def test_credit_follows_corrections_withdrawals_and_ignores_stale_versions(spark, folder):
    end = at("2024-01-28 12:00:00")
    served = as_frames(spark, [], [(f"i{n}", f"u{n % 2}", end - timedelta(days=n), "Search", "c0") for n in range(20)])[1]

    def version(name, user="u1", hours=0, value=70.0, synced=0, **more):
        return {"conversion_id": name, "user_id": user, "event_timestamp": end - timedelta(hours=hours),
                "conversion_value": value, "conversion_value_usd": value, "_synced_at": end + timedelta(hours=synced), **more}

    batches = [
        [version(n) for n in ("no user", "no time", "stale", "moved", "kept", None)],
        [version("no user", user=None, synced=2), version("no time", synced=2, event_timestamp=None),
         # The newer version lies days before; the older comes once more, with a later time.
         version("stale", hours=24 * 9, value=30.0, synced=5), version("moved", user="u0", hours=3, value=1.0, synced=2),
         version(None, value=5.0, synced=1)],
        [version("stale", hours=-3, synced=1), version("kept"), version("no value", synced=3)],
        [version("no value", value=None, synced=4), version("later", hours=-5, synced=5)],
        [version("no time", synced=9, value=8.0)],  # and back again
    ]
    feed, seen = Feed(spark, f"{folder}/in", schemas.CONVERSIONS), []
    for rows in batches:
        seen += rows
        feed.add(conversions(spark, rows))
        jobs.attribute_batches(
            feed.stream(), lambda: served, f"{folder}/out", f"{folder}/state", P, buckets=4
        ).awaitTermination()
        staged = staging.stage_conversions(conversions(spark, seen), P, details=False)
        want = jobs.credit_shares(staged, served, P).select(*CREDIT).collect()
        got = jobs.read_credits(spark, f"{folder}/out", buckets=4).select(*CREDIT).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


@pytest.mark.parametrize("level", ["day", "week"])
def test_counts_follow_corrections(spark, folder, level):
    def shown(name, day, cost=1.0, synced=0, **more):
        time = at(f"2024-01-{day} 08:00:00")
        return {"impression_id": name, "event_timestamp": time, "impression_cost": cost,
                "_synced_at": at("2024-01-20 08:00:00") + timedelta(hours=synced), **more}

    def bought(name, day, value=10.0, synced=0, **more):
        time = at(f"2024-01-{day} 09:00:00")
        return {"conversion_id": name, "event_timestamp": time, "conversion_value": value, "conversion_value_usd": value,
                "_synced_at": at("2024-01-20 09:00:00") + timedelta(hours=synced), **more}

    imps = [
        [shown("cost", 15), shown("day", 15, user_id="u2"), shown("bot", 15), shown("gone", 16, user_id="u3"), shown("x", 17)],
        [shown("cost", 15, cost=5.0, synced=1), shown("day", 18, user_id="u2", synced=1), shown("bot", 15, is_bot=True, synced=1),
         shown("gone", 16, user_id=None, synced=1), shown("x", 17, cost=3.0, synced=-1)],
        [shown("gone", 16, user_id="u4", synced=2, campaign_id="other"), shown("cost", 15, synced=0), shown("y", 17, user_id="u2")],
    ]
    convs = [
        [bought("a", 15), bought("b", 15, user_id="u2"), bought(None, 17), bought("future", 31)],
        [bought("a", 17, value=4.0, synced=1), bought("b", 15, user_id=None, synced=1), bought("a", 18, synced=-2)],
    ]
    for kind, batches, build, schema in (
        ("impressions", imps, impressions, schemas.IMPRESSIONS), ("conversions", convs, conversions, schemas.CONVERSIONS),
    ):
        feed = Feed(spark, f"{folder}/{kind}", schema)
        for rows in batches:
            feed.add(build(spark, rows))
        counts.count_changes(
            feed.stream(), kind, f"{folder}/out", f"{folder}/state-{kind}", P, buckets=4
        ).awaitTermination()
    clicked = clicks(spark, [{"event_timestamp": at("2024-01-17 08:30:00"), "user_id": u} for u in ("u1", "u1", None)])
    feed = Feed(spark, f"{folder}/clicks", schemas.CLICKS)
    feed.add(clicked)
    counts.count_changes(feed.stream(), "clicks", f"{folder}/out", f"{folder}/state-clicks", P).awaitTermination()

    want = campaign_mart.campaign_metrics(
        staging.stage_impressions(impressions(spark, sum(imps, [])), P), clicked,
        staging.stage_conversions(conversions(spark, sum(convs, [])), P), level,
    )
    got = counts.streamed_mart(spark, f"{folder}/out", P, level).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_unknown_kind_of_counts(spark):
    with pytest.raises(ValueError, match="views"):
        counts.count_changes(spark.range(1), "views", "p", "c", P)


def test_a_batch_that_fails_its_checks_is_kept_apart(spark, folder, feed):
    feed.add(impressions(spark, [{"impression_cost": 1.0}]))
    feed.add(impressions(spark, [{"impression_cost": -1.0}, {"impression_cost": 1.0}]))
    feed.add(impressions(spark, [{"impression_cost": 2.0}]))
    run(feed.stream(), folder, checks=quality.write_checks(P, ["user_id"], {"impression_cost": (0.0, 100.0)}))
    assert sorted(r.impression_cost for r in spark.read.parquet(f"{folder}/out").collect()) == [1.0, 2.0]
    assert sorted(r.impression_cost for r in spark.read.parquet(f"{folder}/out-refused").collect()) == [-1.0, 1.0]


def test_late_rows_are_set_aside_and_counted_a_batch_later(spark, folder, feed):
    def shown(name, day, **more):
        return {"impression_id": name, "event_timestamp": at(f"2024-01-{day} 08:00:00"), **more}

    def counted():
        rows = counts.counts_table(spark, f"{folder}/out", "impressions").totals().collect()
        return {str(r.event_date)[-2:]: r.rows for r in rows}

    steps = [
        ([shown("a", 20), shown("b", 10)], {"20": 1, "10": 1}, 0),  # the first batch has nothing to be late for
        ([shown("c", 18), shown("d", 16), shown("b", 10, user_id="u9")], {"20": 1, "18": 1, "10": 1}, 2),
        ([shown("e", 21)], {"21": 1, "20": 1, "18": 1, "16": 1, "10": 1}, 2),
    ]
    for rows, want, late in steps:
        feed.add(impressions(spark, rows))
        counts.count_changes(
            feed.stream(), "impressions", f"{folder}/out", f"{folder}/state", P, buckets=4, set_late_aside=True
        ).awaitTermination()
        assert counted() == want
        assert counts.late_rows(spark, f"{folder}/out", "impressions").count() == late
