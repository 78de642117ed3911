"""Incremental runs against one full run on everything that has arrived."""

import os
import random
import shutil
from datetime import timedelta

import pytest
from builders import P, at, clicks, conversions, impressions

from touchline.operators import staging
from touchline.plans import attribution, campaign_mart
from touchline.plans.incremental import IncrementalTables
from touchline.sources import sinks

DAYS = P.with_(attribution_window_days=5, half_life_days=2.0)
MART = ["campaign_id", "campaign_name", "channel", "event_date", "impressions", "unique_users", "clicks", "conversions",
        "users_who_converted", "spend", "revenue"]
CREDIT = ["conversion_id", "user_id", "conversion_ts", "value", "channel", "campaign_id", "n_touches", "journey_touches",
          "last_touch", "first_touch", "linear"]


def tables(spark, folder):
    return IncrementalTables(spark, f"{folder}/tables", buckets=4)


def content(rows, columns):
    return sorted((tuple(r) for r in rows.select(*columns).collect()), key=repr)


def stored(t, name, columns):
    path = t.path(name)
    return content(t.spark.read.parquet(path), columns) if sinks.stored_dates(t.spark, path) else []


def assert_as_full_run(t, imps, clicks_, convs, p):
    staged_i = staging.stage_impressions(imps, p)
    staged_c = staging.stage_conversions(convs, p)
    assert stored(t, "mart_campaign_metrics", MART) == content(
        campaign_mart.campaign_metrics(staged_i, clicks_, staged_c), MART
    )
    assert stored(t, "credit_shares", CREDIT) == content(attribution.credit_shares(staged_c, staged_i, p), CREDIT)
    assert content(t.read_conversions(p), ["conversion_id", "conversion_value", "is_late_arrival"]) == content(
        staged_c, ["conversion_id", "conversion_value", "is_late_arrival"]
    )


def imp(n, day, synced=None, hour=8, **more):
    time = at(f"2024-01-{day:02d} {hour:02d}:00:00")
    return {"impression_id": n, "event_timestamp": time, "_synced_at": at(f"2024-01-{synced or day:02d} 20:00:00"), **more}


def conv(n, day, synced=None, hour=10, **more):
    time = at(f"2024-01-{day:02d} {hour:02d}:00:00")
    return {"conversion_id": n, "event_timestamp": time, "_synced_at": at(f"2024-01-{synced or day:02d} 20:00:00"), **more}


def run(t, spark, imps, convs, p, shown=()):
    """A run on what has been synced by as-of, as a warehouse would have it."""
    now = at(p.as_of)
    frames = (
        impressions(spark, [r for r in imps if r["_synced_at"] <= now]), clicks(spark, list(shown)),
        conversions(spark, [r for r in convs if r["_synced_at"] <= now]),
    )
    t.run(*frames, p)
    return frames


def test_corrections_moves_and_withdrawals(spark, folder):
    t = tables(spark, folder)
    imps = [imp(f"i{d}", d, user_id=f"u{d % 3}", channel="Search" if d % 2 else "Video") for d in range(5, 25)]
    convs = [conv(f"c{d}", d, user_id=f"u{d % 3}", conversion_value_usd=float(d)) for d in range(6, 25, 2)]
    imps += [
        imp("i6", 6, synced=26, user_id="u0", impression_cost=9.0),  # corrected cost
        imp("i10", 13, synced=26, user_id="u1"),  # moved to another day
        imp("i11", 11, synced=26, user_id=None),  # withdrawn
        imp("i12", 12, synced=26, user_id="u0", is_bot=True),  # found to be a bot
        imp("i7", 7, synced=3, user_id="u2", impression_cost=50.0),  # stale
        imp("late", 9, synced=28, user_id="u1", hour=3),
    ]
    convs += [
        conv("c8", 8, synced=26, user_id="u2", conversion_value_usd=1000.0), conv("c10", 14, synced=26, user_id="u1"),
        conv("c12", 12, synced=26, user_id=None), conv("c14", 14, synced=2, user_id="u9"),
        conv(None, 15, user_id="u0"), conv(None, 16, synced=27, user_id="u0", conversion_value_usd=7.0),
        conv("c16", 16, synced=28, user_id="u1", conversion_value=None, conversion_value_usd=None),
    ]
    for as_of in ("2024-01-25 00:00:00", "2024-01-27 00:00:00", "2024-01-31 00:00:00"):
        p = DAYS.with_(as_of=as_of)
        shown = [{"event_timestamp": at(f"2024-01-{d:02d} 09:00:00")} for d in range(20, 24)]
        frames = run(t, spark, imps, convs, p, shown)
        assert_as_full_run(t, *frames, p)
    # The same run once more, as after a failure before its log entry.
    shutil.rmtree(f"{t.path('log')}/run=2")
    frames = run(t, spark, imps, convs, p, shown)
    assert_as_full_run(t, *frames, p)
    assert t.last_run()["run"] == 2


def test_untouched_dates_are_not_read(spark, folder):
    t = tables(spark, folder)
    imps = [imp(f"i{d}", d) for d in range(1, 21)]
    convs = [conv(f"c{d}", d) for d in range(1, 21)]
    run(t, spark, imps, convs, DAYS.with_(as_of="2024-01-21 00:00:00"))
    # The first days become unreadable; the correction of the 18th reaches back to the 12th.
    for name in ("stg_impressions", "stg_conversions", "mart_campaign_metrics", "credit_shares"):
        for d in range(1, 11):
            for file in os.listdir(f"{t.path(name)}/event_date=2024-01-{d:02d}"):
                at_file = f"{t.path(name)}/event_date=2024-01-{d:02d}/{file}"
                if file.endswith(".parquet"):
                    with open(at_file, "w") as f:
                        f.write("not parquet")
                else:
                    os.remove(at_file)
    imps.append(imp("i18", 18, synced=21, impression_cost=70.0))
    convs.append(conv("c19", 19, synced=21, conversion_value_usd=1.0))
    run(t, spark, imps, convs, DAYS.with_(as_of="2024-01-22 00:00:00"))
    day = spark.read.parquet(f"{t.path('mart_campaign_metrics')}/event_date=2024-01-18").first()
    assert day.spend == 70.0
    credit = spark.read.parquet(f"{t.path('credit_shares')}/event_date=2024-01-19").first()
    assert (credit.value, credit.journey_touches) == (1.0, 5)


def test_future_conversions_wait_and_old_days_expire(spark, folder):
    t, p = tables(spark, folder), DAYS.with_(retention_days=20)
    imps = [imp(f"i{d}", d) for d in range(1, 29)]
    convs = [conv(f"c{d}", d) for d in range(1, 20)] + [conv("future", 25, synced=20)]
    run(t, spark, imps, convs, p.with_(as_of="2024-01-21 00:00:00"))
    assert "future" not in {r[0] for r in stored(t, "credit_shares", CREDIT)}
    p = p.with_(as_of="2024-01-29 00:00:00")
    run(t, spark, imps, convs, p)
    (future,) = [r for r in stored(t, "credit_shares", CREDIT) if r[0] == "future"]
    assert future[3] == 100.0 and future[7] == 5
    # The 9th is the first day of the retained range; the mart follows, stored credit stays.
    assert min(sinks.stored_dates(spark, t.path("stg_impressions"))) == "2024-01-09"
    assert min(sinks.stored_dates(spark, t.path("mart_campaign_metrics"))) == "2024-01-09"
    assert min(sinks.stored_dates(spark, t.path("credit_shares"))) == "2024-01-01"


@pytest.mark.parametrize("seed", [1])
def test_random_histories(spark, folder, seed):
    rng, t = random.Random(seed), tables(spark, folder)
    start = at("2024-01-02 00:00:00")
    imps, convs = [], []
    for _ in range(150):
        time = start + timedelta(hours=rng.randint(0, 27 * 24))
        row = {"user_id": rng.choice(["u1", "u2", "u3", None]), "event_timestamp": time,
               "campaign_id": rng.choice(["a", "b"]), "_synced_at": time + timedelta(hours=rng.randint(0, 150))}
        imps.append({**row, "impression_id": f"i{rng.randint(0, 70)}", "impression_cost": float(rng.randint(0, 3))})
        convs.append({**row, "conversion_id": f"c{rng.randint(0, 70)}", "conversion_value_usd": float(rng.randint(0, 9))})
    for as_of in ("2024-01-12 00:00:00", "2024-01-20 07:00:00", "2024-02-08 00:00:00"):
        p = DAYS.with_(as_of=as_of)
        frames = run(t, spark, imps, convs, p)
        assert_as_full_run(t, *frames, p)


def test_nothing_at_all(spark, folder):
    t = tables(spark, folder)
    for as_of in ("2024-01-12 00:00:00", "2024-01-13 00:00:00"):
        run(t, spark, [], [], DAYS.with_(as_of=as_of))
    assert stored(t, "mart_campaign_metrics", MART) == stored(t, "credit_shares", CREDIT) == []
