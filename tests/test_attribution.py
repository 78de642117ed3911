import random
import re
from datetime import timedelta

import pytest
from builders import P, at, conversions, impressions, window_brute_force
from pyspark.sql import functions as F

from touchline.operators import timeline
from touchline.params import MODELS, Params
from touchline.plans import attribution, comparison, journeys

MULTI = [
    ("2024-01-20 08:00:00", "Display", "DSP_Awareness"),
    ("2024-01-21 14:30:00", "Search", "SEM_Q1"),
    ("2024-01-22 18:15:00", "Search", "SEM_Q1"),
]
ONE = [("2024-01-20 08:00:00", "Search", "SEM_Q1")]
OLD = [("2024-01-01 08:00:00", "Display", "DSP_Awareness"), *ONE]
# case: (value, conversion time, touches, expected credit per model by channel)
CASES = {
    "single": (100.0, "2024-01-20 10:00:00", ONE, {m: {"Search": 100.0} for m in MODELS}),
    "multi": (100.0, "2024-01-23 10:00:00", MULTI, {
        "last_touch": {"Search": 100.0}, "first_touch": {"Display": 100.0},
        "linear": {"Display": 33.333333, "Search": 66.666667},
        "time_decay": {"Display": 29.361923, "Search": 70.638077},
    }),
    "none": (100.0, "2024-01-20 10:00:00", [], {m: {} for m in MODELS}),
    "zero": (0.0, "2024-01-20 10:00:00", ONE, {m: {"Search": 0.0} for m in MODELS}),
    "large": (999999.99, "2024-01-20 10:00:00", ONE, {m: {"Search": 999999.99} for m in MODELS}),
    "old": (100.0, "2024-01-20 10:00:00", OLD, {
        "last_touch": {"Search": 100.0}, "first_touch": {"Display": 100.0},
        "linear": {"Display": 50.0, "Search": 50.0},
        "time_decay": {"Display": 13.222821, "Search": 86.777179},
    }),
}


@pytest.fixture(scope="module")
def cases(spark):
    """Every case as its own user and conversion."""
    convs = conversions(spark, [
        {"conversion_id": name, "user_id": name, "event_timestamp": at(time),
         "conversion_value": value, "conversion_value_usd": value}
        for name, (value, time, _, _) in CASES.items()
    ])
    imps = impressions(spark, [
        {"user_id": name, "event_timestamp": at(t), "channel": ch, "campaign_id": ca}
        for name, (_, _, touches, _) in CASES.items() for t, ch, ca in touches
    ])
    return convs, imps


def credit_table(convs, imps, p=P, unattributed=False):
    shares = attribution.credit_shares(convs, imps, p, unattributed)
    got = {}
    for r in attribution.credits(shares, p.models).collect():
        got.setdefault((r.conversion_id, r.attribution_model), {})[r.channel, r.campaign_id] = r.credit
    return got


def test_fixture_credits(cases):
    got = credit_table(*cases)
    for name, (_, _, _, expected) in CASES.items():
        for model, channels in expected.items():
            credits = {}
            for (channel, _), credit in got.get((name, model), {}).items():
                credits[channel] = credits.get(channel, 0.0) + credit
            assert credits == pytest.approx(channels, abs=1e-6), (name, model)


def test_every_model_keeps_the_revenue(cases):
    shares = attribution.credit_shares(*cases, P, unattributed=True)
    for row in attribution.revenue_conservation(cases[0], shares, P).collect():
        assert row.violations == 0
        assert row.conversions == len(CASES)
        assert row.credited == pytest.approx(row.value)


def test_untouched_conversion_keeps_a_null_bucket_on_request(cases):
    got = credit_table(*cases, unattributed=True)
    for model in MODELS:
        assert got["none", model] == {(None, None): 100.0}
    assert ("none", "linear") not in credit_table(*cases, unattributed=False)


def test_edge_touch_agrees_with_shares(cases):
    for model in ("last_touch", "first_touch"):
        edge = attribution.edge_touch_credit(*cases, P, model).collect()
        assert len(edge) == len(CASES)
        got = credit_table(*cases, unattributed=True)
        for r in edge:
            assert {(r.channel, r.campaign_id): r.credit} == got[r.conversion_id, model]


def test_window_ends_are_inclusive(spark):
    end = at("2024-01-30 12:00:00")
    start = end - timedelta(days=28)
    micro = timedelta(microseconds=1)
    imps = impressions(spark, [
        {"event_timestamp": t, "campaign_id": c} for t, c in [
            (start - micro, "before"), (start, "start"), (end, "end"), (end + micro, "after"),
        ]
    ])
    got = credit_table(conversions(spark, [{"event_timestamp": end}]), imps)
    assert set(got["c000000", "linear"]) == {("Search", "start"), ("Search", "end")}
    assert got["c000000", "first_touch"] == {("Search", "start"): 100.0}
    assert got["c000000", "last_touch"] == {("Search", "end"): 100.0}


def random_history(seed, users=4, touches=150, convs=60, span_days=100):
    rng = random.Random(seed)
    begin = at("2023-11-01 00:00:00")
    # Few distinct times, so touches tie with each other and with conversions.
    time = lambda: begin + timedelta(hours=6 * rng.randrange(span_days * 4))
    hot = lambda: "hot" if rng.random() < 0.5 else f"u{rng.randrange(users)}"
    t = [
        (f"i{n:06d}", hot(), time(), rng.choice(["Search", "Video", None]), f"c{rng.randrange(4)}")
        for n in range(touches)
    ]
    c = [(f"v{n}", hot(), time(), round(rng.uniform(0, 200), 2)) for n in range(convs)]
    return c, t


def as_frames(spark, c, t):
    convs = conversions(spark, [
        {"conversion_id": i, "user_id": u, "event_timestamp": w, "conversion_value_usd": v} for i, u, w, v in c
    ])
    imps = impressions(spark, [
        {"impression_id": i, "user_id": u, "event_timestamp": w, "channel": ch, "campaign_id": ca}
        for i, u, w, ch, ca in t
    ])
    return convs, imps


@pytest.mark.parametrize("seed,window,half_life,tile", [
    (1, 28, 7.0, 60), (2, 28, 7.0, 7 * 24 * 60), (3, 3, 0.5, 1), (4, 28, 0.05, 60),
])
def test_random_histories_match_pairing(spark, seed, window, half_life, tile):
    c, t = random_history(seed)
    p = P.with_(attribution_window_days=window, half_life_days=half_life, tile_minutes=tile)
    expected = window_brute_force(c, t, window, half_life)
    got = credit_table(*as_frames(spark, c, t), p)
    for key, shares in expected.items():
        assert got.get(key, {}) == pytest.approx(shares, rel=1e-9, abs=1e-9), key


def test_short_half_life_still_credits_old_touches(spark):
    """Weights far below the smallest double relative to now, but not to each other."""
    end = at("2024-01-30 00:00:00")
    imps = impressions(spark, [
        {"event_timestamp": end - timedelta(days=27), "campaign_id": "a"},
        {"event_timestamp": end - timedelta(days=27, hours=1), "campaign_id": "b"},
    ])
    got = credit_table(
        conversions(spark, [{"event_timestamp": end}]), imps, P.with_(half_life_days=1 / 24 * 1.0)
    )["c000000", "time_decay"]
    assert got == pytest.approx({("Search", "a"): 200 / 3, ("Search", "b"): 100 / 3})


def test_half_life_must_be_positive_and_not_absurd():
    for half_life in (0.0, -1.0, 0.001):
        with pytest.raises(ValueError):
            Params(as_of="2024-01-31", half_life_days=half_life)


def test_minimum_touches(spark, cases):
    p = P.with_(min_touches=2)
    got = credit_table(*cases, p)
    assert {c for c, _ in got} == {"multi", "old"}
    # The others keep their value, without a key, in all models.
    convs, imps = cases
    shares = attribution.credit_shares(convs, imps, p, unattributed=True)
    rows = shares.where("conversion_id not in ('multi', 'old')").collect()
    assert {(r.channel, r.campaign_id, r.n_touches, r.journey_touches) for r in rows} == {(None, None, 0, 0)}
    assert all(r.last_touch == r.first_touch == r.linear == r.time_decay == r.value for r in rows)
    assert len(rows) == convs.count() - 2
    for row in attribution.revenue_conservation(convs, shares, p).collect():
        assert row.violations == 0 and row.credited == row.value
    for model in ("last_touch", "first_touch"):
        edge = {r.conversion_id: r for r in attribution.edge_touch_credit(convs, imps, p, model).collect()}
        assert {c for c, r in edge.items() if r.channel} == {"multi", "old"}
        assert edge["single"].journey_touches == 0 and edge["single"].credit == 100.0


def test_lost_conversions_break_conservation(spark, cases):
    convs, imps = cases
    shares = attribution.credit_shares(convs, imps, P).where("conversion_id <> 'single'")
    for row in attribution.revenue_conservation(convs, shares, P).collect():
        assert row.violations == 1 and row.value - row.credited == pytest.approx(100.0)


def test_record_without_an_id_is_credited_like_others(spark):
    convs = conversions(spark, [{"conversion_id": None, "conversion_value_usd": 5.0}, {}])
    got = credit_table(convs, impressions(spark, [{"campaign_id": "a"}, {"campaign_id": "b"}]))
    assert got[None, "linear"] == {("Search", "a"): 2.5, ("Search", "b"): 2.5}
    assert got[None, "last_touch"] == {("Search", "b"): 5.0}
    shares = attribution.credit_shares(convs, impressions(spark, [{}]), P)
    rows = attribution.attribution_summary(attribution.credits(shares, ["linear"])).collect()
    assert [(r.attributed_conversions, r.attributed_revenue) for r in rows] == [(1, 105.0)]


def test_null_value_counts_but_adds_nothing(spark):
    convs = conversions(spark, [{"conversion_value_usd": None}, {"conversion_value_usd": 10.0}])
    imps = impressions(spark, [{}])
    shares = attribution.credit_shares(convs, imps, P, unattributed=True)
    rows = attribution.attribution_summary(attribution.credits(shares, MODELS)).collect()
    assert len(rows) == len(MODELS)
    for r in rows:
        assert (r.attributed_conversions, r.attributed_users) == (2, 1)
        assert (r.attributed_revenue, r.avg_order_value, r.median_order_value) == (10.0, 10.0, 10.0)


def test_summary_statistics_match_python(spark):
    c, t = random_history(7)
    convs, imps = as_frames(spark, c, t)
    shares = attribution.credit_shares(convs, imps, P, unattributed=False)
    expected = {}
    users = {i: u for i, u, _, _ in c}
    for (conversion, model), parts in window_brute_force(c, t).items():
        for key, credit in parts.items():
            expected.setdefault((model, *key), []).append((users[conversion], credit))
    rows = attribution.attribution_summary(attribution.credits(shares, MODELS)).collect()
    assert len(rows) == len(expected)
    for r in rows:
        entries = expected[r.attribution_model, r.channel, r.campaign_id]
        values = sorted(v for _, v in entries)
        n = len(values)
        median = (values[(n - 1) // 2] + values[n // 2]) / 2
        assert r.attributed_conversions == n
        assert r.attributed_users == len({u for u, _ in entries})
        assert r.attributed_revenue == pytest.approx(sum(values))
        assert r.avg_order_value == pytest.approx(sum(values) / n)
        assert r.median_order_value == pytest.approx(median)


def test_breakdowns_add_up(spark):
    convs, imps = as_frames(spark, *random_history(8))
    shares = attribution.credit_shares(convs, imps, P, unattributed=False)
    rows = attribution.credit_breakdowns(shares, MODELS).groupBy("attribution_model").pivot(
        "breakdown", ["channel", "campaign", "total"]
    ).agg(F.sum("credit")).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.channel == pytest.approx(r.total)
        assert r.campaign == pytest.approx(r.total)


def test_comparison_of_models(cases):
    shares = attribution.credit_shares(*cases, P, unattributed=False)
    top = {r.attribution_model: r for r in comparison.model_comparison(shares, MODELS).collect()}
    assert all(r.top_channel == "Search" for r in top.values())
    assert all(r.total_revenue == pytest.approx(1000299.99) for r in top.values())
    consensus = {r.channel: r.appears_in_top_2 for r in comparison.channel_consensus(shares, MODELS).collect()}
    # Last touch gives Display nothing, so it is in the top two of three models.
    assert consensus == {"Search": 4, "Display": 3}
    spread = {r.channel: r for r in comparison.channel_divergence(shares, MODELS).collect()}
    credits = [0.0, 200.0, 33.333333 + 50.0, 29.361923 + 13.222821]
    mean = sum(credits) / 4
    assert spread["Display"].mean_credit == pytest.approx(mean, abs=0.01)
    assert spread["Display"].std_dev == pytest.approx((sum((x - mean) ** 2 for x in credits) / 4) ** 0.5, abs=0.01)
    assert (spread["Display"].min_credit, spread["Display"].max_credit) == (0.0, 200.0)


@pytest.mark.parametrize("page_size", [1, 3, 1000])
def test_journey_pages_hold_the_whole_journey(spark, page_size):
    c, t = random_history(9)
    convs, imps = as_frames(spark, c, t)
    pages = {}
    for r in journeys.journeys(convs, imps, P, page_size).collect():
        assert len(r.touches) <= page_size
        pages.setdefault(r.conversion_id, {})[r.page] = [x.impression_id for x in r.touches]
    ranges = {r.conversion_id: r.n_touches for r in journeys.journey_ranges(convs, imps, P).collect()}
    for cid, user, time, _ in c:
        want = [
            x[0] for x in sorted(t, key=lambda x: (x[2], x[0]))
            if x[1] == user and time - timedelta(days=28) <= x[2] <= time
        ]
        got = [i for _, page in sorted(pages[cid].items()) for i in page]
        assert got == want
        assert ranges[cid] == len(want)


def test_interval_join_keeps_unmatched(cases):
    rows = journeys.journey_touches(*cases, P).collect()
    per = {}
    for r in rows:
        per.setdefault(r.conversion_id, []).append(r.impression_id)
    assert {k: len(v) for k, v in per.items()} == {
        "single": 1, "multi": 3, "none": 1, "zero": 1, "large": 1, "old": 2,
    }
    assert per["none"] == [None]


def test_attribution_roas(spark, cases):
    shares = attribution.credit_shares(*cases, P, unattributed=False)
    rows = {
        (r.attribution_model, r.channel): r for r in attribution.attribution_roas(shares, cases[1], P).collect()
    }
    # Display was shown twice at a cost of 1 and never last.
    assert rows["last_touch", "Display"].attributed_roas == 0.0
    assert rows["first_touch", "Display"].attributed_roas == pytest.approx(100.0)


def test_user_with_most_of_the_data(spark):
    """Half a billion pairs if joined; counts and credit sums are checked by bisection."""
    from bisect import bisect_left, bisect_right

    from pyspark.sql import Window as W

    n_touches, n_convs = 40_000, 20_000
    begin = int(at("2023-11-05 00:00:00").timestamp())
    span = 80 * 86400
    when = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(span)) + begin
    imps = spark.range(n_touches).select(
        F.concat(F.lit("i"), F.col("id")).alias("impression_id"), F.lit("hot").alias("user_id"),
        F.concat(F.lit("ch"), F.col("id") % 2).alias("channel"),
        F.concat(F.lit("ca"), F.col("id") % 5).alias("campaign_id"),
        F.timestamp_seconds(when(1)).alias("event_timestamp"),
    )
    convs = spark.range(n_convs).select(
        F.concat(F.lit("c"), F.col("id")).alias("conversion_id"), F.lit("hot").alias("user_id"),
        F.timestamp_seconds(when(2)).alias("event_timestamp"), F.lit(1.0).alias("conversion_value_usd"),
    )
    shares = attribution.credit_shares(convs, imps, P, unattributed=False)
    rows = shares.withColumn("one", F.row_number().over(W.partitionBy("conversion_id").orderBy("campaign_id"))).agg(
        F.sum("n_touches").alias("pairs"), F.sum("linear").alias("linear"), F.sum("time_decay").alias("decay"),
        F.count_if("is_last").alias("last"), F.count_if(F.col("one") == 1).alias("touched"),
    ).first()
    touch_times = sorted(r[0] for r in imps.select(F.unix_seconds("event_timestamp")).collect())
    conv_times = [r[0] for r in convs.select(F.unix_seconds("event_timestamp")).collect()]
    window = P.attribution_window_days * 86400
    counts = [bisect_right(touch_times, t) - bisect_left(touch_times, t - window) for t in conv_times]
    touched = sum(c > 0 for c in counts)
    assert rows.pairs == sum(counts) > 100_000_000
    assert rows.last == rows.touched == touched
    assert rows.linear == pytest.approx(touched)
    assert rows.decay == pytest.approx(touched)


def by_key(rows, models):
    return {
        (r.attribution_model, r.channel, r.campaign_id): r.credit
        for r in attribution.credit_by(rows, ["channel", "campaign_id"], models).collect()
    }


@pytest.mark.parametrize("seed, changes", [
    (1, {}), (2, {"attribution_window_days": 3, "half_life_days": 0.5, "tile_minutes": 720}),
    (3, {"min_touches": 3, "attribution_window_days": 9}),
])
@pytest.mark.parametrize("unattributed", [True, False])
def test_totals_are_the_sums_of_shares(spark, seed, changes, unattributed):
    c, t = random_history(seed)
    convs = conversions(spark, [
        {"conversion_id": i, "user_id": u, "event_timestamp": w, "conversion_value_usd": None if n == 5 else v}
        for n, (i, u, w, v) in enumerate(c)
    ])
    imps = impressions(spark, [
        {"impression_id": i, "user_id": u, "event_timestamp": w, "channel": ch, "campaign_id": ca} for i, u, w, ch, ca in t
    ])
    p = P.with_(**changes)
    got = by_key(attribution.credit_totals(convs, imps, p, unattributed), p.models)
    want = by_key(attribution.credit_shares(convs, imps, p, unattributed), p.models)
    assert set(got) == set(want)
    assert got == pytest.approx(want, abs=1e-6)


def test_totals_without_anything(spark):
    nothing = attribution.credit_totals(conversions(spark, []), impressions(spark, []), P)
    assert attribution.credit_by(nothing, ["channel"], P.models).collect() == []


def test_summary_of_shares_equals_the_summary_of_credits(spark):
    c, t = random_history(7)
    convs = conversions(spark, [
        {"conversion_id": None if n == 3 else i, "user_id": u, "event_timestamp": w, "conversion_value_usd": None if n < 3 else v}
        for n, (i, u, w, v) in enumerate(c)
    ])
    imps = impressions(spark, [
        {"impression_id": i, "user_id": u, "event_timestamp": w, "channel": ch, "campaign_id": ca} for i, u, w, ch, ca in t
    ])
    shares = attribution.credit_shares(convs, imps, P, unattributed=True)
    key = ["attribution_model", "channel", "campaign_id"]
    wide = {tuple(r[k] for k in key): r for r in attribution.summary_of_shares(shares, P.models).collect()}
    long = {tuple(r[k] for k in key): r for r in attribution.attribution_summary(attribution.credits(shares, P.models)).collect()}
    assert set(wide) == set(long)
    for k, row in long.items():
        assert tuple(wide[k]) == pytest.approx(tuple(row), nan_ok=True) or wide[k].asDict() == pytest.approx(row.asDict())


def hot_hour(spark, n=3000):
    """One user with half of all touches inside one hour, the rest spread over other users and days."""
    rng, start = random.Random(3), at("2024-01-20 10:00:00")
    t = [(f"i{k}", "hot", start + timedelta(microseconds=rng.randrange(3_600_000_000)), "Search", "c0") for k in range(n)]
    t += [(f"j{k}", f"u{k % 50}", start - timedelta(hours=rng.randrange(600)), "Video", "c1") for k in range(n)]
    c = [(f"v{k}", "hot", start + timedelta(minutes=rng.randrange(120)), 5.0) for k in range(40)]
    c += [(f"w{k}", f"u{k}", start, 7.0) for k in range(10)]
    return (
        conversions(spark, [{"conversion_id": i, "user_id": u, "event_timestamp": w, "conversion_value_usd": v} for i, u, w, v in c]),
        impressions(spark, [
            {"impression_id": i, "user_id": u, "event_timestamp": w, "channel": ch, "campaign_id": ca} for i, u, w, ch, ca in t
        ]),
    )


def test_a_hot_hour_is_cut_into_even_parts(spark):
    convs, imps = hot_hour(spark)
    rows = imps.select("user_id", F.lit(1).alias("side"), F.unix_micros("event_timestamp").alias("position")).withColumn(
        "tile", F.floor(F.col("position") / 3_600_000_000)
    )
    cut = timeline.cut_hot_tiles(rows, rows, P.with_(hot_tile_rows=100))
    assert cut.count() == rows.count()
    largest = cut.groupBy("user_id", "tile").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * rows.count() / (2 * timeline.CUTS)
    order = cut.where("user_id = 'hot'").orderBy("position").select("tile").collect()
    assert order == sorted(order)
    assert timeline.cut_hot_tiles(rows, rows, P) is rows


def test_cut_tiles_change_no_result(spark):
    convs, imps = hot_hour(spark, 400)
    cut = P.with_(hot_tile_rows=20)
    assert credit_table(convs, imps, cut) == credit_table(convs, imps, P)
    assert by_key(attribution.credit_totals(convs, imps, cut), MODELS) == pytest.approx(
        by_key(attribution.credit_totals(convs, imps, P), MODELS)
    )
    ranges = [sorted(map(tuple, journeys.journey_ranges(convs, imps, p).collect())) for p in (P, cut)]
    assert ranges[0] == ranges[1]


def test_touches_of_one_instant_are_added_up_first(spark):
    """Half of all touches are one user's at one microsecond; where tiles are cut they are one row per key."""
    rng, moment = random.Random(3), at("2024-01-20 00:00:00")
    touches = [
        {"user_id": "hot" if n % 2 else f"u{n % 7}", "channel": rng.choice(["Search", "Video", None]), "campaign_id": "c",
         "impression_id": None if n % 50 == 0 else f"i{rng.randrange(10 ** 9):09d}",
         "event_timestamp": moment if n % 2 else moment + timedelta(hours=rng.randrange(200))}
        for n in range(1200)
    ]
    buys = [
        {"user_id": u, "event_timestamp": moment + timedelta(hours=h), "conversion_value_usd": 10.0 + h}
        for u in ("hot", "u0", "u2") for h in (-1, 0, 5, 24 * 28, 24 * 28 + 1)
    ]
    imps, convs = impressions(spark, touches), conversions(spark, buys)
    cut = P.with_(hot_tile_rows=5)
    got, want = credit_table(convs, imps, cut, True), credit_table(convs, imps, P, True)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])
    edges = [
        sorted(map(tuple, attribution.edge_touch_credit(convs, imps, p, model).collect()))
        for model in ("last_touch", "first_touch") for p in (P, cut)
    ]
    assert edges[0] == edges[1] and edges[2] == edges[3]

    events = attribution.credited_conversions(convs)
    line = timeline._line(
        timeline.place_windows(events, cut), timeline.place_touches(attribution.touch_columns(imps), cut),
        ["channel", "campaign_id"], [], merged=True,
    )
    per_instant = line.where("is_probe = 0 and user_id = 'hot'").groupBy("side", "channel", "position").count()
    assert per_instant.agg(F.max("count")).first()[0] == 1
    assert line.where("is_probe = 0 and user_id = 'hot' and side = 1").agg(F.sum("_n")).first()[0] == 600


def test_hot_tiles_are_spread_without_broadcasts_by_size(spark):
    """The shuffle that the totals run in: no task has more than a few times the mean."""
    convs, imps = hot_hour(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = {}
        for name, p in (("whole", P), ("cut", P.with_(hot_tile_rows=100))):
            line = timeline.cut_hot_tiles(*[imps.select(
                "user_id", F.lit(1).alias("side"), F.unix_micros("event_timestamp").alias("position")
            ).withColumn("tile", F.floor(F.col("position") / 3_600_000_000))] * 2, p)
            dealt = line.repartition(16, "user_id", "side", "tile").groupBy(F.spark_partition_id()).count()
            sizes[name] = max(r["count"] for r in dealt.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sizes["whole"] >= 3000 and sizes["cut"] <= 3 * 6000 / 16


@pytest.fixture(scope="module")
def busy(spark):
    """Conversions and touches of a few users, some busy, over three months."""
    source = random.Random(11)

    def moment():
        return at("2024-01-01 00:00:00") + timedelta(minutes=source.randrange(90 * 24 * 60))

    touches = [
        {"user_id": f"u{min(source.randrange(6), source.randrange(6))}", "event_timestamp": moment(),
         "channel": source.choice(["Search", "Video"]), "campaign_id": source.choice(["a", "b", "c"])}
        for _ in range(400)
    ]
    convs = [{"user_id": f"u{source.randrange(6)}", "event_timestamp": moment()} for _ in range(150)]
    return conversions(spark, convs), impressions(spark, touches)


def final_plan(rows):
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_totals_through_whole_blocks_equal_those_through_tiles(busy, monkeypatch):
    found = []
    for few in (0, 40, 50_000):
        monkeypatch.setattr(timeline, "FEW", few)
        shares = attribution.credit_shares(*busy, P).collect()
        found.append(sorted(
            str([round(v, 6) if isinstance(v, float) else v for v in row]) for row in shares
        ))
    assert len(found[0]) > 150 and found[0] == found[1] == found[2]


def test_blocks_of_few_rows_are_not_cut_in_tiles(busy, monkeypatch):
    tiles = r"hashpartitioning\([^)]*tile"
    assert not re.search(tiles, final_plan(attribution.credit_shares(*busy, P)))
    monkeypatch.setattr(timeline, "FEW", 0)
    assert re.search(tiles, final_plan(attribution.credit_shares(*busy, P)))


def test_totals_of_shares_stand_in_for_shares(busy):
    shares = attribution.credit_shares(*busy, P).where("journey_touches > 0").cache()
    totals = attribution.totals_of_shares(shares)
    for report in (attribution.credit_breakdowns, comparison.model_comparison, comparison.channel_consensus,
                   comparison.channel_divergence):
        assert sorted(map(str, report(totals, MODELS).collect())) == sorted(map(str, report(shares, MODELS).collect()))
    shares.unpersist()
