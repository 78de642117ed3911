import pytest
from builders import P

from touchline.functions.metrics import CAMPAIGN_RATIOS, add_metrics
from touchline.plans import optimizer

ROWS = [
    ("A", "Search", 10000.0, 400000, 16000, 1600, 80000.0),
    ("B", "Search", 9000.0, 300000, 9000, 900, 36000.0),
    ("C", "Display", 6000.0, 600000, 6000, 180, 9000.0),
    ("D", "Display", 3000.0, 200000, 3000, 60, 4500.0),
    ("E", "Video", 5000.0, 250000, 5000, 300, 24000.0),
    ("F", "Social", 2000.0, 150000, 2250, 0, 0.0),
]
SCHEMA = (
    "campaign_id string, channel string, spend double, impressions long, clicks long, conversions long, revenue double"
)


@pytest.fixture(scope="module")
def campaigns(spark):
    return add_metrics(spark.createDataFrame(ROWS, SCHEMA), CAMPAIGN_RATIOS)


def ids(frame):
    return sorted(r.campaign_id for r in frame.collect())


def test_tiers(campaigns):
    tiers = {r.campaign_id: r.tier for r in optimizer.performance_tiers(campaigns).collect()}
    assert tiers == {
        "A": "top_performers", "E": "top_performers", "B": "mid_performers", "C": "mid_performers",
        "D": "mid_performers", "F": "underperformers",
    }


def test_opportunities(campaigns):
    high = {r.campaign_id: r for r in optimizer.high_cpa(campaigns).collect()}
    assert sorted(high) == ["C", "D"]
    assert (high["C"].current_cpa, high["C"].median_cpa) == (33.33, 16.67)
    low = optimizer.low_ctr(campaigns).collect()
    assert [(r.campaign_id, r.current_ctr, r.median_ctr) for r in low] == [("C", 1.0, 2.0)]
    assert ids(optimizer.high_spend_low_roi(campaigns)) == ["C"]
    scaling = optimizer.scaling_candidates(campaigns).collect()
    # E is exactly 1.2 times the median, which is not above it.
    assert [(r.campaign_id, r.potential_10pct_increase_revenue) for r in scaling] == [("A", 8000.0)]
    winners = {r.channel: (r.avg_roas, r.num_campaigns) for r in optimizer.channel_winners(campaigns).collect()}
    assert winners == {"Search": (6.0, 2), "Display": (1.5, 2), "Video": (4.8, 1), "Social": (0.0, 1)}


def test_allocation(campaigns):
    scores = {r.campaign_id: r.score for r in optimizer.campaign_scores(campaigns, P).collect()}
    assert scores == pytest.approx({"A": 1.0, "B": 0.5875, "E": 0.4875, "D": 0.21375, "C": 0.19125, "F": 0.1125})
    rows = {r.campaign_id: r for r in optimizer.allocation_report(optimizer.budget_allocation(campaigns, P)).collect()}
    assert {k: r.recommended_budget for k, r in rows.items()} == {
        "A": 13500.48, "B": 7931.53, "E": 6581.49, "D": 2885.73, "C": 2581.97, "F": 1518.80,
    }
    assert {k: r.change_pct for k, r in rows.items()} == {
        "A": 35.0, "B": -11.9, "E": 31.6, "D": -3.8, "C": -57.0, "F": -24.1,
    }


def test_allocation_spends_the_budget(campaigns):
    for budget in (None, 1.0, 123456.0):
        rows = optimizer.budget_allocation(campaigns, P, budget).collect()
        assert sum(r.allocation for r in rows) == pytest.approx(budget or 35000.0)


def test_clamp(campaigns):
    rows = {r.campaign_id: r for r in optimizer.clamp_allocation(optimizer.budget_allocation(campaigns, P), P).collect()}
    assert rows["C"].clamped_allocation == 3000.0
    assert rows["C"].unallocated == pytest.approx(2581.97 - 3000.0, abs=0.01)
    assert rows["A"].clamped_allocation == rows["A"].allocation


def test_budget_by_tier(campaigns):
    rows = {r.campaign_id: r.allocation for r in optimizer.budget_by_tier(campaigns, 1000.0).collect()}
    assert rows == pytest.approx({"A": 250, "E": 250, "B": 100, "C": 100, "D": 100, "F": 200})
    top_only = optimizer.budget_by_tier(campaigns.where("campaign_id IN ('A', 'E')"), 1000.0).collect()
    assert sum(r.allocation for r in top_only) == pytest.approx(1000.0)


def test_projected_volume(campaigns):
    row = optimizer.projected_volume(campaigns).where("campaign_id = 'A'").first()
    assert row.projected_volume == pytest.approx(1600.0)


def test_top_campaigns(campaigns):
    assert [r.campaign_id for r in optimizer.top_campaigns(campaigns, 3).collect()] == ["A", "E", "B"]


def test_empty_and_all_zero_inputs(spark, campaigns):
    none = campaigns.where("false")
    assert optimizer.performance_tiers(none).count() == 0
    assert optimizer.low_ctr(none).count() == 0
    assert optimizer.budget_allocation(none, P).count() == 0
    zero = add_metrics(
        spark.createDataFrame([("Z", "Search", 0.0, 0, 0, 0, 0.0)], SCHEMA), CAMPAIGN_RATIOS
    )
    row = optimizer.budget_allocation(zero, P).first()
    assert (row.score, row.allocation, row.change) == (0.0, 0.0, None)


def test_many_campaigns_keep_their_tiers_apart(spark):
    rows = [(f"c{n:03d}", "Search", 100.0, 1000, 10, 1, float(n // 2)) for n in range(50)]
    tiered = optimizer.performance_tiers(add_metrics(spark.createDataFrame(rows, SCHEMA), CAMPAIGN_RATIOS))
    counts = {r.tier: r["count"] for r in tiered.groupBy("tier").count().collect()}
    assert counts == {"top_performers": 2, "mid_performers": 3, "underperformers": 45}


def test_campaign_without_channel_is_ranked_too(spark):
    rows = [("X", None, 10.0, 100, 10, 1, 1000.0), *ROWS]
    tiers = {
        r.campaign_id: r.tier
        for r in optimizer.performance_tiers(add_metrics(spark.createDataFrame(rows, SCHEMA), CAMPAIGN_RATIOS)).collect()
    }
    assert tiers["X"] == "top_performers" and len(tiers) == 7
