"""Metrics from written definitions."""

import copy

import pytest

from touchline.functions.definitions import DEFAULT, Definitions

BASE = "impressions long, clicks long, conversions long, spend double, revenue double, unique_users long"


@pytest.fixture
def mart(spark):
    return spark.createDataFrame([(1000, 20, 4, 50.0, 300.0, 400), (10, 0, 0, 0.0, 0.0, 0)], BASE)


def test_all_groups_with_divisions_by_nothing(spark, mart):
    rows = mart.selectExpr("*", "12.5D attributed_revenue", "impressions id")
    got = {(r.id, r.metric_group, r.metric): r.value for r in Definitions.from_config(DEFAULT).long(rows, ["id"]).collect()}
    assert len(got) == 2 * sum(map(len, DEFAULT["metric_groups"].values()))
    assert got[1000, "efficiency_metrics", "cpm"] == 50.0 and got[1000, "efficiency_metrics", "cpa"] == 12.5
    assert got[1000, "engagement_metrics", "ctr"] == 2.0 and got[1000, "engagement_metrics", "cvr"] == 20.0
    assert got[1000, "roi_metrics", "roas"] == 6.0 and got[1000, "attribution_metrics", "attributed_revenue"] == 12.5
    assert got[10, "engagement_metrics", "cvr"] == got[10, "efficiency_metrics", "cpc"] == 0.0


def test_formulas_over_formulas_come_in_order(mart):
    found = Definitions(
        {"margin": "roas - cost_share", "cost_share": "spend / revenue", "roas": "revenue / spend", "twice": "2 * margin"},
        frozenset({"spend", "revenue"}), {}, {},
    )
    order = found.order(["twice"])
    assert order.index("cost_share") < order.index("margin") < order.index("twice")
    assert found.add(mart, ["twice"]).first().twice == pytest.approx(2 * (6 - 1 / 6))


def test_cycles_unknown_names_and_missing_columns_are_refused(mart):
    cycle = Definitions({"a": "b + 1", "b": "a * 2"}, frozenset(), {}, {})
    with pytest.raises(ValueError, match="need each other"):
        cycle.add(mart, ["a"])
    found = Definitions.from_config(DEFAULT)
    with pytest.raises(KeyError, match="reach"):
        found.add(mart, ["reach"])
    with pytest.raises(ValueError, match="served_impressions"):
        found.add(mart, ["fill_rate"])
    with pytest.raises(ValueError, match="attributed_revenue"):
        found.of_group(mart, "attribution_metrics")
    for formula in ("clicks ** 2", "f(clicks)", "clicks; spend", "clicks if spend else 1"):
        with pytest.raises(ValueError, match="formula"):
            Definitions({"odd": formula}, frozenset(), {}, {}).add(mart, ["odd"])


def test_a_declared_order_that_the_formulas_contradict_is_refused():
    config = copy.deepcopy(DEFAULT)
    config["metrics"]["ctr"]["formula"] = "roas * clicks"
    with pytest.raises(ValueError, match="ctr is calculated before roas"):
        Definitions.from_config(config)
    config = copy.deepcopy(DEFAULT)
    config["metric_groups"]["odd"] = ["nothing"]
    with pytest.raises(ValueError, match="nothing"):
        Definitions.from_config(config)
