"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
import check
from touchline.catalog.oracle import ORACLE
from touchline.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
STREAMS = [n for n in QUERIES if n.startswith("stream_")]


@pytest.fixture(scope="module")
def duck():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert check.compare(spark, duck, FOLDER, name) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0
    assert "roas" in frame.columns


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS and not n.startswith("sink_")])
def test_plan_has_no_cross_join_or_python(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "percentile"):
        assert operator not in plan


def test_scan_reads_only_what_is_needed(spark):
    plan = entry.queries()["fill_rate_requests"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,props:string>" in plan


def test_deduplication_limits_rows_before_the_shuffle(spark):
    plan = entry.queries()["dedup_latest"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_time_line_is_shuffled_by_tile_whatever_the_join(spark):
    """A join that leaves rows partitioned by user must not decide where tiles go."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["attr_linear"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line and "tile#" in line]
    assert len(shuffles) == 2
    assert all("user_id" in line and "channel" in line and "campaign_id" in line for line in shuffles)
