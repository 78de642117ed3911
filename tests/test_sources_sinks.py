import json
import os

import pytest
from builders import P, at, clicks, conversions, impressions
from pyspark.sql import functions as F

from touchline.plans import campaign_mart, quality
from touchline.session import shared_dir
from touchline.sources import documents, readers, schemas, sinks


def test_csv_header_in_any_order(spark, folder):
    path = f"{folder}/conversions.csv"
    with open(path, "w") as f:
        f.write(
            "user_id,conversion_id,campaign_id,order_id,event_timestamp,conversion_value,conversion_value_usd,"
            "conversion_type,advertiser_id,country,device_type\n"
            "u9,c1,camp,o1,2024-01-17 08:30:00,49.99,,purchase,adv,US,desktop\n"
        )
    row = readers.read_csv(spark, path, schemas.CONVERSIONS).first()
    assert (row.conversion_id, row.user_id, row.conversion_value, row.conversion_value_usd) == ("c1", "u9", 49.99, None)
    assert row._synced_at == row.event_timestamp == at("2024-01-17 08:30:00")
    assert row._source_relation is None


def test_missing_required_column_fails(spark):
    rows = spark.createDataFrame([("c1",)], "conversion_id string")
    with pytest.raises(ValueError, match="user_id"):
        readers.conform(rows, schemas.CONVERSIONS)


@pytest.mark.parametrize("format", ["parquet", "orc", "json"])
def test_file_formats(spark, folder, format):
    raw = impressions(spark, [{}, {"impression_cost": None, "is_bot": None}])
    raw.write.format(format).save(f"{folder}/{format}")
    back = readers.read_files(spark, f"{folder}/{format}", schemas.IMPRESSIONS, format)
    assert back.schema == schemas.IMPRESSIONS
    assert sorted(back.collect(), key=str) == sorted(raw.collect(), key=str)


def test_catalog_table(spark):
    clicks(spark, [{}, {}]).write.mode("overwrite").saveAsTable("raw_clicks")
    assert readers.read_table(spark, "raw_clicks", schemas.CLICKS).count() == 2


def test_malformed_rows_are_split_off(spark, folder):
    path = f"{folder}/clicks.csv"
    with open(path, "w") as f:
        f.write("click_id,campaign_id,user_id,event_timestamp\nk1,c,u,2024-01-17 08:30:00\nk2,c,u,yesterday\nk3,c,u,\n")
    clean, bad = readers.split_malformed(readers.read_csv_text(spark, path), schemas.CLICKS)
    assert sorted(r.click_id for r in clean.collect()) == ["k1", "k3"]
    assert [(r.click_id, r._bad_columns) for r in bad.collect()] == [("k2", ["event_timestamp"])]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        readers.read_csv(spark, path, schemas.CLICKS).collect()


def daily_mart(spark, cost, days=range(20, 31)):
    imps = impressions(spark, [
        {"event_timestamp": at(f"2024-01-{d} 08:00:00"), "impression_cost": cost} for d in days
    ])
    return campaign_mart.campaign_metrics(imps, clicks(spark, []), conversions(spark, []))


def test_refresh_replaces_recent_days_only_and_repeats(spark, folder):
    path = f"{folder}/mart"
    sinks.write_by_date(daily_mart(spark, 1.0), path)
    assert len([d for d in os.listdir(path) if d.startswith("event_date=")]) == 11
    for _ in range(2):
        sinks.refresh_by_date(daily_mart(spark, 2.0), path, P)
    spend = {str(r.event_date): r.spend for r in spark.read.parquet(path).collect()}
    # One day plus three days for late records before the as-of day.
    assert spend == {f"2024-01-{d}": (2.0 if d >= 27 else 1.0) for d in range(20, 31)}


def dates_of(rows):
    return {str(r.event_date): r.spend for r in rows.collect()}


def test_refresh_drops_days_that_vanished_and_days_past_retention(spark, folder):
    path = f"{folder}/mart"
    sinks.replace_dates(daily_mart(spark, 1.0), path)
    sinks.refresh_by_date(daily_mart(spark, 2.0, [d for d in range(20, 31) if d != 29]), path, P)
    stored = dates_of(spark.read.parquet(path))
    assert stored == {f"2024-01-{d}": (2.0 if d >= 27 else 1.0) for d in range(20, 31) if d != 29}
    # A record corrected from the 20th to the 21st is under one day only.
    sinks.replace_dates(daily_mart(spark, 3.0, [21]), path)
    assert dates_of(spark.read.parquet(path)) == {"2024-01-21": 3.0}
    sinks.refresh_by_date(daily_mart(spark, 1.0, []), path, P.with_(as_of="2024-06-01 00:00:00"))
    assert sinks.stored_dates(spark, path) == {}


def test_catalog_table_keeps_its_history(spark):
    sinks.save_by_date(daily_mart(spark, 1.0), "mart_history")
    start = F.to_date(F.lit("2024-01-28"))
    sinks.save_by_date(daily_mart(spark, 2.0, [28, 30]), "mart_history", start)
    want = {f"2024-01-{d}": 1.0 for d in range(20, 28)} | {"2024-01-28": 2.0, "2024-01-30": 2.0}
    assert dates_of(spark.table("mart_history")) == want


def test_catalog_table_keeps_its_history_under_the_default_overwrite_mode(spark):
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "STATIC")
    try:
        sinks.save_by_date(daily_mart(spark, 1.0, [20, 21, 22]), "mart_static")
        sinks.save_by_date(daily_mart(spark, 2.0, [22]), "mart_static", F.to_date(F.lit("2024-01-22")))
        assert spark.conf.get(mode) == "STATIC"
    finally:
        spark.conf.set(mode, before)
    assert dates_of(spark.table("mart_static")) == {"2024-01-20": 1.0, "2024-01-21": 1.0, "2024-01-22": 2.0}


def test_catalog_mart_prunes_partitions(spark):
    sinks.save_by_date(daily_mart(spark, 1.0), "mart_by_date")
    one = spark.table("mart_by_date").where(F.col("event_date") == F.to_date(F.lit("2024-01-25")))
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_json_documents_are_nested(spark, folder):
    report = spark.createDataFrame(
        [("e1", 10, 1, 10.0, 10, 2, 20.0, 10.0, 100.0, 0.6, 0.5, False, -1.0, 2.0, "text")],
        "experiment_id string, control_visitors long, control_conversions long, control_rate_pct double, "
        "variant_visitors long, variant_conversions long, variant_rate_pct double, absolute_lift_pct double, "
        "relative_lift_pct double, z_score double, p_value double, is_significant boolean, ci_lower_pct double, "
        "ci_upper_pct double, interpretation string",
    )
    sinks.write_json(sinks.experiment_documents(report), f"{folder}/docs")
    lines = spark.read.text(f"{folder}/docs").collect()
    assert len(lines) == 1
    document = json.loads(lines[0].value)
    assert document["control"] == {"visitors": 10, "conversions": 1, "conversion_rate": 10.0}
    assert document["results"]["confidence_interval_upper"] == 2.0
    assert document["interpretation"] == "text"


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_write_that_fails_its_checks_leaves_the_table(spark, folder):
    path = f"{folder}/mart"
    checks = quality.write_checks(P, ["campaign_id"], {"spend": (0.0, 10.0)})
    sinks.write_checked(daily_mart(spark, 1.0, [20, 21]), path, checks)
    with pytest.raises(sinks.Refused, match="spend_out_of_range is 1") as refused:
        sinks.write_checked(daily_mart(spark, 99.0, [21, 22]), path, checks)
    assert refused.value.failed == {"spend_out_of_range": (1.0, 0.0)}
    assert dates_of(spark.read.parquet(path)) == {"2024-01-20": 1.0, "2024-01-21": 1.0}
    sinks.write_checked(daily_mart(spark, 2.0, [21, 22]), path, checks)
    assert dates_of(spark.read.parquet(path)) == {"2024-01-20": 1.0, "2024-01-21": 2.0, "2024-01-22": 2.0}
    sinks.write_checked(daily_mart(spark, 2.0, []), path, checks)  # no rows, nothing to hold against them
    assert os.listdir(folder) == ["mart"]


def test_missing_values_refuse_a_write(spark, folder):
    rows = daily_mart(spark, 1.0).withColumn("channel", F.when(F.dayofmonth("event_date") > 20, F.col("channel")))
    with pytest.raises(sinks.Refused, match="missing_channel is 0.0909"):
        sinks.write_checked(rows, f"{folder}/mart", quality.write_checks(P, ["channel"]))
    sinks.write_checked(rows, f"{folder}/mart", quality.write_checks(P.with_(missing_tolerance=0.1), ["channel"]))


def test_documents_are_paged_in_order_and_keep_everything(spark):
    found = spark.createDataFrame([(f"c{n:02d}", float(n), "do it") for n in range(45)], "campaign_id string, spend double, recommendation string")
    empty = spark.createDataFrame([], "campaign_id string, roas double")
    pages = documents.opportunity_documents({"big": found, "none": empty}, page_size=20).orderBy("page").collect()
    assert [(p.opportunity, p.page, len(p.findings)) for p in pages] == [("big", 0, 20), ("big", 1, 20), ("big", 2, 5)]
    assert [f.subject for p in pages for f in p.findings] == [f"c{n:02d}" for n in range(45)]
    assert pages[2].findings[4].figures == {"spend": 44.0} and pages[0].findings[0].recommendation == "do it"
