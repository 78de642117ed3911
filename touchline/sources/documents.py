"""Nested result documents per attribution model and per kind of opportunity.

A document lists findings in order. Lists are cut in pages of at most `PAGE` entries, numbered in the
document, so that none grows with the number of campaigns; a model or kind with few has
one page, numbered 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalars import CREDIT, exact_sum, half_up, join_null_safe
from touchline.plans.attribution import conversion_count, credit_by

PAGE = 1000


def _paged(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], entry: Sequence[str], name: str, size: int):
    """keys, page, `name`: the rows of each key in order, as lists of structs."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        rows.withColumn("_place", place).withColumn("page", F.floor((F.col("_place") - 1) / size).cast("int"))
        .groupBy(*keys, "page")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_place", *entry))),
            lambda e: F.struct(*[e[c].alias(c) for c in entry]),
        ).alias(name))
    )


def model_documents(shares: DataFrame, conversions: DataFrame, models: Sequence[str], page_size: int = PAGE) -> DataFrame:
    """Per model (and page): total, top channel, number of conversions, credit by channel and by campaign.

    `shares` are those of touched conversions; `conversions` are all staged ones, touched or not.
    """
    by_key = credit_by(shares, ["channel", "campaign_id"], models)
    order = [F.desc("credit"), F.asc("name")]
    pages, model = [], ["attribution_model"]
    channels = by_key.groupBy(*model, F.col("channel").alias("name")).agg(exact_sum("credit", CREDIT).alias("credit"))
    campaigns = by_key.groupBy(*model, F.col("campaign_id").alias("name")).agg(exact_sum("credit", CREDIT).alias("credit"))
    for rows, name in ((channels, "channel_breakdown"), (campaigns, "campaign_breakdown")):
        rounded = rows.withColumn("credit", half_up("credit", 4))
        pages.append(_paged(rounded, model, order, ["name", "credit"], name, page_size))
    # Of channels with equal credit the first by name.
    top = channels.groupBy(*model).agg(F.max("credit").alias("_best"), exact_sum("credit", CREDIT).alias("_total"))
    first = channels.join(top, "attribution_model").where(F.col("credit") == F.col("_best")).groupBy(*model, "_total").agg(
        F.min("name").alias("top_channel")
    )
    documents = join_null_safe(pages[1], pages[0], [*model, "page"], "left")
    totals = first.select(*model, half_up("_total", 4).alias("total_attributed_revenue"), "top_channel")
    count = conversion_count(conversions).scalar()
    return documents.join(totals, "attribution_model").withColumn("conversion_count", count).select(
        *model, "page", "total_attributed_revenue", "top_channel", "conversion_count", "channel_breakdown",
        "campaign_breakdown",
    )


def opportunity_documents(findings: Mapping[str, DataFrame], page_size: int = PAGE) -> DataFrame:
    """Per kind of opportunity (and page): its findings, each with the campaign, figures and advice.

    `findings` maps a kind to a table of the optimiser whose first column names the campaign or
    channel; `recommendation` is the advice, numbers are the figures.
    """
    parts = []
    for kind, rows in findings.items():
        subject, *others = rows.columns
        figures = [c for c in others if c != "recommendation"]
        advice = F.col("recommendation") if "recommendation" in others else F.lit(None).cast("string")
        parts.append(rows.select(
            F.lit(kind).alias("opportunity"), F.col(subject).alias("subject"),
            F.map_from_arrays(
                F.array(*[F.lit(c) for c in figures]), F.array(*[F.col(c).cast("double") for c in figures])
            ).alias("figures"),
            advice.alias("recommendation"),
        ))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return _paged_findings(rows, page_size)


def _paged_findings(rows: DataFrame, page_size: int) -> DataFrame:
    # Maps cannot be sorted; the place in the list can.
    place = F.row_number().over(W.partitionBy("opportunity").orderBy("subject"))
    entry = F.struct("subject", "figures", "recommendation")
    return (
        rows.select("opportunity", place.alias("_place"), entry.alias("entry"))
        .withColumn("page", F.floor((F.col("_place") - 1) / page_size).cast("int"))
        .groupBy("opportunity", "page")
        .agg(F.map_from_entries(F.collect_list(F.struct("_place", "entry"))).alias("_by_place"))
        .select("opportunity", "page", F.transform(
            F.array_sort(F.map_keys("_by_place")), lambda n: F.try_element_at("_by_place", n)
        ).alias("findings"))
    )
