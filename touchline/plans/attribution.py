"""Multi-touch attribution: journeys, four credit models and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalars import CREDIT, MICROS_PER_DAY, exact_sum, join_null_safe, ratio
from touchline.operators.order_stats import medians, refined_medians
from touchline.operators.timeline import sums_ahead, window_totals
from touchline.params import MODELS, Params

TOUCH_KEY = ["channel", "campaign_id"]
_CONVERSION = ["conversion_id", "user_id", "conversion_ts", "value"]


def credited_conversions(conversions: DataFrame, value: str = "conversion_value_usd") -> DataFrame:
    """The columns of staged conversions that credit depends on."""
    return conversions.select(
        "conversion_id", "user_id", F.col("event_timestamp").alias("conversion_ts"),
        F.col(value).alias("value"),
    )


def touch_columns(impressions: DataFrame) -> DataFrame:
    return impressions.select(
        "impression_id", "user_id", "channel", "campaign_id", "event_timestamp"
    )


def credit_shares(
    conversions: DataFrame, impressions: DataFrame, p: Params, unattributed: bool = True
) -> DataFrame:
    """One row per conversion and (channel, campaign) of its window, all models side by side.

    Columns: the conversion, channel, campaign_id, n_touches (of this key),
    journey_touches (of the conversion), is_last, is_first, and one column per
    model with the credit. With `unattributed`, a conversion without touches
    keeps one row whose channel and campaign are NULL and whose credit is the
    whole value; otherwise it has none. A journey of fewer than `min_touches`
    counts as none. All credits are NULL where the value is.
    """
    touched = window_totals(
        credited_conversions(conversions), touch_columns(impressions), p, by=TOUCH_KEY, keep_unmatched=unattributed
    )
    return shares_of_totals(touched, p, unattributed)


def shares_of_totals(touched: DataFrame, p: Params, unattributed: bool) -> DataFrame:
    """`credit_shares` from the window totals by channel and campaign."""
    journey = W.partitionBy("conversion_id")
    rows = touched.select(
        *_CONVERSION, *TOUCH_KEY, "n_touches", "journey_touches",
        (F.col("weight") / F.sum("weight").over(journey)).alias("_decay_share"),
        (F.col("first_touch") == F.min("first_touch").over(journey)).alias("_first"),
        (F.col("last_touch") == F.max("last_touch").over(journey)).alias("_last"),
    )
    if p.min_touches > 1:
        rows = _short_journeys_untouched(rows, p.min_touches, unattributed)
    alone = F.col("journey_touches") == 0
    value = F.col("value")
    rows = rows.withColumns({"is_last": alone | F.col("_last"), "is_first": alone | F.col("_first")})
    return rows.select(
        *_CONVERSION, *TOUCH_KEY, "n_touches", "journey_touches", "is_last", "is_first",
        F.when(F.col("is_last"), value).alias("last_touch"),
        F.when(F.col("is_first"), value).alias("first_touch"),
        F.when(alone, value).otherwise(
            value * F.col("n_touches") / F.col("journey_touches")
        ).alias("linear"),
        F.when(alone, value).otherwise(value * F.col("_decay_share")).alias("time_decay"),
    )


def _short_journeys_untouched(rows: DataFrame, least: int, keep: bool) -> DataFrame:
    """Journeys of 1 to `least` - 1 touches as untouched ones: a single row without a key, or none."""
    short = F.col("journey_touches").between(1, least - 1)
    if not keep:
        return rows.where(~short)
    # Exactly one key of a journey holds its first touch.
    one = rows.where(~short | F.col("_first"))
    return one.withColumns({
        **{c: F.when(~short, F.col(c)) for c in TOUCH_KEY},
        **{c: F.when(short, 0).otherwise(F.col(c)).cast("long") for c in ("n_touches", "journey_touches")},
    })


def credit_totals(
    conversions: DataFrame, impressions: DataFrame, p: Params, unattributed: bool = True
) -> DataFrame:
    """Credit summed by (channel, campaign), all models side by side: what `credit_shares` adds up to.

    For reports that need no shares. Conversions first learn the number and weight of their touches
    and their first and last one; then every touch receives value / number and value / weight of
    all conversions that see it, in one more pass over the time line (`sums_ahead`), and the
    touches' credit is added up by key. Conversions are never repeated per key of their user, which
    pays where users meet many campaigns; with a handful of them `credit_shares` has fewer steps.

    The rows stand in for shares: `credit_by`, `credit_breakdowns` and the model comparison
    take either. Sums are decimals.
    """
    half_life = p.half_life_days * MICROS_PER_DAY
    touches = touch_columns(impressions)
    found = window_totals(
        credited_conversions(conversions), touches, p, touch_fields=TOUCH_KEY, keep_unmatched=True
    )
    enough = F.col("n_touches") >= max(1, p.min_touches)
    touched = found.where(enough).withColumn("end_us", F.unix_micros("conversion_ts"))
    per_touch = sums_ahead(touches, touched, p, {
        "linear": F.col("value") / F.col("n_touches"), "decayed": F.col("value") / F.col("weight"),
    }, keep=TOUCH_KEY)
    # Conversions' weights are relative to the start of the block they end in; so is a touch's here.
    age = (F.col("ts_us") - F.col("edge")) / F.lit(float(half_life))

    def summed(amount: Column) -> Column:
        return F.sum(amount.cast(CREDIT))

    def edge(model: str) -> DataFrame:
        key = [F.col(f"{model}.{c}").alias(c) for c in TOUCH_KEY]
        return touched.groupBy(*key).agg(summed(F.col("value")).alias(model), F.lit(True).alias(f"is_{model[:-6]}"))

    parts = [
        edge("last_touch"), edge("first_touch"),
        per_touch.groupBy(*TOUCH_KEY).agg(
            summed(F.col("linear")).alias("linear"),
            summed(F.col("decayed") * F.pow(F.lit(2.0), age)).alias("time_decay"),
        ),
    ]
    if unattributed:
        alone = summed(F.col("value"))
        untouched = found.where(~enough).agg(F.count(F.lit(1)).alias("_n"), *[alone.alias(m) for m in MODELS])
        parts.append(untouched.where("_n > 0").select(
            *[F.lit(None).cast("string").alias(c) for c in TOUCH_KEY], *MODELS,
            F.lit(True).alias("is_last"), F.lit(True).alias("is_first"),
        ))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.groupBy(*TOUCH_KEY).agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("is_last", "is_first")],
        *[F.sum(m).cast(CREDIT).alias(m) for m in MODELS],
    )


def totals_of_shares(shares: DataFrame) -> DataFrame:
    """`credit_totals` from shares that are there already."""
    return shares.groupBy(*TOUCH_KEY).agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("is_last", "is_first")],
        *[F.sum(F.col(m).cast(CREDIT)).cast(CREDIT).alias(m) for m in MODELS],
    )


def credits(shares: DataFrame, models: Sequence[str]) -> DataFrame:
    """Long form: one row per conversion, model and credited (channel, campaign)."""
    holds = {"last_touch": F.col("is_last"), "first_touch": F.col("is_first")}
    entries = F.array(*[
        F.when(
            holds.get(m, F.lit(True)),
            F.struct(F.lit(m).alias("model"), F.col(m).alias("credit")),
        )
        for m in models
    ])
    return shares.withColumn("_entry", F.explode(entries)).where(F.col("_entry").isNotNull()).select(
        *_CONVERSION, *TOUCH_KEY, F.col("_entry.model").alias("attribution_model"),
        F.col("_entry.credit").alias("credit"), "journey_touches",
    )


def edge_touch_credit(
    conversions: DataFrame, impressions: DataFrame, p: Params, model: str
) -> DataFrame:
    """Last-touch or first-touch credit alone: an as-of join.

    Needs no per-key totals, so conversions are not repeated per key. Untouched
    conversions, and those of fewer than `min_touches`, keep a row with a NULL
    channel and campaign.
    """
    events = credited_conversions(conversions)
    found = window_totals(
        events, touch_columns(impressions), p, touch_fields=TOUCH_KEY, keep_unmatched=True
    )
    enough = F.col("n_touches") >= p.min_touches
    found = found.withColumns({
        "_touch": F.when(enough, F.col(model)), "n_touches": F.when(enough, F.col("n_touches")).otherwise(0).cast("long")
    })
    return found.select(
        "conversion_id", "user_id", "conversion_ts",
        F.lit(model).alias("attribution_model"),
        F.col("_touch.channel").alias("channel"),
        F.col("_touch.campaign_id").alias("campaign_id"),
        F.col("value").alias("credit"),
        F.lit(1).alias("touch_count"),
        F.col("n_touches").alias("journey_touches"),
    )


def attribution_summary(long_credits: DataFrame) -> DataFrame:
    """Per model, channel and campaign: distinct conversions and users, revenue, mean, median.

    Everything starts from counts per (key, user, credit), made once: the map
    side shrinks the data before the shuffle and the hot key is spread by user.
    Every later step uses all its columns, so the shuffle is run once and read
    again.
    """
    key = ["attribution_model", "channel", "campaign_id"]
    counted = long_credits.groupBy(
        *key, "user_id", "credit", F.col("conversion_id").isNotNull().alias("_has_id")
    ).agg(F.count(F.lit(1)).alias("_rows"))
    # 24 + 13 + 1 digits: the product keeps all ten decimals.
    amount = F.col("credit").cast("decimal(24,10)") * F.col("_rows").cast("decimal(13,0)")
    summary = counted.groupBy(*key).agg(
        F.sum(F.when(F.col("_has_id"), F.col("_rows")).otherwise(0)).alias("attributed_conversions"),
        F.count_distinct("user_id").alias("attributed_users"),
        F.sum(amount).cast("double").alias("attributed_revenue"),
        F.sum(F.when(F.col("credit").isNotNull(), F.col("_rows"))).alias("_valued"),
    )
    middle = medians(counted, key, "credit", weight="_rows")
    return join_null_safe(summary, middle, key, "left").select(
        *key,
        "attributed_conversions", "attributed_users", "attributed_revenue",
        F.when(F.col("_valued") > 0, F.col("attributed_revenue") / F.col("_valued")).alias(
            "avg_order_value"
        ),
        F.col("median").alias("median_order_value"),
    )


def summary_of_shares(shares: DataFrame, models: Sequence[str]) -> DataFrame:
    """`attribution_summary(credits(shares, models))` without making a row per model.

    Shares are shuffled once, by (key, user), models side by side; sums and users come from
    that shuffle directly. Medians are found by refinement: a histogram of the credits names
    the bin of each median, and only the credits in those bins are laid out by value. All
    three read the same shuffle, so its columns are arrays that every reader uses whole.
    """
    key = ["channel", "campaign_id"]
    holds = {"last_touch": F.col("is_last"), "first_touch": F.col("is_first")}
    nothing = F.array().cast("array<double>")

    def slot(held: Column, value: Column) -> Column:
        """Nothing, or one value that may be NULL."""
        return F.when(held, F.array(value)).otherwise(nothing)

    # Place 0 tells whether there is an id, the others are the models.
    dealt = shares.select(
        *key, "user_id",
        F.array(
            slot(F.col("conversion_id").isNotNull(), F.lit(1.0)),
            *[slot(holds.get(m, F.lit(True)), F.col(m).cast("double")) for m in models],
        ).alias("_slots"),
    ).repartition(*key, "user_id")

    def held(place: int) -> Column:
        return F.size(F.col("_slots")[place]) > 0

    def credit(place: int) -> Column:
        # Asked only where something is held; an empty slot has no first value.
        return F.get(F.col("_slots")[place], F.lit(0))

    places = {m: n for n, m in enumerate(models, 1)}
    by_user = dealt.groupBy(*key, "user_id").agg(*[
        column for m, n in places.items() for column in (
            F.count_if(held(n)).alias(f"{m}_n"), F.count_if(held(n) & held(0)).alias(f"{m}_ids"),
            F.count_if(credit(n).isNotNull()).alias(f"{m}_valued"), F.sum(credit(n).cast(CREDIT)).alias(f"{m}_sum"),
        )
    ])
    sums = by_user.groupBy(*key).agg(*[
        F.struct(
            F.lit(m).alias("attribution_model"), F.sum(f"{m}_ids").alias("attributed_conversions"),
            F.count_if(F.col(f"{m}_n") > 0).alias("attributed_users"),
            F.sum(f"{m}_sum").cast("double").alias("attributed_revenue"), F.sum(f"{m}_valued").alias("_valued"),
        ).alias(m) for m in models
    ])
    summary = sums.select(*key, F.explode(F.array(*models)).alias("_m")).select(*key, "_m.*").where("attributed_users > 0")
    # The outer form: of the other one the optimizer infers a filter, and this reader has a shuffle of its own.
    values = dealt.select(*key, F.posexplode_outer("_slots").alias("_place", "_slot")).where(
        (F.col("_place") > 0) & (F.size("_slot") > 0)
    ).select(
        F.get(F.array(F.lit(None).cast("string"), *[F.lit(m) for m in models]), F.col("_place")).alias("attribution_model"),
        *key, F.get("_slot", F.lit(0)).alias("credit"),
    )
    full_key = ["attribution_model", *key]
    middle = refined_medians(values, full_key, "credit")
    return join_null_safe(summary, middle, full_key, "left").select(
        *full_key, "attributed_conversions", "attributed_users", "attributed_revenue",
        F.when(F.col("_valued") > 0, F.col("attributed_revenue") / F.col("_valued")).alias("avg_order_value"),
        F.col("median").alias("median_order_value"),
    )


def _melt_models(sums: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per model from one column per model. Rows the model gave nothing to go."""
    entry = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("attribution_model"), F.col(m).alias("credit"), F.col(f"{m}_n").alias("n")
        )
        for m in models
    ]))
    return sums.withColumn("_entry", entry).where(F.col("_entry.n") > 0).select(
        "_entry.attribution_model", *keys, F.coalesce("_entry.credit", F.lit(0.0)).alias("credit")
    )


def credit_by(shares: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Credit per model and `keys`; models are summed side by side, then turned into rows."""
    holds = {"last_touch": F.col("is_last"), "first_touch": F.col("is_first")}
    sums = shares.groupBy(*keys).agg(
        *[exact_sum(m, CREDIT).alias(m) for m in models],
        *[F.count_if(holds.get(m, F.lit(True))).alias(f"{m}_n") for m in models],
    )
    return _melt_models(sums, keys, models)


def credit_breakdowns(shares: DataFrame, models: Sequence[str]) -> DataFrame:
    """Credit per model by channel, by campaign and in total, from one aggregation.

    `breakdown` is "channel", "campaign" or "total"; `name` is NULL for totals.
    """
    by_key = credit_by(shares, TOUCH_KEY, models)
    sets = by_key.groupingSets(
        [("attribution_model", "channel"), ("attribution_model", "campaign_id"), ("attribution_model",)],
        "attribution_model", "channel", "campaign_id",
    ).agg(
        exact_sum("credit", CREDIT).alias("credit"),
        F.grouping("channel").alias("_no_channel"),
        F.grouping("campaign_id").alias("_no_campaign"),
    )
    breakdown = (
        F.when(F.col("_no_channel") == 0, "channel")
        .when(F.col("_no_campaign") == 0, "campaign")
        .otherwise("total")
    )
    return sets.select(
        "attribution_model", breakdown.alias("breakdown"),
        F.coalesce("channel", "campaign_id").alias("name"), "credit",
    )


def conversion_count(conversions: DataFrame) -> DataFrame:
    """How many conversions there are, touched or not."""
    return conversions.agg(F.count(F.lit(1)).alias("conversion_count"))


def revenue_conservation(
    conversions: DataFrame, shares: DataFrame, p: Params, tolerance: float = 1e-6
) -> DataFrame:
    """Per model: staged conversions whose credits do not add up to their value.

    Starts from the conversions, so one that `shares` has lost counts as credited
    with nothing.
    """
    credited = shares.groupBy("conversion_id").agg(*[exact_sum(m, CREDIT).alias(m) for m in p.models])
    staged = credited_conversions(conversions).select("conversion_id", "value")
    rows = join_null_safe(staged, credited, ["conversion_id"], "left")
    entry = F.explode(F.array(*[
        F.struct(F.lit(m).alias("attribution_model"), F.col(m).alias("credited")) for m in p.models
    ]))
    gap = F.abs(F.coalesce("credited", F.lit(0.0)) - F.coalesce("value", F.lit(0.0)))
    return (
        rows.select("value", entry.alias("_entry")).select("value", "_entry.*")
        .groupBy("attribution_model")
        .agg(
            F.count(F.lit(1)).alias("conversions"),
            F.count_if(gap > tolerance).alias("violations"),
            exact_sum("value").alias("value"),
            exact_sum("credited", CREDIT).alias("credited"),
        )
    )


def attribution_roas(shares: DataFrame, impressions: DataFrame, p: Params) -> DataFrame:
    """Return on spend per model and channel. Channels with spend but no credit have 0."""
    spend = impressions.groupBy("channel").agg(exact_sum("impression_cost").alias("spend"))
    wide = shares.groupBy("channel").agg(*[exact_sum(m, CREDIT).alias(m) for m in p.models])
    joined = join_null_safe(spend, wide, ["channel"], "left")
    entry = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("attribution_model"), F.coalesce(m, F.lit(0.0)).alias("attributed_revenue")
        )
        for m in p.models
    ]))
    return joined.select("channel", "spend", entry.alias("_entry")).select(
        "_entry.attribution_model", "channel", "_entry.attributed_revenue", "spend",
        ratio("_entry.attributed_revenue", "spend").alias("attributed_roas"),
    )
