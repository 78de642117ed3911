"""The same queries as plain SQL over the given tables, written the direct way.

Attribution here joins every conversion to its touches; medians and ranks use
the engine's own functions. That is what the scalable forms are checked against.
"""

from __future__ import annotations

# The event log mapping, as in sources/event_log.py.
CAMPAIGNS = (
    "['brand_search','brand_display','teaser_video','feed_social',"
    "'generic_search','retarget_display','discover_video','stories_social']"
)
CAMPAIGN_NAMES = (
    "['Brand Search','Brand Display','Teaser Video','Feed Social',"
    "'Generic Search','Retarget Display','Discover Video','Stories Social']"
)
CHANNELS = "['Search','Display','Video','Social']"
DEVICES = "['desktop','mobile','tablet','mobile','crawler']"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"

LOG = """log AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
), feed AS (
  SELECT *, ts + to_hours(k) AS synced FROM log
)"""

REDELIVERED = """log AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
), feed AS (
  SELECT *, ts + to_hours(k) AS synced FROM log
  UNION ALL
  SELECT event_id, ts, user_id, event_type, value + 1 AS value, k, ts + to_hours(k) - INTERVAL 1 HOUR AS synced FROM log
)"""

RAW = f"""raw_impressions AS (
  SELECT event_id AS impression_id, CASE WHEN k <> 93 THEN user_id END AS user_id,
         ({CAMPAIGNS})[k % 8 + 1] AS campaign_id,
         ({CAMPAIGN_NAMES})[k % 8 + 1] AS campaign_name,
         ({CHANNELS})[k % 4 + 1] AS channel, ts AS event_timestamp, value AS impression_cost,
         'advertiser' AS advertiser_id, 'creative_' || (k % 3) AS creative_id,
         'placement_' || (k % 6) AS placement_id, ({DEVICES})[k % 5 + 1] AS device_type, 'US' AS country,
         CASE WHEN k <> 94 THEN k >= 95 END AS is_bot, synced
  FROM feed WHERE event_type = 'view'
), raw_conversions AS (
  SELECT event_id AS conversion_id, CASE WHEN k <> 10 THEN user_id END AS user_id,
         ({CAMPAIGNS})[k % 8 + 1] AS campaign_id, 'order_' || event_id AS order_id, ts AS event_timestamp,
         CASE WHEN k NOT IN (7, 8) THEN value END AS conversion_value,
         CASE WHEN k NOT IN (8, 9) THEN value END AS conversion_value_usd,
         CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'trial_signup' END AS conversion_type,
         'advertiser' AS advertiser_id, 'US' AS country, ({DEVICES})[k % 5 + 1] AS device_type, synced
  FROM feed WHERE event_type IN ('purchase', 'signup')
), clicks AS (
  SELECT event_id AS click_id, ({CAMPAIGNS})[k % 8 + 1] AS campaign_id, user_id, ts AS event_timestamp
  FROM feed WHERE event_type = 'click'
), unfilled AS (
  SELECT event_id AS request_id, ({CAMPAIGNS})[k % 8 + 1] AS campaign_id, ts AS event_timestamp
  FROM feed WHERE event_type = 'error'
)"""

STAGED = f"""latest_impressions AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY impression_id
      ORDER BY synced DESC NULLS LAST, event_timestamp DESC NULLS LAST) AS rn FROM raw_impressions) WHERE rn = 1
), impressions AS (
  SELECT *, is_bot OR (impression_cost = 0 AND event_timestamp IS NOT NULL) AS is_bot_flag FROM latest_impressions
  WHERE impression_id IS NOT NULL AND user_id IS NOT NULL AND campaign_id IS NOT NULL
    AND event_timestamp IS NOT NULL AND event_timestamp >= {NOW} - INTERVAL 90 DAY
    AND NOT (is_bot OR (impression_cost = 0 AND event_timestamp IS NOT NULL))
), latest_conversions AS (
  SELECT *, conversion_value IS NULL AND conversion_value_usd IS NULL AS lacks_value,
         event_timestamp IS NULL AS lacks_timestamp, user_id IS NULL AS lacks_user
  FROM (SELECT *, row_number() OVER (PARTITION BY conversion_id
      ORDER BY synced DESC NULLS LAST, event_timestamp DESC NULLS LAST) AS rn FROM raw_conversions) WHERE rn = 1
), conversions AS (
  SELECT conversion_id, user_id, campaign_id, order_id, event_timestamp,
         COALESCE(conversion_value, conversion_value_usd, 0.0) AS conversion_value, conversion_value_usd,
         conversion_type, advertiser_id, country, device_type, synced
  FROM latest_conversions
  WHERE NOT (lacks_value OR lacks_timestamp OR lacks_user)
    AND event_timestamp >= {NOW} - INTERVAL 90 DAY AND event_timestamp <= {NOW}
)"""

BASE = f"WITH {LOG}, {RAW}, {STAGED}"
WITHIN = BASE.replace(f"{NOW} - INTERVAL 90 DAY", "TIMESTAMP '2024-01-10 00:00:00'").replace(
    NOW, "TIMESTAMP '2024-01-20 12:00:00'"
)
REDELIVERED_BASE = f"WITH {REDELIVERED}, {RAW}, {STAGED}"


def money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,6))) AS DOUBLE)"


def credit(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(28,10))) AS DOUBLE)"


def half_up(x: str, places: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {places}) AS DOUBLE)"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def instant(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def ratio(n: str, d: str, default: str = "0.0") -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE {default} END"


RATIOS = f"""CASE WHEN spend > 0 THEN spend / impressions * 1000 ELSE 0.0 END AS cpm,
  {ratio('clicks', 'impressions')} AS ctr, {ratio('spend', 'clicks')} AS cpc,
  {ratio('spend', 'conversions')} AS cpa, {ratio('revenue', 'spend')} AS roas,
  {ratio('conversions', 'clicks')} AS cvr, {ratio('revenue', 'conversions')} AS aov"""


def mart_ctes(period: str, expression: str) -> str:
    d = expression
    return f"""i AS (
  SELECT campaign_id, campaign_name, channel, {d} AS {period}, count(impression_id) AS impressions,
         count(DISTINCT user_id) AS unique_users, {money('impression_cost')} AS spend,
         CAST(sum(CASE WHEN impression_cost = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_cost_impressions
  FROM impressions GROUP BY ALL
), c AS (
  SELECT campaign_id, {d} AS {period}, count(*) AS clicks, count(DISTINCT user_id) AS users_who_clicked
  FROM clicks GROUP BY ALL
), v AS (
  SELECT campaign_id, {d} AS {period}, count(DISTINCT conversion_id) AS conversions,
         count(DISTINCT user_id) AS users_who_converted, {money('conversion_value_usd')} AS revenue
  FROM conversions GROUP BY ALL
), joined AS (
  SELECT i.*, COALESCE(clicks, 0) AS clicks, COALESCE(users_who_clicked, 0) AS users_who_clicked,
         COALESCE(conversions, 0) AS conversions, COALESCE(users_who_converted, 0) AS users_who_converted,
         COALESCE(revenue, 0.0) AS revenue
  FROM i LEFT JOIN c USING (campaign_id, {period}) LEFT JOIN v USING (campaign_id, {period})
), mart AS (
  SELECT *, {RATIOS},
         {ratio('impressions', '(impressions + zero_cost_impressions)', '1.0')} AS fill_rate,
         {ratio('impressions', 'unique_users')} AS frequency
  FROM joined
)"""


MART = f"{BASE}, " + mart_ctes("event_date", "CAST(event_timestamp AS DATE)")

CAMPAIGN_CTE = f"""campaigns AS (
  SELECT *, {RATIOS} FROM (
    SELECT campaign_id, channel, {money('spend')} AS spend, CAST(sum(impressions) AS BIGINT) AS impressions,
           CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(conversions) AS BIGINT) AS conversions,
           {money('revenue')} AS revenue, count(DISTINCT event_date) AS days_active
    FROM mart GROUP BY campaign_id, channel)
)"""
CAMPAIGN = f"{MART}, {CAMPAIGN_CTE}"
DAILY_CAMPAIGN = f"""{MART}, campaigns AS (
  SELECT * REPLACE (campaign_id || '@' || {day('event_date')} AS campaign_id) FROM mart
)"""

# Conversions paired with every touch in the window, one row without touch if none.
PAIRS = f"""pairs AS (
  SELECT c.conversion_id, c.user_id, c.event_timestamp AS conversion_ts, c.conversion_value_usd AS value,
         i.impression_id, i.channel, i.campaign_id, i.event_timestamp AS touch_ts, i.impression_cost AS cost,
         pow(2.0, -((epoch_us(c.event_timestamp) - epoch_us(i.event_timestamp)) / 86400000000.0) / 7.0) AS w,
         row_number() OVER (PARTITION BY c.conversion_id ORDER BY i.event_timestamp, i.impression_id) AS nth,
         row_number() OVER (PARTITION BY c.conversion_id ORDER BY i.event_timestamp DESC, i.impression_id DESC) AS nth_last,
         count(i.impression_id) OVER (PARTITION BY c.conversion_id) AS journey_touches
  FROM conversions c LEFT JOIN impressions i ON c.user_id = i.user_id
   AND i.event_timestamp <= c.event_timestamp AND i.event_timestamp >= c.event_timestamp - INTERVAL 28 DAY
)"""

SHARES_CTE = f"""{PAIRS}, keyed AS (
  SELECT conversion_id, user_id, conversion_ts, value, journey_touches, channel, campaign_id,
         count(impression_id) AS n_touches, sum(w) AS w, bool_or(nth = 1) AS is_first, bool_or(nth_last = 1) AS is_last
  FROM pairs GROUP BY ALL
), all_shares AS (
  SELECT *, CASE WHEN is_last THEN value END AS last_touch, CASE WHEN is_first THEN value END AS first_touch,
         CASE WHEN journey_touches = 0 THEN value ELSE value * n_touches / journey_touches END AS linear,
         CASE WHEN journey_touches = 0 THEN value
              ELSE value * (w / sum(w) OVER (PARTITION BY conversion_id)) END AS time_decay
  FROM keyed
)"""


def shares(condition: str) -> str:
    """Shares and long credits, `condition` choosing the conversions."""
    return f"""{BASE}, {SHARES_CTE}, shares AS (SELECT * FROM all_shares WHERE {condition}), credits AS (
  SELECT *, 'last_touch' AS attribution_model, last_touch AS credit FROM shares WHERE is_last
  UNION ALL SELECT *, 'first_touch', first_touch FROM shares WHERE is_first
  UNION ALL SELECT *, 'linear', linear FROM shares
  UNION ALL SELECT *, 'time_decay', time_decay FROM shares
)"""


ALL = shares("TRUE")
TOUCHED = shares("journey_touches > 0")

CHANNEL_CREDIT = f"""channel_credit AS (
  SELECT attribution_model, channel, {credit('credit')} AS credit FROM credits GROUP BY ALL
)"""


def edge_touch(model: str, nth: str) -> str:
    return f"""{BASE}, {PAIRS}
SELECT conversion_id, user_id, {instant('conversion_ts')} AS conversion_ts, '{model}' AS attribution_model,
       channel, campaign_id, value AS credit, 1 AS touch_count, journey_touches
FROM pairs WHERE {nth} = 1"""


def sorted_marts(period: str, expression: str) -> str:
    return f"""{BASE}, {mart_ctes(period, expression)}
SELECT * REPLACE ({day(period)} AS {period}) FROM mart ORDER BY {period} DESC, campaign_id"""


def upper_median(metric: str, condition: str = "TRUE") -> str:
    """The value at 0-based position n // 2."""
    return f"(SELECT list_sort(list({metric}))[count({metric}) // 2 + 1] FROM campaigns WHERE {condition})"


def high_cpa(base: str) -> str:
    return f"""{base}, m AS (SELECT COALESCE({upper_median('cpa', 'conversions > 0')}, 0.0) AS median)
SELECT campaign_id, {half_up('cpa', 2)} AS current_cpa, {half_up('median', 2)} AS median_cpa,
       'Review targeting, landing pages, or bid strategy' AS recommendation
FROM campaigns, m WHERE conversions > 0 AND cpa > median * 1.5"""


def low_ctr(base: str) -> str:
    return f"""{base}, m AS (SELECT {upper_median('ctr')} AS median)
SELECT campaign_id, {half_up('ctr * 100', 2)} AS current_ctr, {half_up('median * 100', 2)} AS median_ctr,
       'Refresh ad creatives or improve targeting' AS recommendation
FROM campaigns, m WHERE ctr < median * 0.7"""


def scaling(base: str) -> str:
    return f"""{base}, m AS (SELECT {upper_median('roas')} AS median)
SELECT campaign_id, {half_up('roas', 2)} AS current_roas, {half_up('spend', 2)} AS current_spend,
       {half_up('revenue * 0.1', 2)} AS potential_10pct_increase_revenue
FROM campaigns, m WHERE roas > median * 1.2"""


TIERED = f"""{CAMPAIGN}, tiered AS (
  SELECT *, CASE WHEN place <= 2 THEN 'top_performers' WHEN place <= 5 THEN 'mid_performers'
                 ELSE 'underperformers' END AS tier
  FROM (SELECT *, row_number() OVER (ORDER BY roas DESC, campaign_id, channel) AS place FROM campaigns)
)"""


def allocated(budget: str) -> str:
    def relative(m):
        return f"CASE WHEN max(CAST({m} AS DOUBLE)) OVER () > 0 THEN CAST({m} AS DOUBLE) / max(CAST({m} AS DOUBLE)) OVER () ELSE 0.0 END"

    return f"""{CAMPAIGN}, scored AS (
  SELECT *, {relative('roas')} * 0.5 + {relative('ctr')} * 0.3 + {relative('conversions')} * 0.2 AS score
  FROM campaigns
), totals AS (
  SELECT CAST(sum(CAST(score AS DECIMAL(28,12))) AS DOUBLE) AS score_sum, {money('spend')} AS spend_sum FROM scored
), allocated AS (
  SELECT scored.*, CASE WHEN score_sum > 0 THEN score / score_sum ELSE 0.0 END * {budget} AS allocation
  FROM scored, totals
)"""


TAIL = """(exp(-abs(z_score) * abs(z_score) / 2.0) / sqrt(2.0 * pi()) *
  (0.319381530 * t + -0.356563782 * pow(t, 2) + 1.781477937 * pow(t, 3) + -1.821255978 * pow(t, 4)
   + 1.330274429 * pow(t, 5)))"""


def experiment_counts(names: str, size: int) -> str:
    return f"""units AS (
  SELECT ({names})[k % {size} + 1] AS experiment_id,
         CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN 'control' ELSE 'variant' END AS arm,
         user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'purchase') AS converted
  FROM log WHERE event_type IN ('view', 'purchase')
  GROUP BY ALL HAVING bool_or(event_type = 'view')
), counts AS (
  SELECT experiment_id, count(*) FILTER (arm = 'control') AS control_visitors,
         count(*) FILTER (arm = 'control' AND converted) AS control_conversions,
         count(*) FILTER (arm = 'variant') AS variant_visitors,
         count(*) FILTER (arm = 'variant' AND converted) AS variant_conversions
  FROM units GROUP BY experiment_id
)"""


ANALYZED = f"""WITH {LOG}, {experiment_counts(CHANNELS, 4)}, rated AS (
  SELECT *, {ratio('control_conversions', 'control_visitors')} AS control_rate,
         {ratio('variant_conversions', 'variant_visitors')} AS variant_rate,
         {ratio('(control_conversions + variant_conversions)', '(control_visitors + variant_visitors)')} AS pooled
  FROM counts
), lifted AS (
  SELECT *, variant_rate - control_rate AS absolute_lift,
         CASE WHEN control_rate > 0 THEN (variant_rate - control_rate) / control_rate ELSE 0.0 END AS relative_lift,
         sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / control_visitors + 1.0::DOUBLE / variant_visitors)) AS pooled_se,
         sqrt(control_rate * (1 - control_rate) / control_visitors
              + variant_rate * (1 - variant_rate) / variant_visitors) AS se
  FROM rated
), scored AS (
  SELECT *, CASE WHEN pooled_se > 0 THEN absolute_lift / pooled_se ELSE 0.0 END AS z_score FROM lifted
), tested AS (
  SELECT *, CASE WHEN z_score = 0 THEN 1.0 ELSE 2.0 * {TAIL} END AS p_value
  FROM (SELECT *, 1.0 / (1.0 + 0.2316419 * abs(z_score)) AS t FROM scored)
), analyzed AS (
  SELECT *, p_value < 0.05 AS is_significant, absolute_lift - se * 1.96 AS ci_lower,
         absolute_lift + se * 1.96 AS ci_upper FROM tested
)"""

INTERPRETATION = f"""CASE WHEN NOT is_significant THEN 'Result is NOT statistically significant. Continue testing or accept that there''s no meaningful difference.'
            WHEN relative_lift > 0 THEN printf('Variant is %.1f%% better than control. Statistically significant. Consider rolling out.', {half_up('abs(relative_lift) * 100', 1)})
            ELSE printf('Variant is %.1f%% worse than control. Statistically significant. Stick with control.', {half_up('abs(relative_lift) * 100', 1)})
       END"""

# Normal quantiles of 1 - alpha / 2 and of the power, alpha = .05, power = .8.
Z_SUM = "(1.959963984540054 + 0.8416212335729143)"


def sample_size(baseline: str, effect: str) -> str:
    target = f"({baseline} * (1 + {effect}))"
    h = f"(2 * (asin(sqrt({target})) - asin(sqrt({baseline}))))"
    return (
        f"CASE WHEN {baseline} > 0 AND {target} <= 1 AND {effect} <> 0 "
        f"THEN CAST(ceil(2.0 * {Z_SUM} * {Z_SUM} / ({h} * {h})) AS BIGINT) END"
    )


BASELINES = f"""WITH {LOG}, {experiment_counts(CAMPAIGNS, 8)}, baselines AS (
  SELECT experiment_id, {ratio('control_conversions', 'control_visitors')} AS baseline_rate FROM counts
)"""


def missing_row(column: str) -> str:
    return f"""SELECT '{column}' AS column_name, count(*) FILTER ({column} IS NULL) AS missing,
  count(*) AS "rows" FROM raw_impressions"""


def freshness_row(name: str, table: str) -> str:
    return f"""SELECT '{name}' AS source, max(event_timestamp) AS newest,
  (epoch_us({NOW}) - epoch_us(max(event_timestamp))) / 3600000000.0 AS staleness_hours FROM {table}"""


def reason_row(name: str, condition: str) -> str:
    return f"""SELECT '{name}' AS reason, count(*) FILTER ({condition}) AS failing, count(*) AS records
  FROM latest_conversions"""


def range_row(metric: str, low: float, high: float) -> str:
    return f"""SELECT campaign_id, {day('event_date')} AS event_date, '{metric}' AS metric, {metric} AS value,
  {low}::DOUBLE AS min_value, {high}::DOUBLE AS max_value, {metric} BETWEEN {low} AND {high} AS in_range FROM mart"""


def identity_row(name: str, applies: str, left: str, right: str) -> str:
    return f"""SELECT '{name}' AS identity, count(*) FILTER ({applies}) AS rows_checked,
  count(*) FILTER (CASE WHEN {applies} THEN abs({left} - {right}) > 1e-9 * greatest(abs({left}), 1.0) ELSE FALSE END)
  AS violations FROM mart"""


def union(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)


LATEST_EVENTS = f"""WITH {REDELIVERED}
SELECT event_id, {instant('ts')} AS event_timestamp, {instant('synced')} AS _synced_at, user_id, event_type, value, k
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY synced DESC, ts DESC) AS rn FROM feed) WHERE rn = 1"""


def model_credit(model: str) -> str:
    best = f"max(credit) FILTER (attribution_model = '{model}')"
    return f"{half_up(best, 4)} AS {model}"


#: A mart after a refresh of its last four days with one day gone and one moved (as-of 2024-01-31).
REFRESHED = f"""{MART}, later AS (
  SELECT * REPLACE (CASE WHEN event_date = DATE '2024-01-29' THEN DATE '2024-01-30' ELSE event_date END AS event_date,
                    2 * spend AS spend)
  FROM mart WHERE event_date <> DATE '2024-01-28'
)
SELECT campaign_id, channel, {day('event_date')} AS event_date, impressions, spend FROM (
  SELECT * FROM mart WHERE event_date < DATE '2024-01-27'
  UNION ALL SELECT * FROM later WHERE event_date >= DATE '2024-01-27'
)"""

ORACLE: dict[str, str] = {
    "dedup_latest": LATEST_EVENTS,
    "stg_impressions": f"""{REDELIVERED_BASE}
SELECT impression_id, {instant('event_timestamp')} AS event_timestamp, user_id, campaign_id, campaign_name, channel,
       impression_cost, device_type, advertiser_id, creative_id, placement_id, country, is_bot_flag,
       sha256(impression_id) AS impression_key
FROM impressions""",
    "stg_conversions": f"""{REDELIVERED_BASE}
SELECT conversion_id, {instant('event_timestamp')} AS event_timestamp, user_id, campaign_id, conversion_value,
       conversion_value_usd, conversion_type, order_id, advertiser_id, country, device_type,
       FALSE AS is_invalid_record, COALESCE(synced > {NOW} - INTERVAL 72 HOUR, FALSE) AS is_late_arrival,
       (epoch_us(synced) - epoch_us(event_timestamp)) / 3600000000.0 AS arrival_lag_hours,
       sha256(conversion_id) AS conversion_key
FROM conversions""",
    "bot_filter_nulls": f"""WITH {LOG}, {RAW}, flagged AS (
  SELECT is_bot, device_type, is_bot OR (impression_cost = 0 AND event_timestamp IS NOT NULL)
         OR regexp_matches(lower(device_type), 'bot|crawler|spider') AS is_bot_flag FROM raw_impressions
)
SELECT is_bot, device_type, is_bot_flag, count(*) AS impressions, count(*) FILTER (NOT is_bot_flag) AS kept
FROM flagged GROUP BY ALL""",
    "campaign_daily_base": f"""{MART}
SELECT 'impressions' AS source, campaign_id, {day('event_date')} AS event_date, impressions AS events,
       unique_users AS users, spend AS amount, zero_cost_impressions FROM i
UNION ALL SELECT 'clicks', campaign_id, {day('event_date')}, clicks, users_who_clicked, NULL, 0 FROM c
UNION ALL SELECT 'conversions', campaign_id, {day('event_date')}, conversions, users_who_converted, revenue, 0 FROM v""",
    "mart_campaign_metrics": sorted_marts("event_date", "CAST(event_timestamp AS DATE)"),
    "metrics_weekly": sorted_marts("week_start", "CAST(date_trunc('week', event_timestamp) AS DATE)"),
    "metrics_monthly": sorted_marts("month_start", "CAST(date_trunc('month', event_timestamp) AS DATE)"),
    "report_monthly": f"""{BASE}, {mart_ctes("month_start", "CAST(date_trunc('month', event_timestamp) AS DATE)")}
SELECT campaign_id, channel, {day('month_start')} AS month_start, impressions, clicks, conversions, spend, revenue,
       cpm, ctr, cpc, cpa, roas, fill_rate, frequency FROM mart""",
    "reach_rollup": f"""{BASE}
SELECT campaign_id, campaign_name, channel, {day("CAST(date_trunc('week', event_timestamp) AS DATE)")} AS week_start,
       count(DISTINCT user_id) AS unique_users, TRUE AS within_error
FROM impressions GROUP BY campaign_id, campaign_name, channel, CAST(date_trunc('week', event_timestamp) AS DATE)""",
    "fill_rate_requests": f"""{BASE}, requests AS (
  SELECT campaign_id, CAST(event_timestamp AS DATE) AS d, 1 AS served FROM impressions
  UNION ALL SELECT campaign_id, CAST(event_timestamp AS DATE), 0 FROM unfilled
)
SELECT campaign_id, {day('d')} AS event_date, CAST(sum(served) AS BIGINT) AS served_impressions,
       CAST(sum(1 - served) AS BIGINT) AS unfilled_requests, sum(served)::DOUBLE / count(*) AS request_fill_rate
FROM requests GROUP BY campaign_id, d""",
    "metrics_by_conversion_type": f"""{BASE}
SELECT campaign_id, {day('CAST(event_timestamp AS DATE)')} AS event_date, conversion_type,
       count(DISTINCT conversion_id) AS conversions, count(DISTINCT user_id) AS users_who_converted,
       {money('conversion_value_usd')} AS revenue
FROM conversions GROUP BY ALL""",
    "unique_converters": f"""{BASE}
SELECT campaign_id, {day('CAST(event_timestamp AS DATE)')} AS event_date, count(DISTINCT user_id) AS unique_converters
FROM conversions GROUP BY ALL""",
    "metrics_by_group": f"""{TOUCHED}, {mart_ctes("month_start", "CAST(date_trunc('month', event_timestamp) AS DATE)")},
credited AS (
  SELECT channel, campaign_id, {credit('linear')} AS attributed_revenue FROM shares GROUP BY channel, campaign_id
), figures AS (
  SELECT mart.campaign_id, mart.channel, month_start, MAP {{
    'efficiency_metrics/cpm': {ratio('spend', 'impressions')} * 1000, 'efficiency_metrics/cpc': cpc,
    'efficiency_metrics/cpa': cpa, 'engagement_metrics/ctr': ctr * 100, 'engagement_metrics/cvr': cvr * 100,
    'engagement_metrics/frequency': frequency, 'roi_metrics/roas': roas, 'roi_metrics/aov': aov,
    'roi_metrics/revenue': revenue, 'reach_metrics/impressions': impressions::DOUBLE,
    'reach_metrics/unique_users': unique_users::DOUBLE, 'reach_metrics/frequency': frequency,
    'attribution_metrics/attributed_revenue': COALESCE(attributed_revenue, 0.0)}} AS m
  FROM mart LEFT JOIN credited ON mart.channel IS NOT DISTINCT FROM credited.channel
   AND mart.campaign_id IS NOT DISTINCT FROM credited.campaign_id
), entries AS (
  SELECT campaign_id, channel, month_start, unnest(map_entries(m)) AS e FROM figures
)
SELECT campaign_id, channel, {day('month_start')} AS month_start, split_part(e.key, '/', 1) AS metric_group,
       split_part(e.key, '/', 2) AS metric, {half_up('e.value', 6)} AS value FROM entries""",
    "benchmark_flags": f"""{MART}
SELECT campaign_id, channel, {day('event_date')} AS event_date, roas >= 4.0 AS meets_roas, cpa <= 50.0 AS meets_cpa,
       ctr >= 0.015 AS meets_ctr, cvr >= 0.03 AS meets_cvr, fill_rate >= 0.95 AS meets_fill_rate,
       target AS channel_ctr_target, ctr >= target AS meets_channel_ctr
FROM (SELECT *, CASE channel WHEN 'Search' THEN 0.015::DOUBLE WHEN 'Display' THEN 0.005::DOUBLE
      WHEN 'Video' THEN 0.03::DOUBLE END AS target FROM mart)""",
    "seasonality_adjusted": f"""{MART}, factored AS (
  SELECT *, CASE strftime(event_date, '%Y-%m') WHEN '2024-11' THEN 1.5::DOUBLE WHEN '2024-12' THEN 2.0::DOUBLE
         WHEN '2024-01' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS f FROM mart
)
SELECT campaign_id, {day('event_date')} AS event_date, f AS seasonal_factor, impressions / f AS impressions_adjusted,
       spend / f AS spend_adjusted, revenue / f AS revenue_adjusted, roas / f AS roas_adjusted FROM factored""",
    "journey_ranges": f"""{BASE}, numbered AS (
  SELECT user_id, event_timestamp, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp, impression_id) AS n
  FROM impressions
)
SELECT c.conversion_id, c.user_id, epoch_us(c.event_timestamp) AS conversion_us,
       count(n) FILTER (i.event_timestamp < c.event_timestamp - INTERVAL 28 DAY) + 1 AS first_number,
       count(n) FILTER (i.event_timestamp <= c.event_timestamp) AS last_number,
       count(n) FILTER (i.event_timestamp BETWEEN c.event_timestamp - INTERVAL 28 DAY AND c.event_timestamp) AS n_touches
FROM conversions c LEFT JOIN numbered i ON c.user_id = i.user_id GROUP BY c.conversion_id, c.user_id, c.event_timestamp""",
    "journey_pages": f"""{BASE}, {PAIRS}
SELECT conversion_id, user_id, journey_touches AS n_touches, CAST(0 AS BIGINT) AS page,
       CAST(count(impression_id) AS INTEGER) AS page_touches,
       COALESCE(string_agg(impression_id || ':' || channel || ':' || campaign_id, '>' ORDER BY nth), '') AS path
FROM pairs GROUP BY conversion_id, user_id, journey_touches""",
    "journey_touches": f"""{BASE}, {PAIRS}
SELECT conversion_id, user_id, epoch_us(conversion_ts) AS conversion_us, epoch_us(touch_ts) AS ts_us, impression_id,
       channel, campaign_id, cost FROM pairs""",
    "attr_last_touch": edge_touch("last_touch", "nth_last"),
    "attr_first_touch": edge_touch("first_touch", "nth"),
    "attr_linear": f"""{TOUCHED}
SELECT conversion_id, user_id, channel, campaign_id, n_touches, journey_touches, linear AS credit FROM shares""",
    "attr_time_decay": f"""{TOUCHED}
SELECT conversion_id, user_id, channel, campaign_id, n_touches, journey_touches, {half_up('time_decay', 6)} AS credit
FROM shares""",
    "attr_min_touches": f"""{shares('journey_touches >= 3')}, short AS (
  SELECT DISTINCT conversion_id, value FROM all_shares WHERE journey_touches < 3
), both_kinds AS (
  SELECT attribution_model, channel, credit FROM credits
  UNION ALL SELECT m.model, NULL, value FROM short, (VALUES ('last_touch'), ('first_touch'), ('linear'), ('time_decay')) m(model)
)
SELECT attribution_model, channel, {half_up(f"COALESCE({credit('credit')}, 0.0)", 4)} AS credit
FROM both_kinds GROUP BY attribution_model, channel""",
    "attr_min_touches_last_touch": f"""{BASE}, {PAIRS}
SELECT CASE WHEN journey_touches >= 3 THEN channel END AS channel, count(*) AS conversions, {money('value')} AS credit,
       min(CASE WHEN journey_touches >= 3 THEN journey_touches ELSE 0 END) AS least_touches
FROM pairs WHERE nth_last = 1 GROUP BY ALL""",
    "mart_attribution_summary": f"""{ALL}
SELECT attribution_model, channel, campaign_id, count(DISTINCT conversion_id) AS attributed_conversions,
       count(DISTINCT user_id) AS attributed_users, {half_up(credit('credit'), 4)} AS attributed_revenue,
       {half_up(f"{credit('credit')} / count(credit)", 4)} AS avg_order_value,
       {half_up('quantile_cont(credit, 0.5)', 4)} AS median_order_value
FROM credits GROUP BY attribution_model, channel, campaign_id ORDER BY attribution_model, attributed_revenue DESC""",
    "attr_totals": f"""{ALL}
SELECT attribution_model, channel, campaign_id, {half_up(f"COALESCE({credit('credit')}, 0.0)", 4)} AS credit
FROM credits GROUP BY attribution_model, channel, campaign_id""",
    "attr_channel_breakdown": f"""{TOUCHED}
SELECT attribution_model, channel, {half_up(f"COALESCE({credit('credit')}, 0.0)", 4)} AS credit
FROM credits GROUP BY attribution_model, channel ORDER BY attribution_model, credit DESC""",
    "attr_campaign_breakdown": f"""{TOUCHED}
SELECT attribution_model, campaign_id, {half_up(f"COALESCE({credit('credit')}, 0.0)", 4)} AS credit
FROM credits GROUP BY attribution_model, campaign_id ORDER BY attribution_model, credit DESC""",
    "attr_model_comparison": f"""{TOUCHED}, {CHANNEL_CREDIT}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY attribution_model ORDER BY credit DESC, channel) AS place FROM channel_credit
)
SELECT attribution_model, {half_up(credit('credit'), 4)} AS total_revenue,
       max(channel) FILTER (place = 1) AS top_channel, (SELECT count(*) FROM conversions) AS conversion_count
FROM placed GROUP BY attribution_model""",
    "attr_consensus": f"""{TOUCHED}, {CHANNEL_CREDIT}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY attribution_model ORDER BY credit DESC, channel) AS place FROM channel_credit
)
SELECT channel, count(*) AS appears_in_top_2, 4 AS models FROM placed WHERE place <= 2 GROUP BY channel""",
    "attr_divergence": f"""{TOUCHED}, {CHANNEL_CREDIT}, models AS (
  SELECT unnest(['last_touch', 'first_touch', 'linear', 'time_decay']) AS attribution_model
), grid AS (
  SELECT ch.channel, COALESCE(x.credit, 0.0) AS credit
  FROM (SELECT DISTINCT channel FROM channel_credit) ch CROSS JOIN models m
  LEFT JOIN channel_credit x ON x.channel = ch.channel AND x.attribution_model = m.attribution_model
)
SELECT channel, {half_up('avg(credit)', 2)} AS mean_credit, {half_up('stddev_pop(credit)', 2)} AS std_dev,
       {half_up('min(credit)', 4)} AS min_credit, {half_up('max(credit)', 4)} AS max_credit FROM grid GROUP BY channel""",
    "attr_revenue_conservation": f"""{ALL}, per_conversion AS (
  SELECT attribution_model, conversion_id, any_value(value) AS value, {credit('credit')} AS credited
  FROM credits GROUP BY attribution_model, conversion_id
)
SELECT attribution_model, count(*) AS conversions,
       count(*) FILTER (abs(COALESCE(credited, 0.0) - COALESCE(value, 0.0)) > 1e-6) AS violations,
       {money('value')} AS value, {half_up(credit('credited'), 4)} AS credited
FROM per_conversion GROUP BY attribution_model""",
    "attr_by_date": f"""{ALL}
SELECT attribution_model, channel, {day('CAST(conversion_ts AS DATE)')} AS event_date,
       {half_up(f"COALESCE({credit('credit')}, 0.0)", 4)} AS credit
FROM credits GROUP BY attribution_model, channel, CAST(conversion_ts AS DATE)""",
    "attr_roas": f"""{TOUCHED}, {CHANNEL_CREDIT}, spent AS (
  SELECT channel, {money('impression_cost')} AS spend FROM impressions GROUP BY channel
), models AS (
  SELECT unnest(['last_touch', 'first_touch', 'linear', 'time_decay']) AS attribution_model
)
SELECT m.attribution_model, s.channel, {half_up('COALESCE(x.credit, 0.0)', 4)} AS attributed_revenue, spend,
       {half_up("CASE WHEN spend > 0 THEN COALESCE(x.credit, 0.0) / spend ELSE 0.0 END", 4)} AS attributed_roas
FROM spent s CROSS JOIN models m
LEFT JOIN channel_credit x ON x.channel = s.channel AND x.attribution_model = m.attribution_model""",
    "campaign_performance": f"""{CAMPAIGN}
SELECT campaign_id, channel, spend, impressions, clicks, conversions, revenue, days_active,
       {half_up('cpm', 2)} AS cpm, {half_up('ctr * 100', 2)} AS ctr, {half_up('cpc', 2)} AS cpc,
       {half_up('cpa', 2)} AS cpa, {half_up('roas', 2)} AS roas, {half_up('cvr * 100', 2)} AS cvr,
       {half_up('aov', 2)} AS aov FROM campaigns""",
    "campaigns_above_minimum_spend": f"""{CAMPAIGN}
SELECT campaign_id, channel, spend, roas FROM campaigns WHERE spend >= 11000.0""",
    "performance_tiers": f"{TIERED}\nSELECT campaign_id, channel, roas, tier FROM tiered",
    "top_campaigns": f"""{CAMPAIGN}
SELECT campaign_id, channel, roas, spend FROM campaigns ORDER BY roas DESC, campaign_id LIMIT 3""",
    "opp_high_cpa": high_cpa(CAMPAIGN),
    "opp_low_ctr": low_ctr(CAMPAIGN),
    "opp_high_spend_low_roi": f"""{CAMPAIGN}, m AS (SELECT {upper_median('roas')} AS median)
SELECT campaign_id, {half_up('spend', 2)} AS spend, {half_up('roas', 2)} AS roas,
       'Consider pausing or significantly optimizing' AS recommendation
FROM campaigns, m WHERE roas < median * 0.8 AND spend > 4000""",
    "opp_channel_winners": f"""{CAMPAIGN}
SELECT channel, {half_up("CAST(sum(CAST(roas AS DECIMAL(28,12))) AS DOUBLE) / count(*)", 2)} AS avg_roas,
       count(*) AS num_campaigns FROM campaigns GROUP BY channel""",
    "opp_scaling": scaling(CAMPAIGN),
    "opp_daily_high_spend_low_roi": f"""{DAILY_CAMPAIGN}, m AS (SELECT {upper_median('roas')} AS median)
SELECT campaign_id, {half_up('spend', 2)} AS spend, {half_up('roas', 2)} AS roas,
       'Consider pausing or significantly optimizing' AS recommendation
FROM campaigns, m WHERE roas < median * 0.8 AND spend > 200""",
    "opp_daily_high_cpa": high_cpa(DAILY_CAMPAIGN),
    "opp_daily_low_ctr": low_ctr(DAILY_CAMPAIGN),
    "opp_daily_scaling": scaling(DAILY_CAMPAIGN),
    "budget_allocation": f"""{allocated('spend_sum')}
SELECT campaign_id, channel, {half_up('allocation', 2)} AS recommended_budget, {half_up('spend', 2)} AS current_budget,
       {half_up('CASE WHEN spend > 0 THEN (allocation - spend) / spend END * 100', 1)} AS change_pct,
       {half_up('roas', 2)} AS expected_roas FROM allocated""",
    "budget_allocation_clamped": f"""{allocated('200000.0')}, clamped AS (
  SELECT *, CASE WHEN spend > 0 THEN greatest(least(allocation, spend * 2.0), spend * 0.5) ELSE allocation END
            AS clamped_allocation FROM allocated
)
SELECT campaign_id, channel, {half_up('spend', 2)} AS spend, {half_up('allocation', 2)} AS allocation,
       {half_up('clamped_allocation', 2)} AS clamped_allocation,
       {half_up('allocation - clamped_allocation', 2)} AS unallocated FROM clamped""",
    "budget_allocation_cut": f"""{allocated('500.0')}, clamped AS (
  SELECT *, CASE WHEN spend > 0 THEN greatest(least(allocation, spend * 2.0), spend * 0.5) ELSE allocation END
            AS clamped_allocation FROM allocated
)
SELECT campaign_id, channel, {half_up('spend', 2)} AS spend, {half_up('allocation', 2)} AS allocation,
       {half_up('clamped_allocation', 2)} AS clamped_allocation,
       {half_up('allocation - clamped_allocation', 2)} AS unallocated FROM clamped""",
    "budget_by_tier": f"""{TIERED}, sized AS (
  SELECT *, count(*) OVER (PARTITION BY tier) AS tier_size,
         CASE tier WHEN 'top_performers' THEN 0.5 WHEN 'mid_performers' THEN 0.3 ELSE 0.2 END::DOUBLE AS share FROM tiered
), totals AS (
  SELECT (SELECT sum(share) FROM (SELECT DISTINCT tier, share FROM sized)) AS share_sum,
         (SELECT {money('spend')} FROM campaigns) AS budget
), allotted AS (
  SELECT sized.*, budget * (share / share_sum) / tier_size AS allocation FROM sized, totals
)
SELECT campaign_id, tier, tier_size, {half_up('allocation', 2)} AS allocation,
       {half_up('CASE WHEN spend > 0 THEN (allocation - spend) / spend END * 100', 1)} AS change_pct FROM allotted""",
    "projected_volume": f"""{CAMPAIGN}
SELECT campaign_id, channel, impressions, ctr, cvr, {half_up('impressions * ctr * cvr', 6)} AS projected_volume
FROM campaigns""",
    "ab_test_summary": f"""{ANALYZED}
SELECT experiment_id, control_visitors, control_conversions, variant_visitors, variant_conversions, control_rate,
       variant_rate, absolute_lift, relative_lift, z_score, {half_up('p_value', 6)} AS p_value, is_significant,
       ci_lower, ci_upper FROM analyzed""",
    "ab_test_interpretation": f"""{ANALYZED}
SELECT experiment_id, control_visitors, control_conversions, {half_up('control_rate * 100', 3)} AS control_rate_pct,
       variant_visitors, variant_conversions, {half_up('variant_rate * 100', 3)} AS variant_rate_pct,
       {half_up('absolute_lift * 100', 3)} AS absolute_lift_pct, {half_up('relative_lift * 100', 2)} AS relative_lift_pct,
       {half_up('z_score', 3)} AS z_score, {half_up('p_value', 4)} AS p_value, is_significant,
       {half_up('ci_lower * 100', 3)} AS ci_lower_pct, {half_up('ci_upper * 100', 3)} AS ci_upper_pct,
       {INTERPRETATION} AS interpretation FROM analyzed""",
    "ab_test_significant": f"""{ANALYZED.replace(
        "FROM log WHERE event_type IN ('view', 'purchase')",
        "FROM (SELECT * REPLACE (CASE WHEN event_type = 'purchase' AND value <= 120"
        " AND (CAST(user_id AS BIGINT) + (k % 4) // 2) % 2 = 0 THEN 'none' ELSE event_type END AS event_type) FROM log)"
        " WHERE event_type IN ('view', 'purchase')")}
SELECT experiment_id, control_visitors, control_conversions, variant_visitors, variant_conversions, control_rate,
       variant_rate, absolute_lift, relative_lift, z_score, {half_up('p_value', 6)} AS p_value, is_significant,
       ci_lower, ci_upper FROM analyzed""",
    "ab_sample_size": f"""{BASELINES}, effects AS (
  SELECT 'low' AS traffic_tier, 0.20::DOUBLE AS mde UNION ALL SELECT 'medium', 0.15 UNION ALL SELECT 'high', 0.10
)
SELECT experiment_id, baseline_rate, traffic_tier, mde, {sample_size('baseline_rate', 'mde')} AS sample_size_per_arm
FROM baselines, effects""",
    "ab_duration": f"""{BASELINES}, visitors AS (
  SELECT experiment_id, sum(n)::DOUBLE / count(*) AS daily_visitors FROM (
    SELECT experiment_id, day, count(*) AS n FROM units GROUP BY experiment_id, day) GROUP BY experiment_id
), cuts AS (
  SELECT list_sort(list(daily_visitors)) AS v, count(*) AS n FROM visitors
), tiered AS (
  SELECT experiment_id, daily_visitors,
         CASE WHEN daily_visitors <= v[CAST(ceil(n / 3.0) AS BIGINT)] THEN 'low'
              WHEN daily_visitors <= v[CAST(ceil(n * 2 / 3.0) AS BIGINT)] THEN 'medium' ELSE 'high' END AS traffic_tier
  FROM visitors, cuts
), sized AS (
  SELECT *, CASE traffic_tier WHEN 'low' THEN 0.20 WHEN 'medium' THEN 0.15 ELSE 0.10 END::DOUBLE AS mde
  FROM baselines JOIN tiered USING (experiment_id)
)
SELECT *, {sample_size('baseline_rate', 'mde')} AS sample_size_per_arm,
       CAST({sample_size('baseline_rate', 'mde')} AS DOUBLE) / (daily_visitors * 0.5::DOUBLE) AS days_required FROM sized""",
    "dq_range_rules": f"{MART}\n" + union([
        range_row("cpm", 0.0, 100.0), range_row("ctr", 0.0, 1.0), range_row("roas", 0.0, 1000.0)]),
    "dq_outliers": f"""{MART}, stats AS (
  SELECT channel, avg(spend) AS mean, stddev_pop(spend) AS sd FROM mart GROUP BY channel
), scored AS (
  SELECT mart.*, CASE WHEN sd > 0 THEN (spend - mean) / sd ELSE 0.0 END AS z FROM mart JOIN stats USING (channel)
)
SELECT campaign_id, channel, {day('event_date')} AS event_date, spend, {half_up('z', 4)} AS z, abs(z) > 3.0 AS is_outlier
FROM scored""",
    "dq_missing": f"""WITH {LOG}, {RAW}, counted AS (
{union([missing_row(c) for c in ("impression_id", "user_id", "campaign_id", "event_timestamp", "impression_cost", "is_bot", "device_type")])}
)
SELECT *, missing::DOUBLE / "rows" AS missing_share, missing::DOUBLE / "rows" <= 0.05 AS within_tolerance FROM counted""",
    "dq_freshness": f"""WITH {LOG}, {RAW}, newest AS (
{union([freshness_row("impressions", "raw_impressions"), freshness_row("clicks", "clicks"), freshness_row("conversions", "raw_conversions")])}
)
SELECT source, {instant('newest')} AS newest, staleness_hours, staleness_hours > 24 AS is_stale,
       staleness_hours > 6 AS alert FROM newest""",
    "dq_freshness_stale": f"""WITH {LOG}, {RAW}, newest AS (
{freshness_row("impressions", "raw_impressions").replace(NOW, "TIMESTAMP '2024-02-03 00:00:00'")}
)
SELECT source, {instant('newest')} AS newest, staleness_hours, staleness_hours > 24 AS is_stale,
       staleness_hours > 6 AS alert FROM newest""",
    "stg_impressions_within": f"""{WITHIN}
SELECT impression_id, {instant('event_timestamp')} AS event_timestamp, impression_cost FROM impressions""",
    "stg_conversions_within": f"""{WITHIN}
SELECT conversion_id, {instant('event_timestamp')} AS event_timestamp, conversion_value_usd FROM conversions""",
    "dq_spend_anomaly": f"""{MART}, daily AS (
  SELECT campaign_id, event_date, {money('spend')} AS spend FROM mart GROUP BY campaign_id, event_date
), averaged AS (
  SELECT *, CAST(sum(CAST(spend AS DECIMAL(18,6))) OVER w AS DOUBLE) / count(spend) OVER w AS average_spend FROM daily
  WINDOW w AS (PARTITION BY campaign_id ORDER BY event_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
)
SELECT campaign_id, {day('event_date')} AS event_date, spend, average_spend, spend < average_spend * 0.8::DOUBLE AS is_anomaly
FROM averaged""",
    "dq_error_rate": f"""WITH {LOG}, {RAW}, requests AS (
  SELECT CAST(event_timestamp AS DATE) AS d, 0 AS e FROM raw_impressions
  UNION ALL SELECT CAST(event_timestamp AS DATE), 1 FROM unfilled
)
SELECT {day('d')} AS event_date, count(*) AS requests, CAST(sum(e) AS BIGINT) AS errors,
       sum(e)::DOUBLE / count(*) AS error_rate, sum(e)::DOUBLE / count(*) > 0.05 AS alert FROM requests GROUP BY d""",
    "dq_zero_conversion_spend": f"""{MART}
SELECT campaign_id, {day('event_date')} AS event_date, spend, conversions FROM mart WHERE spend > 0 AND conversions = 0""",
    "dq_zero_conversion_spend_large": f"""{MART.replace(
        "FROM conversions GROUP BY ALL", "FROM conversions WHERE conversion_value_usd > 150 GROUP BY ALL")}
SELECT campaign_id, {day('event_date')} AS event_date, spend, conversions FROM mart WHERE spend > 0 AND conversions = 0""",
    "dq_identities": f"{MART}\n" + union([
        identity_row("cpc_from_cpm_ctr", "clicks > 0 AND spend > 0", "cpc", "cpm / (ctr * 1000)"),
        identity_row("roas_from_aov_cpa", "conversions > 0 AND spend > 0", "roas", "aov / cpa"),
        identity_row("cpa_from_cpc_cvr", "conversions > 0 AND clicks > 0", "cpa", "cpc / cvr")]),
    "dq_unplaced_revenue": f"""{MART}
SELECT campaign_id, {day('event_date')} AS event_date, conversions, COALESCE(revenue, 0.0) AS revenue
FROM v ANTI JOIN mart USING (campaign_id, event_date)""",
    "dq_invalid_reasons": f"{BASE}\n" + union([
        reason_row("lacks_value", "lacks_value"), reason_row("lacks_timestamp", "lacks_timestamp"),
        reason_row("lacks_user", "lacks_user"),
        reason_row("is_invalid_record", "lacks_value OR lacks_timestamp OR lacks_user"),
        reason_row("lacks_id", "conversion_id IS NULL")]),
    "sink_roundtrip": f"{MART}\nSELECT * REPLACE ({day('event_date')} AS event_date) FROM mart",
    "sink_refresh": REFRESHED,
    "sink_catalog_refresh": REFRESHED,
    "sink_second_day": f"""{BASE}
SELECT impression_id, campaign_id, {day('CAST(event_timestamp AS DATE)')} AS event_date FROM impressions
WHERE event_timestamp >= TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY""",
    "sink_daily_run": f"""{ALL}, {mart_ctes("event_date", "CAST(event_timestamp AS DATE)")}, {CAMPAIGN_CTE}, touched AS (
  SELECT * FROM credits WHERE journey_touches > 0
), by_channel AS (
  SELECT attribution_model, channel, {credit('credit')} AS credit FROM touched GROUP BY attribution_model, channel
)
SELECT 'stg_impressions' AS name, (SELECT count(*) FROM impressions) AS "rows"
UNION ALL SELECT 'stg_conversions', (SELECT count(*) FROM conversions)
UNION ALL SELECT 'clicks', (SELECT count(*) FROM clicks)
UNION ALL SELECT 'mart_campaign_metrics', (SELECT count(*) FROM mart)
UNION ALL SELECT 'credit_shares', (SELECT count(*) FROM shares)
UNION ALL SELECT 'mart_attribution_summary',
  (SELECT count(*) FROM (SELECT DISTINCT attribution_model, channel, campaign_id FROM credits))
UNION ALL SELECT 'credit_breakdowns', (SELECT count(*) FROM by_channel) + 4
  + (SELECT count(*) FROM (SELECT DISTINCT attribution_model, campaign_id FROM touched))
UNION ALL SELECT 'model_comparison', 4
UNION ALL SELECT 'channel_consensus', (SELECT count(DISTINCT channel) FROM (
  SELECT channel, row_number() OVER (PARTITION BY attribution_model ORDER BY credit DESC, channel) AS place
  FROM by_channel) WHERE place <= 2)
UNION ALL SELECT 'channel_divergence', (SELECT count(DISTINCT channel) FROM touched)
UNION ALL SELECT 'performance_tiers', (SELECT count(*) FROM campaigns)
UNION ALL SELECT 'budget_allocation', (SELECT count(*) FROM campaigns)
UNION ALL SELECT 'range_checks', (SELECT 3 * count(*) FROM mart)
UNION ALL SELECT 'revenue_conservation', 4""",
    "sink_incremental": f"""{ALL}, {mart_ctes("event_date", "CAST(event_timestamp AS DATE)")}
SELECT 'mart' AS part, campaign_id, channel, {day('event_date')} AS event_date, impressions AS "rows", unique_users AS users,
       clicks, conversions, spend AS amount, revenue, NULL AS last_touch, NULL AS first_touch, NULL AS linear,
       NULL AS time_decay FROM mart
UNION ALL
SELECT 'credit', campaign_id, channel, {day('CAST(conversion_ts AS DATE)')}, count(*), count(DISTINCT user_id), NULL,
       count(DISTINCT conversion_id), {money('value')}, NULL, {credit('last_touch')}, {credit('first_touch')},
       {credit('linear')}, {half_up("SUM(CAST(time_decay AS DECIMAL(28,10)))", 4)}
FROM shares GROUP BY campaign_id, channel, CAST(conversion_ts AS DATE)""",
    "sink_user_tables": f"""{ALL}
SELECT conversion_id, user_id, channel, campaign_id, n_touches, journey_touches, last_touch, first_touch,
       {half_up('linear', 6)} AS linear, {half_up('time_decay', 6)} AS time_decay FROM shares""",
    "sink_checked_days": f"""{MART}
SELECT campaign_id, channel, {day('event_date')} AS event_date, impressions, spend, roas, 'spend_out_of_range' AS refused_for
FROM mart""",
    "sink_csv_source": f"""{BASE}
SELECT impression_id, {instant('event_timestamp')} AS event_timestamp, user_id, campaign_id, campaign_name, channel,
       impression_cost, device_type FROM impressions""",
    "sink_campaign_documents": f"""{allocated('spend_sum')}, tiered AS (
  SELECT campaign_id, CASE WHEN place <= 2 THEN 'top_performers' WHEN place <= 5 THEN 'mid_performers'
                 ELSE 'underperformers' END AS tier
  FROM (SELECT *, row_number() OVER (ORDER BY roas DESC, campaign_id, channel) AS place FROM campaigns)
)
SELECT campaign_id, channel, spend, {half_up('ctr * 100', 2)} AS ctr, {half_up('roas', 2)} AS roas, tier,
       {half_up('allocation', 2)} AS recommended_budget,
       {half_up('CASE WHEN spend > 0 THEN (allocation - spend) / spend END * 100', 1)} AS change_pct
FROM allocated JOIN tiered USING (campaign_id)""",
    "sink_channel_documents": f"""{TOUCHED}, {CHANNEL_CREDIT}
SELECT channel, {model_credit('last_touch')}, {model_credit('first_touch')}, {model_credit('linear')},
       {model_credit('time_decay')} FROM channel_credit GROUP BY channel""",
    "sink_model_documents": f"""{TOUCHED}, by_channel AS (
  SELECT attribution_model, channel AS name, {credit('credit')} AS exact FROM credits GROUP BY attribution_model, channel
), by_campaign AS (
  SELECT attribution_model, campaign_id AS name, {credit('credit')} AS exact FROM credits GROUP BY attribution_model, campaign_id
), totals AS (
  SELECT attribution_model, {half_up(credit('exact'), 4)} AS total_attributed_revenue,
         first(name ORDER BY exact DESC, name) AS top_channel, (SELECT count(*) FROM conversions) AS conversion_count
  FROM by_channel GROUP BY attribution_model
), entries AS (
  SELECT 'channel' AS breakdown, *, {half_up('exact', 4)} AS credit FROM by_channel
  UNION ALL SELECT 'campaign', *, {half_up('exact', 4)} FROM by_campaign
)
SELECT attribution_model, total_attributed_revenue, top_channel, conversion_count, breakdown,
       row_number() OVER (PARTITION BY attribution_model, breakdown ORDER BY credit DESC, name)::INTEGER AS place, name, credit
FROM entries JOIN totals USING (attribution_model)""",
    "sink_opportunity_documents": f"""{DAILY_CAMPAIGN}, findings AS (
  SELECT 'high_cpa_campaigns' AS opportunity, campaign_id AS subject, recommendation, 'current_cpa' AS figure, current_cpa AS value
  FROM ({high_cpa("WITH none AS (SELECT 1)").removeprefix("WITH none AS (SELECT 1), ").replace("m AS (", "WITH m AS (", 1)})
  UNION ALL SELECT 'high_cpa_campaigns', campaign_id, recommendation, 'median_cpa', median_cpa
  FROM ({high_cpa("WITH none AS (SELECT 1)").removeprefix("WITH none AS (SELECT 1), ").replace("m AS (", "WITH m AS (", 1)})
  UNION ALL SELECT 'low_ctr_campaigns', campaign_id, recommendation, unnest(['current_ctr', 'median_ctr']), unnest([current_ctr, median_ctr])
  FROM ({low_ctr("WITH none AS (SELECT 1)").removeprefix("WITH none AS (SELECT 1), ").replace("m AS (", "WITH m AS (", 1)})
  UNION ALL SELECT 'scaling_candidates', campaign_id, NULL,
    unnest(['current_roas', 'current_spend', 'potential_10pct_increase_revenue']),
    unnest([current_roas, current_spend, potential_10pct_increase_revenue])
  FROM ({scaling("WITH none AS (SELECT 1)").removeprefix("WITH none AS (SELECT 1), ").replace("m AS (", "WITH m AS (", 1)})
  UNION ALL SELECT 'high_spend_low_roi', campaign_id, 'Consider pausing or significantly optimizing', unnest(['spend', 'roas']),
    unnest([{half_up('spend', 2)}, {half_up('roas', 2)}])
  FROM campaigns WHERE roas < {upper_median('roas')} * 0.8 AND spend > 200
  UNION ALL SELECT 'channel_winners', channel, NULL, unnest(['avg_roas', 'num_campaigns']), unnest([avg_roas, num_campaigns])
  FROM (SELECT channel, {half_up("CAST(sum(CAST(roas AS DECIMAL(28,10))) AS DOUBLE) / count(*)", 2)} AS avg_roas,
               count(*)::DOUBLE AS num_campaigns FROM campaigns GROUP BY channel)
)
SELECT opportunity, dense_rank() OVER (PARTITION BY opportunity ORDER BY subject)::INTEGER AS place, subject,
       recommendation, figure, value FROM findings""",
    "sink_raw_sources": f"{MART}\nSELECT * REPLACE ({day('event_date')} AS event_date) FROM mart",
    "sink_experiment_documents": f"""{ANALYZED}
SELECT experiment_id, {half_up('control_rate * 100', 3)} AS control_rate,
       {half_up('variant_rate * 100', 3)} AS variant_rate, {half_up('z_score', 3)} AS z_score,
       {half_up('p_value', 4)} AS p_value, {INTERPRETATION} AS interpretation FROM analyzed""",
    "stream_dedup": f"""WITH {LOG}
SELECT event_id, {instant('ts')} AS event_timestamp, user_id, event_type, value, k FROM log""",
    "stream_latest_version": LATEST_EVENTS,
    "stream_daily_metrics": f"""{MART}
SELECT campaign_id, campaign_name, channel, {day('event_date')} AS event_date, impressions, spend FROM i""",
    "stream_attribution": f"""{ALL}
SELECT conversion_id, channel, campaign_id, n_touches, last_touch, first_touch, linear,
       {half_up('time_decay', 6)} AS time_decay FROM shares""",
    "stream_corrected_attribution": f"""{ALL}
SELECT conversion_id, channel, campaign_id, n_touches, last_touch, first_touch, linear,
       {half_up('time_decay', 6)} AS time_decay FROM shares""",
    "stream_campaign_mart": f"{MART}\nSELECT * REPLACE ({day('event_date')} AS event_date) FROM mart",
    "stream_late": f"""{BASE}, newest AS (
  SELECT CAST(impression_id AS BIGINT) % 3 AS delivery, max(event_timestamp) AS newest FROM raw_impressions GROUP BY ALL
), late AS (
  SELECT CAST(event_timestamp AS DATE) AS d, count(*) AS late_rows FROM raw_impressions r
  WHERE event_timestamp < (SELECT max(newest) FROM newest WHERE delivery < CAST(impression_id AS BIGINT) % 3) - INTERVAL 72 HOUR
  GROUP BY ALL
)
SELECT {day('CAST(event_timestamp AS DATE)')} AS event_date, count(*) AS impressions, {money('impression_cost')} AS spend,
       COALESCE(any_value(late_rows), 0) AS late_rows
FROM impressions LEFT JOIN late ON d = CAST(event_timestamp AS DATE) GROUP BY CAST(event_timestamp AS DATE)""",
    "stream_touch_pairs": f"""{BASE}
SELECT c.conversion_id, count(i.impression_id) AS n_touches, {instant('min(i.event_timestamp)')} AS first_ts,
       {instant('max(i.event_timestamp)')} AS last_ts
FROM raw_conversions c LEFT JOIN impressions i ON c.user_id = i.user_id AND i.event_timestamp <= c.event_timestamp
 AND i.event_timestamp >= c.event_timestamp - INTERVAL 28 DAY
GROUP BY c.conversion_id""",
    "stream_freshness": f"""WITH {LOG}, {RAW}, newest AS (
{freshness_row("impressions", "raw_impressions")}
)
SELECT source, {instant('newest')} AS newest, staleness_hours, staleness_hours > 24 AS is_stale,
       staleness_hours > 6 AS alert FROM newest""",
}


def contents(name: str, keys: dict, amounts: dict, query: str | None = None) -> str:
    """Rows of another query in the form of `sink_daily_contents`."""
    named = [f"CAST({keys.get(k, 'NULL')} AS VARCHAR) AS {k}" for k in ("model", "channel", "campaign", "day")]
    sums = [f"{half_up(amounts[a], 4) if a in amounts else 'NULL::DOUBLE'} AS {a}" for a in ("first", "second", "third")]
    return f"SELECT '{name}' AS name, {', '.join(named + sums)} FROM ({ORACLE[query or name]})"


_MODEL, _KEY = {"model": "attribution_model"}, {"channel": "channel", "campaign": "campaign_id"}
ORACLE["sink_daily_contents"] = "\nUNION ALL\n".join([
    contents("mart_campaign_metrics", {**_KEY, "day": "event_date"}, {"first": "spend", "second": "revenue", "third": "roas"}),
    contents("mart_attribution_summary", {**_MODEL, **_KEY}, {
        "first": "attributed_revenue", "second": "avg_order_value", "third": "median_order_value"}),
    contents("credit_breakdowns", {**_MODEL, "channel": "channel"}, {"first": "credit"}, "attr_channel_breakdown"),
    contents("credit_breakdowns", {**_MODEL, "campaign": "campaign_id"}, {"first": "credit"}, "attr_campaign_breakdown"),
    contents("channel_divergence", {"channel": "channel"}, {"first": "min_credit", "second": "max_credit"}, "attr_divergence"),
    contents("model_comparison", {**_MODEL, "channel": "top_channel"}, {"first": "total_revenue"}, "attr_model_comparison"),
    contents("channel_consensus", {"channel": "channel"}, {"first": "appears_in_top_2"}, "attr_consensus"),
    contents("performance_tiers", {"model": "tier", **_KEY}, {"first": "roas"}),
    contents("budget_allocation", _KEY, {"first": "recommended_budget", "second": "current_budget"}),
    contents("revenue_conservation", _MODEL, {"first": "value", "second": "credited", "third": "violations"},
             "attr_revenue_conservation"),
])
