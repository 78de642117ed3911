"""Small tables for tests, as rows of the raw or staged schemas."""

from datetime import datetime, timedelta

from touchline.params import Params
from touchline.sources.schemas import CLICKS, CONVERSIONS, IMPRESSIONS

P = Params(as_of="2024-01-31 00:00:00")


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _frame(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def impressions(spark, rows):
    """Rows given as dicts; what is left out is filled with a plain valid value."""
    filled = []
    for n, row in enumerate(rows):
        base = {
            "impression_id": f"i{n:06d}", "user_id": "u1", "campaign_id": "camp", "campaign_name": "Camp",
            "channel": "Search", "event_timestamp": at("2024-01-20 08:00:00"), "impression_cost": 1.0,
            "device_type": "mobile", "is_bot": False,
        }
        base.update(row)
        base.setdefault("_synced_at", base["event_timestamp"])
        filled.append(base)
    return _frame(spark, IMPRESSIONS, filled)


def conversions(spark, rows):
    filled = []
    for n, row in enumerate(rows):
        base = {
            "conversion_id": f"c{n:06d}", "user_id": "u1", "campaign_id": "camp",
            "event_timestamp": at("2024-01-20 10:00:00"), "conversion_value": 100.0,
            "conversion_value_usd": 100.0, "conversion_type": "purchase",
        }
        base.update(row)
        base.setdefault("_synced_at", base["event_timestamp"])
        filled.append(base)
    return _frame(spark, CONVERSIONS, filled)


def clicks(spark, rows):
    base = {"click_id": "k", "campaign_id": "camp", "user_id": "u1", "event_timestamp": at("2024-01-20 09:00:00")}
    return _frame(spark, CLICKS, [{**base, **r} for r in rows])


def window_brute_force(convs, touches, window_days=28, half_life=7.0):
    """All four models by pairing every conversion with its touches, in plain Python.

    `convs`: (id, user, time, value). `touches`: (id, user, time, channel, campaign).
    Returns {(conversion, model): {(channel, campaign): credit}}.
    """
    out = {}
    for cid, user, time, value in convs:
        mine = sorted(
            (t for t in touches if t[1] == user and time - timedelta(days=window_days) <= t[2] <= time),
            key=lambda t: (t[2], t[0]),
        )
        for model in ("last_touch", "first_touch", "linear", "time_decay"):
            out[cid, model] = {}
        if not mine:
            continue
        key = lambda t: (t[3], t[4])
        out[cid, "last_touch"] = {key(mine[-1]): value}
        out[cid, "first_touch"] = {key(mine[0]): value}
        weights = [2 ** (-((time - t[2]).total_seconds() / 86400) / half_life) for t in mine]
        for t, w in zip(mine, weights):
            for model, part in (("linear", 1 / len(mine)), ("time_decay", w / sum(weights))):
                shares = out[cid, model]
                shares[key(t)] = shares.get(key(t), 0.0) + value * part
    return out
