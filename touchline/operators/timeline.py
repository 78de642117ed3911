"""What a conversion's look-back window holds, without pairing it with its touches.

Joining conversions to touches on the user makes (conversions x touches) rows
per user: quadratic, and all in one task for a user that owns much of the data.
Here both are put on one time line and running totals answer the question.

A user's time is cut in blocks as long as the window, so a window ending at t
covers the head of the block t is in and the tail of the block before. Totals
run forward through the first and backward through the second, and the window
is their sum: nothing is subtracted, so nothing cancels. Mirroring time for the
backward pass makes both the same running total, in one shuffle.

Blocks are cut further in short tiles. Totals run inside each tile, and tile
sums, at most window/tile of them per block, carry over from tile to tile. Work
is spread by (user, block, key, tile), so the largest thing a task can meet is
one user's touches within one tile. With `hot_tile_rows`, tiles that hold more
are found by counting and cut at the quantiles of their times, so that a user
with much of the data inside one hour is spread as well (`cut_hot_tiles`);
touches of one instant, which no cut can part, are added up before.

Tiles cost a second shuffle and a join, and most users have a row or two in each. So only a user's
blocks of more than `FEW` rows are cut in tiles; in all others totals run through the whole block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalars import MICROS_PER_DAY, MICROS_PER_MINUTE, floor_div
from touchline.params import Params

_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}
_WINDOW_TOTALS = {"n_touches": "sum", "weight": "sum", "first_touch": "min", "last_touch": "max"}
# Stands for NULL in a key, so that keys join and shuffle as plain columns.
_NO_VALUE = "\x00"


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind == "min":
        return F.least(before, here)
    if kind == "max":
        return F.greatest(before, here)
    return F.coalesce(before + here, before, here)


#: Up to so many touches and windows, a user's block is one task's work.
FEW = 50_000


def crowded_blocks(pairs: Sequence[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """user_id, block with more than `FEW` touches and window ends: a small table whatever the data."""
    cell = ["user_id", "block"]
    counts = [rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")) for pair in pairs for rows in pair]
    return reduce(DataFrame.unionByName, counts).groupBy(*cell).agg(F.sum("_n").alias("_n")).where(
        F.col("_n") > FEW
    ).select(*cell)


#: Parts of a hot tile, and how many hot tiles there can be: none has less than this share of all rows,
#: so the table of their cuts is small whatever the data.
CUTS = 64
MOST_HOT = 1000


def cut_hot_tiles(rows: DataFrame, touches: DataFrame, p: Params, key: Sequence[str] = ("user_id", "side")) -> DataFrame:
    """`rows` with the tiles cut in which `touches` are many; both have `key`, `tile` and `position`.

    A hot tile has more than `hot_tile_rows` touches and more than 1 / MOST_HOT of all. It is cut at
    `CUTS` - 1 quantiles of its touches' positions; rows at one position stay together. Tiles are
    renumbered so that they still never decrease along the time line.
    """
    if p.hot_tile_rows is None:
        return rows
    cell = [*key, "tile"]
    least = F.greatest(
        F.lit(p.hot_tile_rows).cast("double"), touches.agg(F.count(F.lit(1)) / F.lit(float(MOST_HOT))).scalar()
    )
    hot = touches.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(*cell)
    fractions = F.array(*[F.lit(n / CUTS) for n in range(1, CUTS)])
    cuts = touches.join(F.broadcast(hot), cell, "left_semi").groupBy(*cell).agg(
        F.percentile_approx("position", fractions, F.lit(10_000)).alias("_cuts")
    )
    before = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")), lambda c: c < F.col("position")))
    return rows.join(F.broadcast(cuts), cell, "left").withColumn("tile", F.col("tile") * CUTS + before).drop("_cuts")


def running_totals(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, tuple[str, Column]],
    keep: Column,
    crowded: DataFrame | None = None,
) -> DataFrame:
    """Add running totals to the rows of `keep`.

    `totals` maps a new column to "sum", "min" or "max" and what to add up,
    worked out after the shuffle so that it is not shuffled. `rows` has a `tile`
    column that never decreases along `order` within a group. Group columns are
    not NULL; `order` is a total order. Tile sums are the running totals of each
    tile's last row, so they come out of the same shuffle, and the rows are not
    moved again to meet what carries over from earlier tiles. With `crowded`, some of the group
    columns, only the groups in it are cut in tiles.
    """
    if crowded is not None:
        on, crowded = crowded.columns, F.broadcast(crowded)
        whole = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        few = rows.where(F.col("tile").isNotNull()).join(crowded, on, "left_anti").repartition(*group).select(
            *rows.columns, *[_AGGREGATE[kind](what).over(whole).alias(c) for c, (kind, what) in totals.items()]
        ).where(keep)
        return few.unionByName(running_totals(rows.join(crowded, on, "left_semi"), group, order, totals, keep))
    cell = [*group, "tile"]
    # The filter is said here once, or the optimizer infers it for one use of the
    # rows only and the two uses no longer share their shuffle. The shuffle is
    # asked for, or rows that a join has left partitioned by user would stay so.
    rows = rows.where(F.col("tile").isNotNull()).repartition(*cell)
    along = W.partitionBy(*cell).orderBy(*order)
    within = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*group).orderBy("tile").rowsBetween(W.unboundedPreceding, -1)

    inside = rows.select(
        *rows.columns,
        *[_AGGREGATE[kind](what).over(within).alias(c) for c, (kind, what) in totals.items()],
        F.lead(F.lit(1)).over(along).isNull().alias("_is_last"),
    )
    carried = inside.where("_is_last").select(
        *cell,
        *[_AGGREGATE[kind](c).over(earlier).alias(f"{c}_before") for c, (kind, _) in totals.items()],
    )
    return inside.where(keep).join(carried, cell).select(
        *rows.columns,
        *[_merge(kind, F.col(f"{c}_before"), F.col(c)).alias(c) for c, (kind, _) in totals.items()],
    )


def place_touches(touches: DataFrame, p: Params) -> DataFrame:
    """Touches of known users with `block`, the stretch of a window's length they are in."""
    window = p.attribution_window_days * MICROS_PER_DAY
    return touches.where(F.col("user_id").isNotNull()).withColumn(
        "block", floor_div(F.unix_micros("event_timestamp"), window)
    )


def place_windows(conversions: DataFrame, p: Params) -> DataFrame:
    """Both ends of each conversion's window: user_id, block, side, conversion_id, position."""
    window = p.attribution_window_days * MICROS_PER_DAY
    return (
        conversions.where(F.col("user_id").isNotNull())
        .select("user_id", "conversion_id", F.unix_micros("conversion_ts").alias("_end"))
        # side 1: the block a window ends in; side -1: the block it starts in.
        .withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
        .withColumn("at", F.col("_end") - F.when(F.col("side") == -1, window).otherwise(0))
        .select(
            "user_id", floor_div("at", window).alias("block"), "side", "conversion_id",
            (F.col("side") * F.col("at")).alias("position"),
        )
    )


def window_totals(
    conversions: DataFrame, touches: DataFrame, p: Params, by: Sequence[str] = (),
    touch_fields: Sequence[str] = (), keep_unmatched: bool = False,
) -> DataFrame:
    """Per conversion and value of `by`, what its window holds:

    n_touches, weight (sum of 2^(-age / half life), on a scale common to the
    conversion), first_touch and last_touch as structs (ts_us, impression_id,
    *touch_fields), and journey_touches, the conversion's n_touches in all.
    Touches tie on time by impression id. Both window ends are inclusive. A
    conversion without touches has no row, or with `keep_unmatched` one with
    n_touches = 0 and NULL `by` values.

    `conversions` has conversion_id (unique), user_id, conversion_ts and any
    other columns, which are kept. `touches` has impression_id, user_id,
    event_timestamp, the `by` columns (text) and `touch_fields`.
    """
    pair = place_windows(conversions, p), place_touches(touches, p)
    return placed_window_totals(conversions, [pair], p, by, touch_fields, keep_unmatched)


def placed_window_totals(
    conversions: DataFrame, pairs: Sequence[tuple[DataFrame, DataFrame]], p: Params, by: Sequence[str] = (),
    touch_fields: Sequence[str] = (), keep_unmatched: bool = False,
) -> DataFrame:
    """`window_totals` of windows and touches that are placed already, as pairs of `place_windows` and
    `place_touches`, of which no two share a user's block. Tables laid out by user and block are
    joined as they lie."""
    by = list(by)
    window = p.attribution_window_days * MICROS_PER_DAY
    tile = p.tile_minutes * MICROS_PER_MINUTE
    half_life = p.half_life_days * MICROS_PER_DAY

    # Where hot tiles are to be cut, touches of one instant are added up first: nothing else can part them.
    merged = p.hot_tile_rows is not None
    lines = [_line(windows, placed, by, touch_fields, merged) for windows, placed in pairs]
    timeline = reduce(DataFrame.unionByName, lines).withColumn("tile", floor_div("position", tile))
    everyone = reduce(DataFrame.unionByName, [placed.select("user_id", "event_timestamp") for _, placed in pairs])
    both_ways = everyone.select(
        "user_id", F.unix_micros("event_timestamp").alias("ts_us"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    ).select("user_id", "side", (F.col("side") * F.col("ts_us")).alias("position")).withColumn(
        "tile", floor_div("position", tile)
    )
    timeline = cut_hot_tiles(timeline, both_ways, p)
    ts = F.col("side") * F.col("position")
    edge = (F.col("block") + F.when(F.col("side") == -1, 1).otherwise(0)) * F.lit(window)
    n = F.col("_n") if merged else F.lit(1).cast("long")

    def touch(which: str) -> Column:
        fields = ["impression_id", *touch_fields]
        return F.struct(ts.alias("ts_us"), *[F.col(f"{which}.{c}") if merged else F.col(c) for c in fields])

    def of_touches(what: Column) -> Column:
        return F.when(F.col("is_probe") == 0, what)

    answered = running_totals(
        timeline,
        group=["user_id", "block", "side", *by],
        order=["position", "is_probe", "conversion_id", *([] if merged else ["impression_id"])],
        totals={
            "n_touches": ("sum", of_touches(n)),
            "weight": ("sum", of_touches(n * F.pow(F.lit(2.0), (ts - edge) / F.lit(float(half_life))))),
            "first_touch": ("min", of_touches(touch("_low"))),
            "last_touch": ("max", of_touches(touch("_high"))),
        },
        keep=F.col("is_probe") == 1, crowded=crowded_blocks(pairs),
    ).where(F.col("n_touches") > 0)
    return _gather(
        answered.select(
            "conversion_id", *[F.nullif(F.col(c), F.lit(_NO_VALUE)).alias(c) for c in by],
            *_WINDOW_TOTALS,
        ),
        conversions, by, keep_unmatched,
    )


def _line(
    windows: DataFrame, placed: DataFrame, by: list[str], touch_fields: Sequence[str], merged: bool = False
) -> DataFrame:
    """Touches and window ends on one time line, joined by user and block.

    With `merged`, the touches of one user, key and instant are one row: their number `_n`, and
    the lowest and highest by impression id, `_low` and `_high`. Each task adds up its own first.
    """
    placed = placed.select(
        "user_id", "block", *[F.coalesce(c, F.lit(_NO_VALUE)).alias(c) for c in by],
        F.unix_micros("event_timestamp").alias("ts_us"), "impression_id", *touch_fields,
    )
    probes = windows.withColumn("is_probe", F.lit(1))
    # Most users never convert: only blocks some window touches go on, and only
    # on the sides asked for.
    asked = probes.groupBy("user_id", "block").agg(F.collect_set("side").alias("sides"))
    asking, what = placed.join(asked, ["user_id", "block"]), ["impression_id", *touch_fields]
    if merged:
        one = F.struct(*what)
        asking = asking.groupBy("user_id", "block", *by, "ts_us").agg(
            F.first("sides").alias("sides"), F.count(F.lit(1)).alias("_n"), F.min(one).alias("_low"), F.max(one).alias("_high")
        )
        what = ["_n", "_low", "_high"]
    touch_rows = asking.withColumn("side", F.explode("sides")).select(
        "user_id", "block", "side", *by, (F.col("side") * F.col("ts_us")).alias("position"), F.lit(0).alias("is_probe"), *what,
    )
    if by:
        # A conversion asks only about keys its user met in that block.
        met = placed.select("user_id", "block", *by).distinct()
        probes = probes.join(met, ["user_id", "block"])
    return touch_rows.unionByName(probes, allowMissingColumns=True)


def sums_ahead(
    touches: DataFrame, conversions: DataFrame, p: Params, sums: Mapping[str, Column], keep: Sequence[str] = (),
) -> DataFrame:
    """The time line walked the other way: per touch, sums over the conversions whose windows hold it.

    A touch's own window runs forward from it, as long as a conversion's runs back; it covers the
    tail of the touch's block and the head of the next. The result has a row per touch and side
    that holds any: `keep`, `ts_us`, `edge` (the start of the block in which the side's
    conversions end, in microseconds, to which the caller scales amounts), `n_seen`, and the `sums`.

    `conversions` has user_id, end_us and what `sums` need; rows are not repeated per key of
    the touches, so work does not grow with the keys a user met.
    """
    window = p.attribution_window_days * MICROS_PER_DAY
    tile = p.tile_minutes * MICROS_PER_MINUTE
    amounts = [f"_amount_{c}" for c in sums]
    items = (
        conversions.where(F.col("user_id").isNotNull())
        .select("user_id", "end_us", *[what.alias(a) for a, what in zip(amounts, sums.values())])
        .withColumn("block", floor_div("end_us", window))
    )
    # Most users never convert: their touches leave before they are sorted.
    blocks = items.select("user_id", "block").distinct()
    probes = (
        touches.where(F.col("user_id").isNotNull())
        .select("user_id", F.unix_micros("event_timestamp").alias("ts_us"), "impression_id", *keep)
        .withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
        .withColumn("block", floor_div("ts_us", window) + F.when(F.col("side") == 1, 1).otherwise(0))
        .join(blocks, ["user_id", "block"], "left_semi")
        .withColumns({
            "position": F.when(F.col("side") == 1, F.col("ts_us") + F.lit(window)).otherwise(-F.col("ts_us")),
            "is_probe": F.lit(1),
        })
    )
    placed = items.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).select(
        "user_id", "block", "side", (F.col("side") * F.col("end_us")).alias("position"), F.lit(0).alias("is_probe"), *amounts
    )
    line = probes.unionByName(placed, allowMissingColumns=True).withColumn("tile", floor_div("position", tile))
    line = cut_hot_tiles(line, line.where("is_probe = 1"), p)

    def of_items(what: Column) -> Column:
        return F.when(F.col("is_probe") == 0, what)

    answered = running_totals(
        line, group=["user_id", "block", "side"], order=["position", "is_probe", "impression_id", *amounts],
        totals={
            "n_seen": ("sum", of_items(F.lit(1).cast("long"))),
            **{c: ("sum", of_items(F.col(a))) for c, a in zip(sums, amounts)},
        },
        keep=F.col("is_probe") == 1,
    ).where(F.col("n_seen") > 0)
    return answered.select(*keep, "ts_us", (F.col("block") * F.lit(window)).alias("edge"), "n_seen", *sums)


def _gather(
    answers: DataFrame, conversions: DataFrame, by: list[str], keep_unmatched: bool
) -> DataFrame:
    """Bring each conversion's few answers and its own columns together, in one shuffle."""
    details = [c for c in conversions.columns if c != "conversion_id"]
    own = conversions.withColumn("n_touches", F.lit(0).cast("long"))
    journey = W.partitionBy("conversion_id")
    rows = (
        answers.unionByName(own, allowMissingColumns=True)
        .repartition("conversion_id")
        .groupBy("conversion_id", *by)
        .agg(
            *[F.max(c).alias(c) for c in details],
            *[_AGGREGATE[kind](c).alias(c) for c, kind in _WINDOW_TOTALS.items()],
        )
        .withColumns({
            **{c: F.max(c).over(journey) for c in details},
            "journey_touches": F.sum("n_touches").over(journey),
        })
    )
    touched = F.col("n_touches") > 0
    return rows.where(touched | (F.col("journey_touches") == 0) if keep_unmatched else touched)
