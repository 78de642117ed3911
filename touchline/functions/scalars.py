"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR

# Money per event: micro-units, up to a trillion. Credits: fractions of money.
MONEY = "decimal(18,6)"
CREDIT = "decimal(28,10)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator, denominator, default: float = 0.0) -> Column:
    """numerator / denominator where the denominator is positive, else `default`."""
    n, d = _col(numerator), _col(denominator)
    return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(float(default)))


def exact_sum(c, scale: str = MONEY) -> Column:
    """Sum whose result does not depend on the order rows arrive in.

    Adding doubles in a different order after a retry or a re-plan changes the
    last digits; decimals do not.
    """
    return F.sum(_col(c).cast(scale)).cast("double")


def half_up(c, places: int) -> Column:
    """Round for a report. Goes through a decimal so ties go up, not by binary noise."""
    return F.round(_col(c).cast("decimal(28,10)"), places).cast("double")


def floor_div(c, step: int) -> Column:
    """Integer floor division that is exact and also right for negative values."""
    c = _col(c)
    return ((c - F.pmod(c, F.lit(step))) / F.lit(step)).cast("long")


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join under which NULL matches NULL; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def bot_flag(is_bot, cost, timestamp) -> Column:
    """Declared bot, or a free impression. NULL in, NULL out: the caller's filter drops it."""
    return _col(is_bot) | ((_col(cost) == 0) & _col(timestamp).isNotNull())


def suspicious_device(device, patterns) -> Column:
    return F.coalesce(F.lower(_col(device)).rlike("|".join(patterns)), F.lit(False))


# The rational approximation 26.2.17 of Abramowitz and Stegun to
# the upper tail of the normal distribution (absolute error below 7.5e-8).
TAIL_P = 0.2316419
TAIL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0."""
    t = 1.0 / (1.0 + F.lit(TAIL_P) * z)
    polynomial = F.lit(0.0)
    for b in reversed(TAIL_B):
        polynomial = (polynomial + F.lit(b)) * t
    density = F.exp(-z * z / 2.0) / F.lit(math.sqrt(2.0 * math.pi))
    return density * polynomial


def two_tailed_p(z: Column) -> Column:
    # At z = 0 the approximation is 1 - 1e-9; the exact value is 1.
    return F.when(z == 0, F.lit(1.0)).otherwise(2.0 * normal_upper_tail(F.abs(z)))


def day_text(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def instant_text(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
