"""Quantities as intervals on one scale each: hours between repeats, hours that something lasts, percent, counts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours of a unit: the shortest and the longest that the word may stand for.
HOURS = {
    "second": (1 / 3600, 1 / 3600), "minute": (1 / 60, 1 / 60), "hour": (1.0, 1.0), "day": (24.0, 24.0), "week": (168.0, 168.0),
    "month": (28 * 24.0, 31 * 24.0), "quarter": (90 * 24.0, 92 * 24.0), "year": (365 * 24.0, 366 * 24.0),
}
#: Words for a repeat, the first that fits: the unit, and how many of it.
REPEATS = [("semi-annual", "month", 6), ("dail", "day", 1), ("week", "week", 1), ("month", "month", 1), ("quarter", "quarter", 1), ("annual", "year", 1), ("year", "year", 1)]
NUMBER = r"(\d+(?:,\d{3})*(?:\.\d+)?)"
UNIT = r"(second|minute|hour|day|week|month|quarter|year)"


def _span(low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))


def _hours(unit: Column, least: bool) -> Column:
    return F.coalesce(*(F.when(unit == u, F.lit(h[0 if least else 1])) for u, h in HOURS.items()))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.replace(F.regexp_extract(text, pattern, group), F.lit(","), F.lit("")).try_cast("double")


def measure(value: Column, kind: Column) -> Column:
    """struct(scale, low, high) of a quantity, null if it has no number on a scale.

    scale: `repeat` (hours between two), `lasting` (hours), `share` (percent) or `count`. `every 30 days` is 720 hours,
    `monthly` 672 to 744, `twice` or `5 times per day` a day by so many, `within 2 days` anything up to 48, `continuous` 0.
    `more than` and `over` are open above, `less than` and `below` reach from 0.
    """
    v = F.lower(value)
    n, unit = _number(v, NUMBER + r"[\s-]+(?:business\s+)?" + UNIT), F.regexp_extract(v, NUMBER + r"[\s-]+(?:business\s+)?" + UNIT, 2)
    spoken = lambda low, high: F.when(n.isNotNull(), _span(low, high))
    span = spoken(n * _hours(unit, True), n * _hours(unit, False))
    upto = F.when(F.contains(v, F.lit("within")), spoken(F.lit(0.0), n * _hours(unit, False)))
    often, per = _number(v, NUMBER + r"\s+times?\s+(?:per|each)\s+" + UNIT), F.regexp_extract(v, r"(?:per|each)\s+" + UNIT, 1)
    times = F.when(often > 0, _span(_hours(per, True) / often, _hours(per, False) / often))
    least = F.when((often > 0) & v.rlike("at least|no less than|minimum of"), _span(F.lit(0.0), _hours(per, False) / often))
    always = F.when(reduce(or_, [F.contains(v, F.lit(w)) for w in ("real-time", "continuous", "ongoing")]), _span(F.lit(0.0), F.lit(0.0)))
    named = [F.when(F.contains(v, F.lit(word)), _span(F.lit(HOURS[u][0] * k), F.lit(HOURS[u][1] * k))) for word, u, k in REPEATS]
    repeat = F.coalesce(least, times, upto, span, always, *named)

    x = _number(v, NUMBER)
    above, below = v.rlike(r"greater|more|above|exceeds|over|at\s+least|\d\+"), v.rlike("less|fewer|below")
    amount = F.when(x.isNotNull(), F.when(above, _span(x, F.lit(float("inf")))).when(below, _span(F.lit(0.0), x)).otherwise(_span(x, x)))
    by_kind = [("frequency", "repeat", repeat), ("duration", "lasting", span), ("percentage", "share", amount), ("count", "count", amount), ("sample_size", "count", amount)]
    scaled = lambda scale, s: F.when(s.isNotNull(), F.struct(F.lit(scale).alias("scale"), s["low"].alias("low"), s["high"].alias("high")))
    return F.coalesce(*(F.when(kind == k, scaled(scale, s)) for k, scale, s in by_kind))


def apart(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """True if two intervals have no value in common."""
    return (high_a < low_b) | (high_b < low_a)
