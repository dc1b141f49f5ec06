"""Column functions over a season's array of daily values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(s: Column, i: Column) -> Column:
    """s[i], the first or last value outside."""
    return F.get(s, F.least(F.greatest(i, F.lit(0)), F.size(s) - 1))


def over_days(s: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(s) - 1), f)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value computed once: a lambda's variable is, an expression may be copied to each place of use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(s: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    """The sum of f over an array of doubles, 0 for an empty one."""
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + f(x))


def gaussian(sigma: float, radius: int) -> list[float]:
    k = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    return [x / sum(k) for x in k]


def smooth(s: Column, sigma: float = 2.0) -> Column:
    """Gaussian smoothing to a radius of three sigma, ends repeated."""
    radius = round(3 * sigma)
    parts = list(zip(range(-radius, radius + 1), gaussian(sigma, radius), strict=True))

    def one(t: Column) -> Column:
        out = F.lit(0.0)
        for o, w in parts:
            out = out + F.lit(w) * at(s, t + o)
        return out

    return over_days(s, one)


def central_rate(s: Column) -> Column:
    return over_days(s, lambda t: (at(s, t + 1) - at(s, t - 1)) * 0.5)


def lag_rate(s: Column, lag: int) -> Column:
    """Change over lag days, a day ahead more than back if odd; at the ends the span is cut, the divisor isn't."""
    return over_days(s, lambda t: (at(s, t + (lag + 1) // 2) - at(s, t - lag // 2)) / lag)


def slope_position(rate: Column, bins: int, c: float) -> Column:
    """Place of atan(rate / c) among bins equal parts of (-90, 90) degrees, whole numbers at their centres."""
    return (F.atan2(rate, F.lit(c)) + math.pi / 2) / math.pi * bins - 0.5


def cell_of(day: Column, cells: int, days: Column | int) -> Column:
    return F.floor(day * cells / days).cast("int")


def as_distribution(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return bound(total, lambda t: F.transform(v, lambda x: x / F.greatest(t, F.lit(1e-12))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    r = lambda x: x.cast("double") * math.pi / 180
    a = F.pow(F.sin(r(lat2 - lat1) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin(r(lon2 - lon1) / 2), 2)
    return F.lit(12742.0) * F.asin(F.sqrt(a))
