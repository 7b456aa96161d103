"""Small statistics over short arrays held in one row (a pattern's window)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extrema(values: Column, size: int, order: int, peaks: bool) -> Column:
    """Points (x, y) strictly beyond ``order`` neighbours on each side.

    Neighbours outside the window do not count; the first and last position never qualify.
    """

    def beyond(i: Column) -> Column:
        ok = F.lit(True)
        y = F.get(values, i)
        for k in range(1, order + 1):
            for j in (i - k, i + k):
                other = F.get(values, F.when(j >= 0, j))
                ok = ok & F.coalesce(y > other if peaks else y < other, F.lit(True))
        return ok

    spots = F.filter(F.sequence(F.lit(1), F.lit(size - 2)), beyond)
    return F.transform(spots, lambda i: F.struct(i.alias("x"), F.get(values, i).alias("y")))


def mean(points: Column) -> Column:
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["y"])
    return F.try_divide(total, F.size(points).cast("double"))


def pop_std(points: Column, mu: Column) -> Column:
    squares = F.aggregate(points, F.lit(0.0), lambda s, p: s + (p["y"] - mu) * (p["y"] - mu))
    return F.sqrt(F.try_divide(squares, F.size(points).cast("double")))


def slope(points: Column) -> Column:
    """Least-squares slope of y on x, to nine places: rounding noise of a flat line is no slope."""
    mx = F.try_divide(
        F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"]), F.size(points).cast("double")
    )
    sxx = F.aggregate(points, F.lit(0.0), lambda s, p: s + (p["x"] - mx) * (p["x"] - mx))
    sxy = F.aggregate(points, F.lit(0.0), lambda s, p: s + (p["x"] - mx) * p["y"])
    return F.round(F.try_divide(sxy, F.when(sxx != 0, sxx)), 9)
