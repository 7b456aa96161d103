"""Distribution functions Spark lacks, for columns with few rows (one per series or per finding)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t."""
    if df <= 0 or math.isnan(t):
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(two_sided: float, df: float) -> float:
    """The t with P(|T| > t) = two_sided, by bisection."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > two_sided and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > two_sided else (lo, mid)
    return (lo + hi) / 2


def _apply(fn, *cols: pd.Series) -> pd.Series:
    values = [
        math.nan if any(v is None or math.isnan(v) for v in row) else fn(*row)
        for row in zip(*[c.astype(float).to_numpy() for c in cols])
    ]
    out = pd.Series(np.array(values, dtype=float))
    return out.where(out.notna(), None)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|) for the standard normal."""

    @F.pandas_udf("double")
    def udf(s: pd.Series) -> pd.Series:
        return _apply(lambda v: math.erfc(abs(v) / math.sqrt(2)), s)

    return udf(z.cast("double"))


def normal_upper(z: Column) -> Column:
    """P(Z > z)."""

    @F.pandas_udf("double")
    def udf(s: pd.Series) -> pd.Series:
        return _apply(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), s)

    return udf(z.cast("double"))


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return _apply(t_two_sided, a, b)

    return udf(t.cast("double"), df.cast("double"))


def t_critical(two_sided: float, df: Column) -> Column:
    @F.pandas_udf("double")
    def udf(b: pd.Series) -> pd.Series:
        return _apply(lambda d: t_quantile(two_sided, d) if d > 0 else math.nan, b)

    return udf(df.cast("double"))


def pooled_t(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    """t and degrees of freedom of the equal-variance two-sample test; v are sample variances (null for n=1)."""
    df = n1 + n2 - 2
    ss = F.coalesce(v1, F.lit(0.0)) * (n1 - 1) + F.coalesce(v2, F.lit(0.0)) * (n2 - 1)
    pooled = F.try_divide(ss, df.cast("double"))
    se = F.sqrt(pooled * (1 / n1 + 1 / n2))
    return F.try_divide(m1 - m2, F.when(se > 0, se)), df
