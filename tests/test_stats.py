"""Distribution functions against published table values."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import stats


@pytest.mark.parametrize("t,df,p", [(12.706205, 1, 0.05), (2.262157, 9, 0.05), (3.250, 9, 0.01), (1.959964, 1e9, 0.05), (2.042272, 30, 0.05), (0.0, 5, 1.0)])
def test_t_two_sided(t, df, p):
    assert stats.t_two_sided(t, df) == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize("p,df,t", [(0.05, 9, 2.262157), (0.01, 20, 2.845340), (0.10, 5, 2.015048)])
def test_t_quantile(p, df, t):
    assert stats.t_quantile(p, df) == pytest.approx(t, abs=1e-5)


def test_normal(spark):
    r = spark.createDataFrame([(1.959964,), (None,)], "z double").select(stats.normal_two_sided(F.col("z")).alias("a"), stats.normal_upper(F.col("z")).alias("b")).collect()
    assert r[0].a == pytest.approx(0.05, abs=1e-6) and r[0].b == pytest.approx(0.025, abs=1e-6) and r[1].a is None
