import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats

# Published rank correlation, number of months, two-sided p-value.
PUBLISHED = [
    (0.7147769077131324, 269, 2.3251370996890915e-43),
    (0.7058425345392, 269, 7.198141895331711e-42),
    (0.621683404538645, 269, 3.6842386052752106e-30),
]


def test_p_values():
    r, n, p = map(np.array, zip(*PUBLISHED))
    assert stats.two_sided_p(r, n - 2) == pytest.approx(p, rel=1e-6)
    # closed forms: one degree of freedom is a Cauchy distribution, two is algebraic
    r = np.array([-0.9, -0.2, 0.0, 0.4, 0.99])
    t = r / np.sqrt(1 - r**2)
    assert stats.two_sided_p(r, np.ones(5)) == pytest.approx(1 - 2 / np.pi * np.arctan(abs(t)))
    t2 = t * np.sqrt(2)
    assert stats.two_sided_p(r, np.full(5, 2.0)) == pytest.approx(
        1 - abs(t2) / np.sqrt(2 + t2**2))
    assert stats.two_sided_p(np.array([1.0, -1.0]), np.array([8.0, 8.0])).tolist() == [0, 0]
    assert np.isnan(stats.two_sided_p(np.array([0.5, np.nan]), np.array([0.0, 5.0]))).all()


def test_p_value_column(spark):
    rows = [(0.5, 8.0), (None, 8.0), (0.5, 0.0)]
    got = spark.createDataFrame(rows, "r double, df double").select(
        stats.correlation_p("r", "df").alias("p")).collect()
    assert got[0].p == pytest.approx(0.14111328125, rel=1e-6)
    assert got[1].p is None and got[2].p is None


def test_pearson_is_null_without_spread(spark):
    df = spark.createDataFrame(
        [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("one", 1.0, 1.0), ("up", 1.0, 1.0), ("up", 2.0, 3.0),
         ("up", None, 9.0), ("up", 7.0, None)], "k string, x double, y double")
    got = {r.k: r.r for r in df.groupBy("k").agg(
        stats.pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["c"] is None and got["one"] is None and got["up"] == pytest.approx(1.0)


def test_average_rank(spark):
    df = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, 9.0)], "k string, v double")
    got = sorted(r.rank for r in df.select(stats.average_rank(["k"], "v").alias("rank")).collect())
    assert got == [1.0, 2.5, 2.5, 4.0]


def test_effective_n(spark):
    got = spark.createDataFrame([(269, 0.5), (10, -1.0)], "n int, r double").select(
        stats.effective_n(F.col("n"), F.col("r")).alias("e")).collect()
    assert got[0].e == pytest.approx(269 / 3) and got[1].e is None
