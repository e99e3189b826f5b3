"""Golden values of the proportion statistics."""

import math

import pytest
from pyspark.sql import functions as F

from siftline.functions import stats


def one(spark, k, n, **columns):
    row = spark.createDataFrame([(k, n)], "k BIGINT, n BIGINT").select(*[c.alias(a) for a, c in columns.items()]).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    "k,n,low,high",
    [
        (50, 10_000, 0.003794881950804586, 0.006585290402184288),
        (2, 4, 0.15003570882017148, 0.8499642911798285),
        (0, 0, 0.0, 0.0),
    ],
)
def test_wilson(spark, k, n, low, high):
    a, b = stats.wilson_bounds("k", "n")
    got = one(spark, k, n, a=a, b=b)
    assert got == pytest.approx((low, high), rel=1e-12)


@pytest.mark.parametrize(
    "k,n,expected",
    [
        (0, 400_000, 7.489302638941098e-6),
        (1, 10_000, 4.7429765916545685e-4),
        (0, 0, 0.0),
        (7, 7, 1.0),
    ],
)
def test_clopper_pearson(spark, k, n, expected):
    assert one(spark, k, n, v=stats.clopper_pearson_upper("k", "n")) == pytest.approx(expected, rel=1e-9, abs=1e-15)


def log_pmf(i, n, p):
    return math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)


@pytest.mark.parametrize("k,n", [(1, 2), (1, 50), (3, 10), (9, 10), (40, 100), (199, 200), (1500, 4000), (12, 1_000_000)])
def test_clopper_pearson_is_the_root_of_the_tail(spark, k, n):
    p = one(spark, k, n, v=stats.clopper_pearson_upper("k", "n"))
    tail = math.fsum(math.exp(log_pmf(i, n, p)) for i in range(k + 1))
    assert tail == pytest.approx(0.05, rel=1e-6)


@pytest.mark.parametrize("k,n,p", [(1, 20_000, 1e-5), (5, 20, 0.5), (20, 20, 0.5), (15, 20, 0.5), (700, 1000, 0.7), (3, 10_000, 1e-5)])
def test_binomial_survival(spark, k, n, p):
    expected = math.fsum(math.exp(log_pmf(i, n, p)) for i in range(k, n + 1)) if n < 50_000 else None
    assert one(spark, k, n, v=stats.binomial_survival("k", "n", p)) == pytest.approx(expected, rel=1e-9)


def test_binomial_survival_edges(spark):
    at = lambda k, n, p: one(spark, k, n, v=stats.binomial_survival("k", "n", p))
    assert at(0, 10, 0.1) == 1.0
    assert at(11, 10, 0.1) == 0.0
    assert at(1, 0, 0.1) == 0.0
    assert at(3, 10, 0.0) == 0.0
    assert at(3, 10, 1.0) == 1.0


def test_bonferroni(spark):
    value = one(spark, 44, 4, v=stats.bonferroni(0.05, "k", "n"))
    assert value == pytest.approx(2.840909090909091e-4, rel=1e-12)
    assert one(spark, 1, 20_000, v=stats.binomial_survival("k", "n", 1e-5)) > value
    assert one(spark, 0, 0, v=stats.bonferroni(2.0, "k", "n")) == 1.0
