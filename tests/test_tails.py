"""Tail probabilities against closed forms and the standard library."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotry.functions import tails as ta
from ballotry.operators import inference as inf


def column(spark, rows, schema, made):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.v for r in df.select("i", made.alias("v")).orderBy("i").collect()]


def test_erfc_and_log_gamma(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9999, 2.0, 3.0, 5.0, 10.0, 25.0]
    got = column(spark, [(x,) for x in xs], "x double", ta.erfc(F.col("x")))
    assert np.allclose(got, [math.erfc(x) for x in xs], rtol=1e-11, atol=0)
    xs = [0.01, 0.5, 1.0, 2.0, 3.5, 10.0, 1234.5, 1e6]
    got = column(spark, [(x,) for x in xs], "x double", ta.log_gamma(F.col("x")))
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-12)


def test_incomplete_beta_closed_forms(spark):
    rows, want = [], []
    for x in (0.0, 1e-6, 0.2, 0.5, 0.77, 0.999, 1.0):
        for a in (1, 2, 5):
            rows += [(float(a), 1.0, x), (1.0, float(a), x), (0.5, 0.5, x)]
            want += [x**a, 1 - (1 - x) ** a, 2 / math.pi * math.asin(math.sqrt(x))]
        # integer parameters: a binomial tail
        for a, b in ((3, 4), (20, 30), (200, 5)):
            n = a + b - 1
            rows.append((float(a), float(b), x))
            want.append(sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1)))
    got = column(spark, rows, "a double, b double, x double", ta.incomplete_beta(F.col("a"), F.col("b"), F.col("x")))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_correlation_p(spark):
    rows = [(r, n) for r in (-0.999, -0.3, 0.0, 0.05, 0.9) for n in (3, 4, 10)] + [(0.5, 2), (None, 2), (0.1, 1), (0.01, 1_000_000)]

    def closed(r, n):
        if n == 3:  # a Cauchy distribution
            return 1 - 2 / math.pi * math.atan(abs(r) / math.sqrt(1 - r * r))
        if n == 4:  # a uniform one
            return 1 - abs(r)
        theta = math.atan(abs(r) / math.sqrt(1 - r * r))  # eight degrees of freedom
        return 1 - math.sin(theta) * (1 + 1 / 2 * math.cos(theta) ** 2 + 3 / 8 * math.cos(theta) ** 4 + 15 / 48 * math.cos(theta) ** 6)

    got = column(spark, rows, "r double, n long", ta.pearson_p(F.col("r"), F.col("n")))
    assert np.allclose(got[:15], [closed(r, n) for r, n in rows[:15]], rtol=1e-9, atol=1e-12)
    assert got[15:18] == [1.0, None, None] and math.isclose(got[18], math.erfc(10 / math.sqrt(2)), rel_tol=0.02)


def plain_rank_test(x, y):
    """U of x and its exact p over all ways to choose x of the ranks."""
    both = sorted(x + y)
    rank = {v: np.mean([i + 1 for i, w in enumerate(both) if w == v]) for v in both}
    u = sum(rank[v] for v in x) - len(x) * (len(x) + 1) / 2
    ways = [sum(c) - len(x) * (len(x) + 1) / 2 for c in itertools.combinations(range(1, len(both) + 1), len(x))]
    far = max(u, len(x) * len(y) - u)
    return u, min(1.0, 2 * np.mean([w >= far for w in ways]))


def test_replicated_rank_test(spark):
    rng = np.random.default_rng(5)
    groups = {1: 4, 0: 5}
    rows = [(rep, g, float(rng.normal() + 2 * g)) for rep in range(-1, 60) for g, n in groups.items() for _ in range(n)]
    rows = [(rep, g, math.nan) if rep in (7, 9) and g and i % 9 == 0 else (rep, g, v) for i, (rep, g, v) in enumerate(rows)]
    rows += [(rep, None, 1.0) for rep in range(5)]
    got = inf.replicated_rank_test(spark.createDataFrame(rows, "rep long, g int, v double"), "v", "g", 0.05).first()
    side = lambda rep, g: [v for r, h, v in rows if r == rep and h == g]
    missing = {r for r, _, v in rows if v != v}
    tests = {rep: plain_rank_test(side(rep, 1), side(rep, 0)) for rep in range(-1, 60) if rep not in missing}
    assert got.u == tests[-1][0] and math.isclose(got.p, tests[-1][1]) and (got.n1, got.n0) == (4, 5)
    assert got.dropped == len(missing) > 0 and got.used == 60 - len(missing)
    assert math.isclose(got.share, np.mean([p < 0.05 for rep, (_, p) in tests.items() if rep >= 0]))


def test_rank_test_with_ties_is_normal(spark):
    x, y = [1, 2, 2, 3, 9, 9, 4, 4, 5], [2, 3, 3, 7, 8, 9, 9, 9, 1, 1]
    df = spark.createDataFrame([(v, 1) for v in x] + [(v, 0) for v in y], "v int, g int")
    got = inf.mann_whitney(df, "v", "g").first()
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    n = len(x) + len(y)
    ties = sum(t**3 - t for t in (sum(w == v for w in x + y) for v in set(x + y)))
    sd = math.sqrt(len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got.u == u and got.p == pytest.approx(math.erfc((abs(u - len(x) * len(y) / 2) - 0.5) / sd / math.sqrt(2)), rel=1e-9)


def test_exact_p_of_separated_values(spark):
    df = spark.createDataFrame([(v, int(v < 3)) for v in range(6)], "v int, g int")
    assert inf.mann_whitney(df, "v", "g").first().p == pytest.approx(0.1)


def test_correlation_of_large_numbers(spark):
    ys = [4_000_000_000 + (i * i % 7) for i in range(40)]  # squares and squared sums exceed 64 bits
    rows = [("a", i, y) for i, y in enumerate(ys)] + [("b", 5_000_000_000, y) for y in ys]
    got = {r.g: r for r in inf.pearson(spark.createDataFrame(rows, "g string, x long, y long"), "x", "y", ["g"]).collect()}
    assert got["a"].r == pytest.approx(np.corrcoef(range(40), [y - 4_000_000_000 for y in ys])[0, 1], abs=1e-6)
    assert got["b"].r is None and got["b"].p is None and got["b"].n == 40
