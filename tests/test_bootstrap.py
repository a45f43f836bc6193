"""Draws by counts: quantiles against exact sums, and resamples against the law they are to have."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wobble.operators import bootstrap


def test_log_factorials():
    n = np.array([0, 1, 2, 31, 32, 33, 100, 10**4, 10**8])
    assert np.allclose(bootstrap.log_factorial(n), [math.lgamma(i + 1) for i in n.tolist()], rtol=1e-14)


@pytest.mark.parametrize("n, p", [(1, 0.5), (5, 0.01), (30, 0.999), (200, 0.3), (3000, 0.0005)])
def test_quantiles_equal_exact_sums(n, p):
    u = np.array([1e-12, 0.001, 0.2, 0.5, 0.731, 0.99, 1 - 1e-9])
    cdf = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]) if n < 1000 else np.cumsum(np.exp([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p) for k in range(n + 1)]))
    want = [min(n, int((cdf < x).sum())) for x in u]
    assert bootstrap.binomial(np.full(len(u), n), p, u).tolist() == want


def test_quantiles_of_a_large_cell():
    """A hundred million items cost a window of some deviations."""
    n, p = 10**8, 0.25
    k = bootstrap.binomial(np.full(3, n), p, np.array([0.158655254, 0.5, 0.841344746]))
    sd = math.sqrt(n * p * (1 - p))
    assert np.allclose((k - n * p) / sd, [-1, 0, 1], atol=1e-3)


def test_resamples_have_the_multinomial_law():
    sizes = np.array([1, 7, 2, 30, 10])
    times = bootstrap.multinomial("a cell", sizes, 0, 4000)
    assert (times.sum(axis=1) == 50).all() and (times >= 0).all()
    p = sizes / 50
    assert np.abs(times.mean(axis=0) - 50 * p).max() < 4 * math.sqrt(50 * 0.25 / 4000)
    want = 50 * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(times.T) - want).max() < 0.6
    some = bootstrap.multinomial("a cell", sizes, 1000, 1010)
    assert (some == times[1000:1010]).all()  # a resample does not depend on its block


def test_resamples_of_rows(spark):
    rows = [("a", i, (i % 4) / 4, 4 + i % 2) for i in range(37)] + [("b", 0, 1.0, 3), ("c", 1, 0.5, 2), ("c", 2, 0.5, 2)]
    graded = spark.createDataFrame(rows, "cell string, par int, f double, k long").repartition(5)
    got = bootstrap.resampled(graded, ["cell"], 300, 7)
    totals = {(r.cell, r.b): r.n for r in got.groupBy("cell", "b").agg(F.sum("times").alias("n")).collect()}
    assert totals == {(c, b): n for c, n in (("a", 37), ("b", 1), ("c", 2)) for b in range(300)}
    seen = Counter((r.cell, r.f, r.k) for r in got.select("cell", "f", "k").distinct().collect())
    assert seen == Counter({(c, f, k) for c, _, f, k in rows})
    again = bootstrap.resampled(graded.repartition(2), ["cell"], 300, 7)
    assert got.exceptAll(again).isEmpty()
    assert bootstrap.resampled(graded.where("false"), ["cell"], 10, 7).count() == 0


def test_intervals_cover_the_truth(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{c}", i, float(rng.random() < 0.4), 1) for c in range(60) for i in range(80)]
    graded = spark.createDataFrame(rows, "cell string, par int, f double, k long")
    bounds = bootstrap.curve_bounds(graded, ["cell"], 400, 1, 0.95, [0.5]).collect()
    truth = -math.log2(0.4)
    assert len(bounds) == 60 and 0.85 <= np.mean([r.low <= truth <= r.high for r in bounds]) <= 1


def test_intraclass_of_one_paraphrase_is_undefined(spark):
    from wobble.operators import cells

    graded = spark.createDataFrame([("one", 0, 0.5, 4), ("two", 0, 0.5, 4), ("two", 1, 1.0, 4), ("same", 0, 1.0, 4), ("same", 1, 1.0, 4)], "cell string, par int, f double, k long")
    got = {r.cell: r.rho_f for r in cells.input_metrics(cells.facts(graded, ["cell"]), ["cell"]).collect()}
    assert math.isnan(got["one"]) and math.isnan(got["same"]) and 0 <= got["two"] <= 1
