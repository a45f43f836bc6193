"""Running sums, medians and rank correlations in ranges, against plain Python."""

import math
import random
import statistics

import pytest

from wobble.operators.factors import rank_correlation
from wobble.operators.prefix import distinct_values, medians, running


@pytest.fixture(params=["true", "false"])
def ranges(spark, request):
    """One range of few rows, and as many as the session has partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


def values():
    """Groups of very unlike sizes, one without a name; close values beside one that is far away, ties, nulls, NaNs and infinities."""
    rng = random.Random(11)
    rows = [("hot", 1000 + rng.randrange(400) / 400, rng.randrange(5)) for _ in range(3000)] + [("hot", 1e300, 1), ("hot", -1e300, 2), ("hot", math.inf, 3), ("hot", -0.0, 1), ("hot", 0.0, 1)]
    rows += [(g, float(rng.randrange(6)), rng.randrange(5)) for g in (None, "a", "b") for _ in range(40)] + [("one", 7.0, 1), ("none", None, 1), ("nan", math.nan, 1), ("a", None, 2), ("b", math.nan, 2)]
    rng.shuffle(rows)
    return rows


def by_group(rows):
    out = {}
    for g, v, s in rows:
        if v is not None and not math.isnan(v):
            out.setdefault(g, []).append((v, s))
    return out


def test_running_sums(spark, ranges):
    rows = values()
    df = spark.createDataFrame(rows, "g string, v double, s long").repartition(5)
    found = running(distinct_values(df, ["g"], "v", s="s"), "n", "s")
    got = {(r.g.g, r.v): (r.n, r.before_n, r.total_n, r.before_s, r.total_s, r.up) for r in found.collect()}
    want = {}
    for g, pairs in by_group(rows).items():
        different = sorted({v for v, _ in pairs})
        for i, v in enumerate(different):
            below = [s for x, s in pairs if x < v]
            up = different[i + 1] if i + 1 < len(different) else None
            want[g, v] = (sum(x == v for x, _ in pairs), len(below), len(pairs), sum(below), sum(s for _, s in pairs), up)
    assert got == want


def test_medians(spark, ranges):
    rows = values()
    got = {r.g.g: r.m for r in medians(spark.createDataFrame(rows, "g string, v double, s long"), ["g"], "v", "m").collect()}
    assert got == {g: statistics.median(v for v, _ in pairs) for g, pairs in by_group(rows).items()}


def ranks(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def test_rank_correlations(spark, ranges):
    rng = random.Random(3)
    rows = [(g, float(x), float(x + rng.randrange(9))) for g, n in ((None, 200), ("a", 60), ("b", 3)) for x in (rng.randrange(20) for _ in range(n))]
    rows += [("few", 1.0, 2.0), ("few", 2.0, 3.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("a", None, 1.0), ("a", 1.0, math.nan), ("void", None, None)]
    found = rank_correlation(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"], "rho")
    got = {r.g: (r.rho, r.n) for r in found.collect()}
    whole = {}
    for g, x, y in rows:
        if None not in (x, y) and not math.isnan(y):
            whole.setdefault(g, []).append((x, y))
    assert got.keys() == whole.keys()
    for g, pairs in whole.items():
        rho, n = got[g]
        assert n == len(pairs)
        if g in ("few", "flat"):
            assert rho is None
        else:
            assert rho == pytest.approx(statistics.correlation(*map(ranks, zip(*pairs))), abs=1e-12)


def test_empty(spark, ranges):
    none = spark.createDataFrame([], "g string, x double, y double")
    assert medians(none, ["g"], "x", "m").count() == rank_correlation(none, "x", "y", ["g"], "rho").count() == 0
