"""Means that are added in the order of rows, ranges that stay small, and rows that are stored once."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wobble.operators import audits, factors, heads, lineage, prefix, probes, relational


def test_ladder_means_are_added_in_order(spark):
    """A double's sum depends on the order; runs with rows dealt otherwise agree with a loop."""
    rng = random.Random(3)
    rows = [(i, i % 40, rng.choice("RNA"), rng.randint(0, 10) / 100) for i in range(1200)]
    want = {}
    for k in range(40):
        mean = {}
        for kind in "RNA":
            vs, total = [v for _, q, f, v in rows if q == k and f == kind], 0.0
            for v in vs:
                total += v
            mean[kind] = total / len(vs)
        want[k] = tuple(mean[x] for x in "RNA")
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "i long, k int, f string, v double").repartition(6)
    got = {r.k: (r.gold_first, r.random, r.distractor_first) for r in audits.by_ladder(frame, ["k"], "f", ("R", "N", "A"), "v", [F.col("i")]).collect()}
    assert got == want


def test_ranges_are_not_joined(spark):
    values = spark.range(5000).select(F.struct(F.lit(0).alias("all")).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    found = prefix.running(values, "n").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in found) < 5000
    assert prefix.running(values, "n").where("before_n <> v or total_n <> 5000").isEmpty()


def test_octants_broadcast_their_cuts(spark):
    rows = spark.range(400).selectExpr("id", "id % 3 as g", "id * 7 % 101 as a", "id % 5 as b", "id % 11 as c")
    plan = relational.octants(rows, ["g"], ["a", "b", "c"], 8, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_ranks_of_few_values_are_broadcast(spark):
    rows = spark.range(400).selectExpr("id % 3 as a", "id % 7 as b")
    found = factors.rank_vectors(rows, [], ["a", "b"])
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    frame = rows.toPandas()
    rank = frame.rank() - (len(frame) + 1) / 2
    assert sorted(tuple(r.ranks) for r in found.collect()) == sorted(map(tuple, rank.values.tolist()))


def test_trials_are_a_row_for_each_cell(spark):
    """All strengths stand beside each other, so a label is stored and ranked once for a cell; equal features have equal scores."""
    rows = spark.range(60).selectExpr("array(double(id % 3), double(id % 2)) as x", "double(id) as y", "array(struct(1 as outer, int(id % 3) as inner)) as cells")
    heads = [(1, i, s, [0.5, 0.5], [1.0, 2.0], [s, 1.0], 0.25) for i in range(3) for s in (1.0, 10.0)]
    found = probes.trials(rows, spark.createDataFrame(heads, probes.HEADS), (1.0, 10.0)).collect()
    assert len(found) == 60
    for r in found:
        a, b = r.y % 3, r.y % 2
        assert r.inner == r.y % 3
        for got, s in ((r.s0, 1.0), (r.s1, 10.0)):
            assert abs(got - ((a - 0.5) * s + (b - 0.5) / 2 + 0.25)) < 1e-9


def test_nested_ridge_stores_no_row_for_each_cell(spark, monkeypatch):
    """A row lies in a cell for each other fold; where scores repeat, no step may store it once for each of them."""
    stored = []

    def counted(df, name):
        out = lineage.written(df, name)
        stored.append(out.count())
        return out

    for module in (factors, prefix, probes):
        monkeypatch.setattr(module, "written", counted)
    rows = spark.range(6000).selectExpr("id", "id % 97 as g", "array(double(id % 5), double(id % 3)) as x", "double(id * 37 % 5987) as y")
    _, picked = probes.nested(heads.folded(rows, "g", 4, 1), ["id"], "g", False, (1.0, 100.0))
    assert picked.count() == 4 and max(stored) <= 6000


@pytest.mark.parametrize("chunk", [1, 1 << 21])
@pytest.mark.parametrize("labels", ["few", "one", "many"])
def test_rank_quality_equals_pandas(spark, chunk, labels):
    """Equal labels cross chunks and ranges; rows without a label or a score, and cells without heads or with too few rows, do not count."""
    rng = np.random.default_rng(6)
    n, strengths = 600, (1.0, 10.0)
    x = np.column_stack([rng.integers(0, 6, n), rng.integers(0, 4, n) / 10])
    y = {"few": rng.integers(-2, 3, n) * 0.5, "one": np.where(rng.random(n) < 0.9, 2.0, rng.standard_normal(n)), "many": rng.standard_normal(n)}[labels]
    y[3], x[5, 0], x[6] = np.nan, np.nan, [np.inf, -np.inf]
    cells = [[(o, int(rng.integers(0, 3))) for o in range(3) if o != i % 3] + ([(7, 0)] if i < 2 else []) for i in range(n)]
    found = [(o, i, s, [0.5, 0.5], [1.0, 2.0], rng.standard_normal(2).tolist(), 0.25) for o, i in [(a, b) for a in range(3) for b in range(3) if (a, b) != (2, 2)] + [(7, 0)] for s in strengths]
    rows = spark.createDataFrame([(i, x[i].tolist(), None if i == 4 else float(y[i]), cells[i]) for i in range(n)], "i int, x array<double>, y double, cells array<struct<outer int, inner int>>")
    got = probes.rank_quality(rows.repartition(5), ["i"], spark.createDataFrame(found, probes.HEADS), strengths, chunk=chunk)
    got = {(r.outer, r.inner, r.strength): r.q for r in got.collect()}
    y[4] = np.nan
    want = {}
    for o, i in {h[:2] for h in found}:
        at = [k for k in range(n) if (o, i) in cells[k]]
        both = pd.DataFrame({"y": y[at]})
        for s, mean, sd, w, b in (h[2:] for h in found if h[:2] == (o, i)):
            with np.errstate(invalid="ignore"):
                both[s] = x[at, 0] * w[0] + x[at, 1] * (w[1] / 2) + (b - mean[0] * w[0] - mean[1] * w[1] / 2)
        rank = both.dropna().rank()  # rows with a label and all scores
        want |= {(o, i, s): rank["y"].corr(rank[s]) if len(rank) > 2 else None for s in strengths}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
