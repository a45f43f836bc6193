"""Bootstrap intervals by counts: a resample of a cell is how often each of its distinct scores is drawn.

Items with one score are one class, so a resample is a multinomial draw over the classes: class by class, a binomial share
of what is left. Each share is the quantile of a uniform number that SHA-256 makes of seed, cell, resample and class, so
any engine can repeat it. Work grows with classes and resamples, not with items; a row holds a cell's classes, which are as
many as it has different scores and numbers of trials.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

#: Resamples of a cell that one row of work draws.
BLOCK = 128
#: Deviations, and places besides, that a binomial quantile is looked for around the mean.
REACH = 12
#: Terms of the asymptotic series of the logarithm of a factorial, for arguments from ``SMALL`` on.
SERIES, SMALL = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188), 32
_FACTORIALS = np.array([math.lgamma(i + 1) for i in range(SMALL)])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! of whole numbers."""
    x = np.maximum(n, SMALL) + 1.0
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + sum(c / x ** (2 * i + 1) for i, c in enumerate(SERIES))
    return np.where(n < SMALL, _FACTORIALS[np.minimum(n, SMALL - 1).astype(int)], large)


def binomial(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The least k whose cumulative probability among ``n`` trials is ``u`` or more."""
    sd = np.sqrt(n * p * (1 - p))
    low = np.maximum(0, np.floor(n * p - REACH * sd - REACH)).astype(np.int64)
    high = np.minimum(n, np.ceil(n * p + REACH * sd + REACH)).astype(np.int64)
    k = low[:, None] + np.arange((high - low).max() + 1)
    inside, total = k <= high[:, None], n[:, None]
    k = np.minimum(k, total)
    log = log_factorial(total) - log_factorial(k) - log_factorial(total - k) + k * math.log(p) + (total - k) * math.log(1 - p)
    below = np.cumsum(np.where(inside, np.exp(log), 0.0), axis=1) < u[:, None]
    return np.minimum(low + (below & inside).sum(axis=1), high)


def uniform(name: str) -> float:
    """A number between 0 and 1 of a text: the first 52 bits of its SHA-256."""
    return (int(sha256(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def multinomial(name: str, sizes: np.ndarray, first: int, last: int) -> np.ndarray:
    """How often resamples ``first`` to ``last - 1`` draw each class: a row per resample."""
    out = np.zeros((last - first, len(sizes)), np.int64)
    left, weight = np.full(last - first, sizes.sum()), int(sizes.sum())
    for i, size in enumerate(sizes):
        if size == weight:
            out[:, i] = left
            break
        u = np.array([uniform(f"{name}::{b}::{i}") for b in range(first, last)])
        out[:, i] = binomial(left, size / weight, u)
        left, weight = left - out[:, i], weight - int(size)
    return out


def resampled(graded: DataFrame, cell: list[str], resamples: int, seed: int) -> DataFrame:
    """``cell, b, f, k, times``: the scores of each resample, with how often they were drawn (scores that were not are absent)."""
    classes = graded.groupBy(*cell, "f", "k").agg(F.count("*").alias("size"))
    cells = classes.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("f", "k", "size"))).alias("classes"))
    name = F.concat_ws("::", F.lit(str(seed)), *(F.col(c).cast("string") for c in cell))
    work = cells.withColumn("name", name).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(BLOCK))))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                f, k, sizes = (np.array([c[x] for c in r["classes"]]) for x in ("f", "k", "size"))
                times = multinomial(r["name"], sizes, r["first"], min(r["first"] + BLOCK, resamples))
                b, i = np.nonzero(times)
                yield pd.DataFrame({c: [r[c]] * len(b) for c in cell} | {"b": b + r["first"], "f": f[i], "k": k[i], "times": times[b, i]})

    schema = graded.select(*cell).schema.add("b", "integer").add("f", "double").add("k", "long").add("times", "long")
    return work.repartition(F.col("name"), F.col("first")).mapInPandas(draw, schema)


def interval(values: DataFrame, cell: list[str], value: str, confidence: float = 0.95) -> list[Column]:
    tail = (1 - confidence) / 2
    at = lambda q: F.percentile(F.col(value), F.lit(q))  # noqa: E731  linear between neighbours
    return [at(tail).alias("low"), at(1 - tail).alias("high")]


def curve_bounds(graded: DataFrame, cell: list[str], resamples: int = 1000, seed: int = 42, confidence: float = 0.95, ks: list[float] = E.GRID) -> DataFrame:
    """``cell, step, low, high``: percentile intervals of the information curve over resampled paraphrases, infinity as ``log2(n + 1)``."""
    reach = F.array(*(F.sum(F.when(F.col("f") >= k, F.col("times")).otherwise(0)) for k in ks))
    # the curve asks for scores alone: paraphrases that differ in their trials are one class
    alike = graded.select(*cell, "f", F.lit(1).cast("long").alias("k"))
    sums = resampled(alike, cell, resamples, seed).groupBy(*cell, "b").agg(F.sum("times").alias("n"), reach.alias("passing"))
    cap = F.log2(F.col("n") + F.lit(1.0))
    fi = F.transform("passing", lambda p: F.least(E.bits(p / F.col("n")), cap))
    long = sums.select(*cell, F.posexplode(fi).alias("step", "fi"))
    return long.groupBy(*cell, "step").agg(*interval(long, cell, "fi", confidence))


def curve_intervals(graded: DataFrame, cell: list[str], resamples: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """``cell, ci_low, ci_high``: the bounds of :func:`curve_bounds` as arrays."""
    bounds = curve_bounds(graded, cell, resamples, seed, confidence)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("step", c))), lambda s: s[c])  # noqa: E731  21 steps
    return bounds.groupBy(*cell).agg(listed("low").alias("ci_low"), listed("high").alias("ci_high"))


def intraclass_bounds(graded: DataFrame, cell: list[str], resamples: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """``cell, low, high, defined``: intervals of the intraclass correlation; NaN where it is defined in less than half of the resamples."""
    from .cells import intraclass

    t, f, k = F.col("times"), F.col("f"), F.col("k")
    sums = resampled(graded, cell, resamples, seed).groupBy(*cell, "b").agg(
        F.sum(t).alias("n"), F.sum(t * k).alias("trials"), F.sum(t * k * f).alias("hits"), F.sum(t * k * f * f).alias("squares"), F.sum(t * k * k).alias("trials2")
    )
    rho = sums.select(*cell, intraclass().alias("rho")).withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))
    out = rho.groupBy(*cell).agg(*interval(rho, cell, "rho", confidence), F.count("rho").alias("defined"))
    ok = F.col("defined") * 2 >= resamples
    return out.select(*cell, *(F.when(ok, F.col(c)).otherwise(E.nan()).alias(c) for c in ("low", "high")), "defined")
