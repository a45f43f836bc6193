"""Factor structure of metrics: ranks of all columns in one pass, their correlations, and a rotated factor solution a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import shared_path, written
from .prefix import group_of, running

#: Turns of a rotation at most, and the share by which a turn has to raise the criterion.
TURNS, GAIN = 100, 1e-6


def rank_vectors(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``g, w, ranks``: for rows that have all columns, the rank of each value in its group and column, ties at their mean, less the mean of ranks.

    They are read once and stored; ``w`` is 1. All columns are melted into one table of distinct values, whose running counts, in
    ranges, are the ranks, and these meet the rows again column by column: where a column has few values, without a shuffle.
    """
    spark = rows.sparkSession
    whole = F.array(*(F.col(v).cast("double") for v in values))
    full = rows.select(group_of(by).alias("g"), whole.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    full = written(full.select("g", *(F.get("x", F.lit(c)).alias(f"x{c}") for c in range(len(values)))), "rows")
    columns = F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"x{c}").alias("v")) for c in range(len(values))))
    long = full.select(F.col("g").alias("own"), F.inline(columns)).select(F.struct("own", "c").alias("g"), "v")
    found = running(long.groupBy("g", "v").agg(F.count("*").alias("n")), "n")
    ranks = found.select(F.col("g.c").alias("c"), F.col("g.own").alias("g"), "v", (F.col("before_n") + (F.col("n") + 1) / 2 - (F.col("total_n") + 1) / 2).alias("r"))
    path = shared_path(spark, "ranks")
    ranks.write.partitionBy("c").parquet(path)
    there = {r.c for r in spark.read.parquet(path).select("c").distinct().collect()} if not full.isEmpty() else set()  # columns
    schema = ranks.drop("c").schema
    for c in range(len(values)):
        # a folder of its own, whose size tells Spark whether to broadcast it
        own = spark.read.schema(schema).parquet(f"{path}/c={c}") if c in there else spark.createDataFrame([], schema)
        full = full.join(own.withColumnsRenamed({"v": f"x{c}", "r": f"r{c}"}), ["g", f"x{c}"]).drop(f"x{c}")
    return full.select("g", F.lit(1).cast("long").alias("w"), F.array(*(f"r{c}" for c in range(len(values)))).alias("ranks"))


def rank_correlations(rows: DataFrame, by: list[str], values: list[str], least: int = 3) -> DataFrame:
    """``g, n, rho``: Spearman's correlation of each pair of columns (in order, the first with the second, the first with the third, ...) over the rows that have all; null below ``least`` rows or without variance."""
    w, r = F.col("w"), lambda i: F.get("ranks", F.lit(i))
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values))]
    own = [F.sum(w * r(i) * r(i)).alias(f"q{i}") for i in range(len(values))]
    sums = rank_vectors(rows, by, values).groupBy("g").agg(F.sum("w").alias("n"), *own, *(F.sum(w * r(i) * r(j)).alias(f"p{i}_{j}") for i, j in pairs))

    def rho(i: int, j: int) -> Column:
        both = F.sqrt(F.col(f"q{i}")) * F.sqrt(F.col(f"q{j}"))
        return F.when((F.col("n") >= least) & (both > 0), F.col(f"p{i}_{j}") / F.when(both > 0, both))

    return sums.select("g", "n", F.array(*(rho(i, j) for i, j in pairs)).alias("rho"))


def rank_correlation(rows: DataFrame, a: str, b: str, by: list[str], name: str, least: int = 3) -> DataFrame:
    """``by, name, n``: Spearman's correlation over rows that have both columns; null below ``least`` rows or without variance."""
    out = rank_correlations(rows, by, [a, b], least)
    return out.select(*(F.col("g")[c].alias(c) for c in by), F.get("rho", F.lit(0)).alias(name), "n")


def rotated(loadings: np.ndarray) -> np.ndarray:
    """Loadings turned so that their squares vary most within each factor (varimax): each turn is the orthogonal matrix nearest to the criterion's gradient."""
    turn, reached = np.eye(loadings.shape[1]), 0.0
    for _ in range(TURNS):
        squares = (now := loadings @ turn) ** 2
        left, sizes, right = np.linalg.svd(loadings.T @ (now * (squares - squares.mean(axis=0))))
        turn = left @ right
        if sizes.sum() < reached * (1 + GAIN):
            break
        reached = float(sizes.sum())
    return loadings @ turn


def solution(matrix: np.ndarray, n_factors: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on, none negative, and the rotated loadings of the first factors; a factor's largest loading is positive."""
    matrix = np.nan_to_num((matrix + matrix.T) / 2)
    np.fill_diagonal(matrix, 1.0)
    sizes, vectors = np.linalg.eigh(matrix)
    sizes, vectors = np.maximum(sizes[::-1], 0.0), vectors[:, ::-1]
    n = min(n_factors, len(sizes))
    turned = rotated(vectors[:, :n] * np.sqrt(sizes[:n]))
    largest = turned[np.abs(turned).argmax(axis=0), np.arange(n)]
    return sizes, turned * np.where(largest < 0, -1.0, 1.0)


def factors(rows: DataFrame, by: list[str], values: list[str], n_factors: int = 3) -> DataFrame:
    """A row per group and column: ``by, name, loadings`` (of each factor), ``factor`` (from 0, that of the largest loading).

    ``rank`` and ``eigenvalue`` number the group's eigenvalues, as many as columns; ``explained`` is the share of their sum that the
    factors have. A correlation that is not defined counts as 0. A group's matrix is a row, whatever its number of rows.
    """
    p = len(values)
    above = np.triu_indices(p, 1)
    schema = "g {}, rank int, name string, eigenvalue double, loadings array<double>, factor int, explained double"

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                matrix = np.zeros((p, p))
                matrix[above] = [np.nan if x is None else x for x in r.rho]
                sizes, loadings = solution(matrix + matrix.T, n_factors)
                total = sizes.sum()
                yield pd.DataFrame({
                    "g": [r.g] * p, "rank": range(p), "name": values, "eigenvalue": sizes, "loadings": list(loadings),
                    "factor": np.abs(loadings).argmax(axis=1), "explained": sizes[:n_factors].sum() / total,
                })

    # the group travels as JSON text: pandas knows no structs as keys
    matrices = rank_correlations(rows, by, values)
    group = matrices.schema["g"].dataType.simpleString()
    out = matrices.select(F.to_json("g", {"ignoreNullFields": "false"}).alias("g"), "rho").mapInPandas(solved, schema.format("string"))
    out = out.withColumn("g", F.from_json("g", group))
    return out.select(*(F.col("g")[c].alias(c) for c in by), "rank", "name", "eigenvalue", "loadings", "factor", "explained")
