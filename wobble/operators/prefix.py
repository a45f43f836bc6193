"""Running sums and ranks over a group's distinct values, in ranges, so that no group is one task.

The distinct values are stored once, in order of group and value, in ranges that Spark makes of their rows, twice as many as
shuffles have partitions, so ranges are alike however values lie. Sums run within each range of a group and over the ranges'
totals; both windows are small however many rows a group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def group_of(by: list[str]) -> Column:
    """The group's columns as one, which is never null, so that groups with nulls join too."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def distinct_values(rows: DataFrame, by: list[str], value: str, **sums: Column) -> DataFrame:
    """``g, v`` and sums (``n`` is the count) of each distinct value that is neither null nor NaN."""
    v = F.col(value).cast("double")
    full = rows.where(v.isNotNull() & ~F.isnan(v))
    return full.groupBy(group_of(by).alias("g"), v.alias("v")).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))


def running(values: DataFrame, *sums: str) -> DataFrame:
    """``values`` (``g, v``, a row each) with ``before_s``, the sum over lesser values of the group, ``total_s`` and ``up``, the next greater value."""
    # ranges by number: Spark would join small ones into one by the bytes they take on disk, and a range's sums sort its rows
    n = 2 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(values.repartitionByRange(n, "g", "v").withColumn("range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("g", "range").agg(F.min("v").alias("first"), *(F.sum(s).alias(s) for s in sums))
    w = Window.partitionBy("g").orderBy("range")
    earlier, every = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    offsets = totals.select(
        "g", "range", F.lead("first").over(w).alias("next"),
        *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}") for s in sums), *(F.sum(s).over(every).alias(f"total_{s}") for s in sums),
    )
    w = Window.partitionBy("g", "range").orderBy("v")
    inner = [F.coalesce(F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"before_{s}") for s in sums]
    within = placed.repartition(n, "g", "range").select("*", F.lead("v").over(w).alias("up"), *inner).join(offsets, ["g", "range"])
    return within.select(
        *(c for c in within.columns if c not in ("range", "next", "up") and not c.startswith(("_", "before_"))),
        F.coalesce("up", "next").alias("up"), *((F.col(f"before_{s}") + F.col(f"_{s}")).alias(f"before_{s}") for s in sums),
    )


def medians(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``g`` and the exact median of a column, nulls and NaNs left out."""
    values = running(distinct_values(rows, by, value), "n")
    inside = lambda at: (F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n"))
    low, high = F.floor((F.col("total_n") - 1) / 2), F.floor(F.col("total_n") / 2)
    return values.groupBy("g").agg(((F.max(F.when(inside(low), F.col("v"))) + F.max(F.when(inside(high), F.col("v")))) / 2).alias(name))
