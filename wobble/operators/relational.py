"""Read-side analytics: merging, pivots, paired contrasts, audits, sampling and universes of paraphrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from .lineage import written
from .prefix import distinct_values, group_of, medians, running


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in order; a partial maximum, not a sort."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("_last")).select(*key, *(F.col("_last")[c].alias(c) for c in rest))


def merged(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of parts with different columns; of rows with one key that of the last part."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return last_wins(out, key, ["_part"]).drop("_part")


def pending(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is still to do: the wanted cells that are not done."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def by_level(rows: DataFrame, key: list[str], level: str, levels: list, values: list[str]) -> DataFrame:
    """Means of values by level, a column ``value_level`` each; no pivot is needed for levels that are known."""
    at = lambda v, x: F.avg(F.when(F.col(level) == x, F.col(v))).alias(f"{v}_{x}")
    return rows.groupBy(*key).agg(*(at(v, x) for v in values for x in levels))


def paired_deltas(rows: DataFrame, key: list[str], level: str, low, high, values: list[str], size: str = "n_paraphrases") -> tuple[DataFrame, DataFrame]:
    """Differences high less low of pairs with equal sizes, and how many pairs are left out (those without one level too)."""
    wide = by_level(rows, key, level, [low, high], [*values, size])
    a, b = F.col(f"{size}_{low}"), F.col(f"{size}_{high}")
    odd = ~a.eqNullSafe(b) | a.isNull()
    deltas = wide.where(~odd).select(*key, *((F.col(f"{v}_{high}") - F.col(f"{v}_{low}")).alias(f"d_{v}") for v in values))
    return deltas, wide.agg(F.sum(odd.cast("long")).alias("n_excluded"), F.count("*").alias("n_pairs"))


def described(rows: DataFrame, values: list[str]) -> DataFrame:
    """``name, mean, median, low, high, positive`` of each column, nulls left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values))).alias("p")
    long = rows.select(pairs).select("p.name", "p.x").where("x is not null")
    rest = long.groupBy("name").agg(F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg((F.col("x") > 0).cast("double")).alias("positive"))
    return rest.join(medians(long, ["name"], "x", "median").select("g.name", "median"), "name")


def octants(rows: DataFrame, block: list[str], values: list[str], least: int, name: str) -> DataFrame:
    """Occupancy of the corners that median splits (strictly above) of three values make in each block of ``least`` rows or more."""
    full = rows.where(" and ".join(f"{v} is not null" for v in values)).withColumn("_g", group_of(block))
    long = full.select("_g", F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values))).alias("p")).select("_g", "p.name", "p.x")
    mids = medians(long, ["_g", "name"], "x", "m").select("g._g", "g.name", "m")
    cuts = mids.groupBy("_g").agg(*(F.max(F.when(F.col("name") == v, F.col("m"))).alias(f"_{v}") for v in values))
    cuts = cuts.join(full.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") >= least), "_g")
    cuts = written(cuts, "cuts")  # a row per block; Spark knows its size and broadcasts it, so that no block's rows are one task's
    flags = [(F.col(v) > F.col(f"_{v}")).cast("int").alias(f"{v}_high") for v in values]
    split = full.join(cuts, "_g").select(*block, name, *flags)
    return split.groupBy(*block, *(f"{v}_high" for v in values)).agg(F.count("*").alias("n"), F.min(name).alias("example"))


def plausibility(rows: DataFrame, values: list[str], where: Column) -> DataFrame:
    """Nulls, NaNs and infinities of each column."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values))).alias("p")
    long = rows.where(where).select(pairs).select("p.name", "p.x")
    total = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return long.groupBy("name").agg(total(F.col("x").isNull()).alias("n_null"), total(F.isnan("x")).alias("n_nan"), total(F.abs("x") == E.INF).alias("n_inf"), F.count("*").alias("n"))


def first_per(rows: DataFrame, by: list[str], order: list[Column | str], n: int, index: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; every task keeps ``n`` of each before they are shuffled."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)
    return ranked.withColumn("_r", F.col("_r") - 1).withColumnRenamed("_r", index) if index else ranked.drop("_r")


def seeded(seed: int, key: str) -> Column:
    """A seeded pseudo-random order of keys: the SHA-256 of both, as hexadecimal digits."""
    return F.sha2(F.concat(F.lit(f"{seed}::"), F.col(key).cast("string")), 256)


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by equal shares of the strata, the remainder one each to the largest, what a small stratum lacks made up from the rest.

    The order is a seeded hash. Of each stratum only the ``n`` first of each of 256 ranges of hashes go on, so neither a
    stratum nor the table is sorted as a whole.
    """
    hashed = rows.withColumn("_h", seeded(seed, key))
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    order = Window.orderBy(F.desc("_size"), stratum)  # a row per stratum
    strata = F.count("*").over(Window.partitionBy())
    quota = counts.withColumn("_quota", F.floor(n / strata) + (F.row_number().over(order) <= n % strata).cast("int")).drop("_size")
    few = Window.partitionBy(stratum, F.substring("_h", 1, 2)).orderBy("_h", key)
    some = hashed.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= n)
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key)))
    ranked = ranked.join(quota.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s")))
    first = [F.when(F.col("_r") <= F.col("_quota"), 0).otherwise(1), F.col("_h"), F.col(key)]
    return ranked.orderBy(*first).limit(n).drop("_h", "_quota", "_r", "_s")


def threshold_counts(rows: DataFrame, by: list[str], score: Column, thresholds: list[float]) -> DataFrame:
    """How many rows would pass each threshold."""
    at = F.array(*(F.struct(F.lit(t).alias("threshold"), F.sum((score >= t).cast("long")).alias("n")) for t in thresholds))
    return rows.groupBy(*by).agg(at.alias("_t")).select(*by, F.inline("_t"))


def repair_plan(universes: DataFrame, cells: DataFrame, least: int, key: str = "question_id", level: str = "spec_level") -> tuple[DataFrame, DataFrame]:
    """Both tables without the questions that have fewer than ``least`` paraphrases at any level (all their levels go)."""
    short = universes.groupBy(key, level).agg(F.count("*").alias("n")).where(F.col("n") < least).select(key).distinct()
    return universes.join(short, key, "left_anti"), cells.join(short, key, "left_anti")


def evidence_prefix(snippets: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """Whole snippets from the first on until the cap on characters; the first always."""
    w = Window.partitionBy(key).orderBy(order)
    total = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return snippets.withColumn("_t", total).withColumn("_first", F.row_number().over(w) == 1).where((F.col("_t") <= most) | F.col("_first")).drop("_t", "_first")


def gold_set() -> Column:
    """The answers a level is held to: the constraint's, else all at level 0, else (or if none) the target's."""
    base = F.when(F.col("spec_level") == 0, F.col("all_answers")).otherwise(F.col("target_answers"))
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(some(F.col("constraint_answers")), some(base), F.col("target_answers"))


def seeded_places(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``key, place``: the distinct values of a column, numbered from 0 in a seeded order.

    They are counted in ranges of their hashes first, so no task orders them all.
    """
    names = rows.select(key).distinct().withColumn("_h", seeded(seed, key)).withColumn("_b", F.substring("_h", 1, 3))
    ranges = names.groupBy("_b").agg(F.count("*").alias("_n"))  # 4096 at most
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    dealt = names.withColumn("_p", place).join(ranges.select("_b", before.alias("_before")), "_b")
    return dealt.select(key, (F.col("_before") + F.col("_p")).alias("place"))


def group_folds(rows: DataFrame, group: str, n_splits: int, seed: int) -> DataFrame:
    """Each group's fold: groups in a seeded order are dealt in turn, so no group is in two folds and folds differ by one group at most."""
    return seeded_places(rows, group, seed).select(group, F.pmod("place", F.lit(n_splits)).cast("int").alias("fold"))


def auroc(rows: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve from average ranks; null if a class is missing. Rows without a label or a score are left out."""
    known = rows.where(F.col(label).isNotNull())
    values = running(distinct_values(known, by, score, pos=(F.col(label) == 1).cast("long")), "n", "pos")
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    pos, n = F.sum("pos"), F.sum("n")
    neg = n - pos
    value = (F.sum(F.col("pos") * rank) - pos * (pos + 1) / 2) / F.when((pos > 0) & (neg > 0), pos * neg)
    return values.groupBy("g").agg(value.alias("auroc"), n.alias("n")).select(*(F.col("g")[c].alias(c) for c in by), "auroc", "n")


def otsu(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The midpoint between neighbouring values that leaves least variance within the two sides; the first of equal ones, the value itself if it is alone."""
    x = F.col(value).cast("double")
    v = running(distinct_values(rows, by, value, s=x, q=x * x), "n", "s", "q")
    n1, s1, q1 = (F.col(f"before_{c}") + F.col(c) for c in ("n", "s", "q"))
    m, st, qt = F.col("total_n") - n1, F.col("total_s"), F.col("total_q")
    cost = q1 - s1 * s1 / n1 + (qt - q1) - (st - s1) * (st - s1) / F.when(m > 0, m)
    v = v.withColumn("mid", (F.col("v") + F.col("up")) / 2).withColumn("cost", F.round(cost, 6))
    best = F.min_by("mid", F.when(F.col("up").isNotNull(), F.struct("cost", "mid")))
    return v.groupBy("g").agg(F.coalesce(best, F.max("v")).alias("gamma")).select(*(F.col("g")[c].alias(c) for c in by), "gamma")
