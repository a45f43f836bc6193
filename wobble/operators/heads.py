"""Probe heads over feature vectors: standardising, mass-mean, ridge and logistic heads, calibration and control tasks.

Rows have ``key`` columns, a group (the question, which is never split between folds), ``fold``, a feature array ``x``
and a label ``y``. Closed forms are sums by fold and dimension, subtracted from their totals, so all folds take one pass;
fitted heads are Spark's own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import probes
from .audits import per_stratum
from .factors import rank_correlation
from .lineage import written
from .relational import auroc, group_folds, otsu, seeded_places

EPSILON = 1e-8
PENALTIES, RIDGES = (0.001, 0.01, 0.1, 1.0), (1e2, 1e3, 1e4, 1e5)


def folded(rows: DataFrame, group: str, n_splits: int, seed: int) -> DataFrame:
    """Rows with the fold of their group; the groups' folds are written, so that Spark knows whether to broadcast them."""
    return rows.join(written(group_folds(rows, group, n_splits, seed), "folds"), group)


def scaling(rows: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and deviation (a population's, never zero) of each dimension of ``x``."""
    long = rows.select(F.posexplode("x").alias("d", "v"))
    each = long.groupBy("d").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + EPSILON).alias("sd")).collect()  # a row per dimension
    each.sort(key=lambda r: r.d)
    return [r["mean"] for r in each], [r.sd for r in each]


def standardised(x: Column, mean: Column, sd: Column) -> Column:
    return F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), sd, lambda a, b: a / b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def mass_mean(rows: DataFrame, key: list[str]) -> DataFrame:
    """``key, y, score``: each row along the difference of the class means of the rows outside its fold, all standardised by them."""
    long = rows.select("fold", "y", F.posexplode("x").alias("d", "v"))
    is_one = F.col("y") == 1
    own = long.groupBy("fold", "d").agg(
        F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.sum(is_one.cast("long")).alias("n1"), F.sum(F.when(is_one, F.col("v")).otherwise(0.0)).alias("s1")
    )
    every = Window.partitionBy("d")  # a row per fold
    n, s, q, n1, s1 = (F.sum(c).over(every) - F.col(c) for c in ("n", "s", "q", "n1", "s1"))
    sd = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))) + EPSILON
    n0 = n - n1
    w = (s1 / F.when(n1 > 0, n1) - (s - s1) / F.when(n0 > 0, n0)) / sd
    rest = own.select("fold", "d", (s / n).alias("mean"), sd.alias("sd"), w.alias("w")).where("w is not null")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("d", c))), lambda p: p[c])
    heads = rest.groupBy("fold").agg(*(listed(c).alias(c) for c in ("mean", "sd", "w")))
    return rows.join(heads, "fold").select(*key, "y", dot(standardised(F.col("x"), F.col("mean"), F.col("sd")), F.col("w")).alias("score"))


@dataclass
class Head:
    """A fitted head: how its features are scaled, the model, and the curve from scores to labels."""

    name: str
    binary: bool
    mean: list[float]
    sd: list[float]
    model: LogisticRegressionModel | LinearRegressionModel
    curve: IsotonicRegressionModel | None = None
    cut: float | None = None
    checks: dict[str, float] = field(default_factory=dict)

    def scored(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """``rows`` with the raw score of ``x``."""
        w, b = self.model.coefficients.toArray().tolist(), float(self.model.intercept)
        scaled = standardised(F.col("x"), F.array(*map(F.lit, self.mean)), F.array(*map(F.lit, self.sd)))
        return rows.withColumn(name, dot(scaled, F.array(*map(F.lit, w))) + F.lit(b))

    def predicted(self, rows: DataFrame, name: str | None = None) -> DataFrame:
        """``rows`` with the calibrated value of ``x``, in [0, 1]."""
        name = name or self.name
        scored = self.scored(rows, "_score")
        if self.curve is None:
            return scored.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_score")))).drop("_score")
        return calibrated(scored, self.curve, "_score", name).drop("_score")


def calibrated(rows: DataFrame, curve: IsotonicRegressionModel, score: str, name: str) -> DataFrame:
    """The isotonic curve at a score, level beyond its ends, cut to [0, 1]; interpolated from its own points."""
    at, value = (v.toArray().tolist() for v in (curve.boundaries, curve.predictions))
    xs, ys = F.array(*map(F.lit, at)), F.array(*map(F.lit, value))
    s = F.col(score)
    i = F.size(F.filter(xs, lambda x: x <= s))  # points up to the score
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    inner = F.when(x1 > x0, y0 + (y1 - y0) * (s - x0) / F.when(x1 > x0, x1 - x0)).otherwise(y0)
    v = F.when(i == 0, F.get(ys, 0)).when(i == F.size(xs), F.get(ys, i - 1)).otherwise(inner)
    return rows.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def fitted(train: DataFrame, binary: bool, strength: float, name: str = "head") -> Head | None:
    """A head over ``x, y``: logistic with inverse penalty ``strength``, or ridge with penalty ``strength``; None if a class is missing."""
    mean, sd = scaling(train)
    classes = train.agg(F.count_distinct("y").alias("c"), F.count("*").alias("n"), F.stddev_pop(F.col("y").cast("double")).alias("sd")).first()
    if not mean or binary and classes.c < 2:
        return None
    scaled = standardised(F.col("x"), F.array(*map(F.lit, mean)), F.array(*map(F.lit, sd)))
    rows = train.select(array_to_vector(scaled).alias("features"), F.col("y").cast("double").alias("label"))
    if binary:
        model = LogisticRegression(regParam=1.0 / (strength * classes.n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(rows)
    else:
        # Spark scales the label, which divides the penalty by the label's deviation
        model = LinearRegression(regParam=strength * (classes.sd or 1.0) / classes.n, elasticNetParam=0.0, standardization=False, solver="normal").fit(rows)
    return Head(name, binary, mean, sd, model)


def out_of_fold(rows: DataFrame, key: list[str], binary: bool, strength: float) -> DataFrame:
    """``key, group columns, y, score`` of every row by the head fitted on the rows outside its fold (folds are few)."""
    out = None
    for fold in sorted(r.fold for r in rows.select("fold").distinct().collect()):
        head = fitted(rows.where(F.col("fold") != fold), binary, strength)
        if head is not None:
            part = head.scored(rows.where(F.col("fold") == fold)).select(*key, "fold", "y", "score")
            out = part if out is None else out.unionByName(part)
    return out


def quality(scored: DataFrame, binary: bool) -> float | None:
    """Area under the curve, or rank correlation, of ``score`` and ``y``."""
    if binary:
        return auroc(scored, "y", "score", []).first().auroc
    return rank_correlation(scored, "y", "score", [], "rho").first().rho


def nested(rows: DataFrame, key: list[str], group: str, binary: bool, grid: tuple[float, ...] | None = None, inner: int = 3, seed: int = 43) -> tuple[float | None, dict[int, float]]:
    """Quality of out-of-fold scores with each fold's strength chosen by ``inner`` folds of the other rows; and what was chosen."""
    scores, picked = probes.nested(rows, key, group, binary, grid or (PENALTIES if binary else RIDGES), inner, seed)
    return quality(scores, binary), {r.outer: r.strength for r in picked.collect()}  # a row per fold


# calibration and controls


def calibration_error(rows: DataFrame, value: str, label: str, by: list[str], bins: int = 10) -> DataFrame:
    """``by, ece``: over equal bins of a value in [0, 1], the mean gap of value and label, weighted by rows; a value of 1 is in no bin."""
    place = F.floor(F.col(value) * bins).cast("int")
    each = rows.groupBy(*by, place.alias("_bin")).agg(F.count("*").alias("n"), F.avg(value).alias("v"), F.avg(F.col(label).cast("double")).alias("y"))
    gap = F.when(F.col("_bin") < bins, F.abs(F.col("v") - F.col("y")) * F.col("n")).otherwise(0.0)
    return each.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def permuted_labels(rows: DataFrame, group: str, order: list[str], label: str, seed: int, name: str = "permuted") -> DataFrame:
    """Rows with the labels of another group: groups are dealt each other's in two seeded orders; a pattern is repeated or cut to fit."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    one = seeded_places(rows, group, seed).withColumnRenamed(group, "_to")
    two = seeded_places(rows, group, seed + 1).join(sizes, group).withColumnRenamed(group, "_from")
    donors = one.join(two, "place").select("_to", "_from", "_size")
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    pattern = numbered.select(F.col(group).alias("_from"), F.col("_i").alias("_j"), F.col(label).alias(name))
    placed = numbered.join(donors, F.col(group) == F.col("_to")).withColumn("_j", F.pmod("_i", "_size").cast("int")).drop("_to", "_size", "_i")
    return placed.join(pattern, ["_from", "_j"]).drop("_from", "_j")


def flipped_labels(rows: DataFrame, group: str, label: str, seed: int, name: str = "flipped") -> DataFrame:
    """Rows with the labels of a seeded half of the groups inverted."""
    half = group_folds(rows, group, 2, seed).select(group, (F.col("fold") == 1).alias("_flip"))
    return rows.join(half, group).withColumn(name, F.when(F.col("_flip"), 1 - F.col(label)).otherwise(F.col(label))).drop("_flip")


def baseline(rows: DataFrame, label: str, value: str) -> DataFrame:
    """``auroc`` of one column as a score, in the better of its two directions."""
    return auroc(rows, label, value, []).select(F.greatest("auroc", 1 - F.col("auroc")).alias("auroc"))


def verified(rows: DataFrame, by: list[str], label: str, score: str, length: str) -> DataFrame:
    """``by, auroc, baseline, n``: a head's area under the curve, and that of the length alone in the better of its directions."""
    own = auroc(rows, label, score, by)
    alone = auroc(rows, label, length, by).select(*by, F.greatest("auroc", 1 - F.col("auroc")).alias("baseline"))
    return own.join(alone, by, "left").select(*by, "auroc", "baseline", "n")


def margins(checked: DataFrame, head: str) -> DataFrame:
    """``head, mean, low, high, baseline, margin``: over models, each head's areas and how far their mean is above that of its own baselines."""
    mean, base = F.avg("auroc"), F.avg("baseline")
    return checked.groupBy(head).agg(mean.alias("mean"), F.min("auroc").alias("low"), F.max("auroc").alias("high"), base.alias("baseline"), (mean - base).alias("margin"))


def replayed(rows: DataFrame, level: str, key: str, known: str, n: int, seed: int) -> DataFrame:
    """Of each level ``n`` rows whose ``known`` label is there, in a seeded order, with what their gauges (``vagueness, reliability, dispersion, fragility``) say: a report."""
    some = per_stratum(rows.where(F.col(known).isNotNull()), level, key, n, seed)
    return some.withColumn("said", feedback(*map(F.col, ("vagueness", "reliability", "dispersion", "fragility"))))


def train(name: str, rows: DataFrame, key: list[str], group: str, *, binary: bool, strength: float, n_splits: int = 5, seed: int = 42, length: str | None = None) -> Head:
    """A head over rows with ``x, y``: checked by out-of-fold scores and controls, calibrated on them, and fitted anew on all rows.

    Labels that are not 0 or 1 are split where the two sides vary least, if the head is binary. Rows without a label are left
    out. The calibration error is that of curves fitted on one half of the groups and judged on the other.
    """
    known = rows.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))
    cut = None
    if binary and known.where(~F.col("y").isin(0, 1)).limit(1).count():
        cut = otsu(known, "y", []).first().gamma
        known = known.withColumn("y", (F.col("y") > cut).cast("int"))
    split = folded(known, group, n_splits, seed)
    scored = out_of_fold(split, [*key, group], binary, strength).cache()
    checks = {"n": float(known.count()), "questions": float(known.select(group).distinct().count())}
    checks["quality"] = quality(scored, binary)
    if binary:
        checks["permuted"] = auroc(permuted_labels(scored, group, key, "y", seed), "permuted", "score", []).first().auroc
        checks["flipped"] = auroc(flipped_labels(scored, group, "y", seed), "flipped", "score", []).first().auroc
        if length:
            checks["length"] = baseline(known, "y", length).first().auroc
    checks["ece"] = cross_fitted_error(scored, group, seed + 7)
    curve = isotonic(scored)
    head = fitted(known, binary, strength, name)
    scored.unpersist()
    head.curve, head.cut, head.checks = curve, cut, checks
    return head


def isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    rows = scored.select(F.col("y").cast("double").alias("label"), F.col("score").alias("features"), F.lit(1.0).alias("weight"))
    return IsotonicRegression(weightCol="weight").fit(rows)


def cross_fitted_error(scored: DataFrame, group: str, seed: int) -> float:
    """Mean calibration error of two halves of the groups, each judged by the curve of the other."""
    halves = scored.drop("fold").join(group_folds(scored, group, 2, seed), group)
    errors = []
    for side in (0, 1):
        judged = calibrated(halves.where(F.col("fold") == side), isotonic(halves.where(F.col("fold") != side)), "score", "value")
        errors.append(calibration_error(judged, "value", "y", []).first().ece)
    return sum(errors) / len(errors)


def gauges(rows: DataFrame, heads: list[Head]) -> DataFrame:
    """``rows`` with a calibrated column per head."""
    for head in heads:
        rows = head.predicted(rows)
    return rows


def save(heads: list[Head], spark: SparkSession, path: str) -> None:
    """The heads below a folder: their numbers as a table, their models beside it."""
    about = [(i, h.name, h.binary, h.mean, h.sd, h.cut, h.curve is not None, {k: v for k, v in h.checks.items() if v is not None}) for i, h in enumerate(heads)]
    schema = "i int, name string, binary boolean, mean array<double>, sd array<double>, cut double, curved boolean, checks map<string, double>"
    spark.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/heads")
    for i, h in enumerate(heads):
        h.model.write().overwrite().save(f"{path}/model-{i}")
        if h.curve is not None:
            h.curve.write().overwrite().save(f"{path}/curve-{i}")


def load(spark: SparkSession, path: str) -> list[Head]:
    out = []
    for r in spark.read.parquet(f"{path}/heads").orderBy("i").collect():
        kind = LogisticRegressionModel if r.binary else LinearRegressionModel
        curve = IsotonicRegressionModel.load(f"{path}/curve-{r.i}") if r.curved else None
        out.append(Head(r.name, r.binary, r["mean"], r.sd, kind.load(f"{path}/model-{r.i}"), curve, r.cut, dict(r.checks)))
    return out


# labels


def head_labels(prompts: DataFrame, metrics: DataFrame, key: list[str]) -> DataFrame:
    """Prompts (``key, paraphrase_idx, spec_level``) with the labels of all heads: vagueness, reliability, dispersion, fragility; null where unknown."""
    each = metrics.select(*key, F.posexplode("f_graded_per_paraphrase").alias("paraphrase_idx", "reliability"))
    cells = metrics.select(*key, F.col("h_sem_mean").alias("dispersion"), F.col("rho_f").alias("fragility"))
    out = prompts.withColumn("vagueness", (F.col("spec_level") == 0).cast("double"))
    return out.join(each, [*key, "paraphrase_idx"], "left").join(cells, key, "left")


def joined_label(prompts: DataFrame, metrics: DataFrame, key: list[str], target: str) -> DataFrame:
    """Prompts with one label: an array's entry by ``paraphrase_idx``, or the cell's number on all its prompts."""
    if metrics.schema[target].dataType.typeName() == "array":
        each = metrics.select(*key, F.posexplode(target).alias("paraphrase_idx", target))
        return prompts.join(each, [*key, "paraphrase_idx"], "left")
    return prompts.join(metrics.select(*key, F.col(target).cast("double").alias(target)), key, "left")


# Bounds and wording of the feedback.
BOUNDS = {"vagueness": 0.65, "possibly_vague": 0.45, "dispersion": 0.60, "fragility": 0.60}
BANDS = (0.35, 0.65)
MESSAGES = {
    "vagueness": "⚠ Too vague: the prompt likely admits multiple readings — state exactly which case/entity/time you mean.",
    "possibly_vague": "~ Possibly underspecified — consider naming the intended interpretation explicitly.",
    "dispersion": "⚠ Unstable output expected: re-asking will likely yield different answers.",
    "fragility": "(experimental) Wording-sensitive: small rephrasings may change the outcome.",
    "stable": "Prompt looks specific and stable — no changes suggested.",
}


def feedback(vagueness: Column, reliability: Column, dispersion: Column, fragility: Column) -> Column:
    """The messages that calibrated gauges give; a null gauge says nothing."""
    over = lambda c, name: F.coalesce(c, F.lit(0.0)) >= BOUNDS[name]
    say = lambda when, name: F.when(when, F.lit(MESSAGES[name]))
    vague = F.when(over(vagueness, "vagueness"), F.lit(MESSAGES["vagueness"])).when(over(vagueness, "possibly_vague"), F.lit(MESSAGES["possibly_vague"]))
    band = F.when(reliability < BANDS[0], "LOW").when(reliability < BANDS[1], "MEDIUM").otherwise("HIGH")
    percent = F.format_string("%.0f", F.bround(reliability * 100, 0))
    reliable = F.when(reliability.isNotNull(), F.concat(F.lit("Predicted answer reliability: "), band, F.lit(" (≈"), percent, F.lit("%).")))
    said = F.array_compact(F.array(vague, reliable, say(over(dispersion, "dispersion"), "dispersion"), say(over(fragility, "fragility"), "fragility")))
    calm = (F.size(said) == 1) & reliability.isNotNull() & (reliability >= BANDS[1])
    return F.when(calm, F.concat(said, F.array(F.lit(MESSAGES["stable"])))).otherwise(said)
