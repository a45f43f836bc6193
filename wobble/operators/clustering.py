"""Answer clusters: connected components of mutual entailment among a cell's distinct answers.

Answers that are equal are one. The entailed pairs are a relation. Labels spread along it round by round, each round a
written table, so neither a cell nor its pairs are gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import forget, written
from .neighbours import overlapping


def candidate_pairs(samples: DataFrame, cell: list[str], shared: Column | None = None, share: float | None = None) -> DataFrame:
    """Both directions of every pair of distinct answers of a cell: ``premise, hypothesis``.

    ``shared`` is an array of ``answer``, such as its words: then only answers that have an entry in common are paired, or,
    with ``share``, that have this share of the larger array in common; which loses nothing where a model cannot relate others.
    """
    distinct = samples.select(*cell, "answer").distinct()
    if shared is None:
        other = distinct.withColumnRenamed("answer", "hypothesis")
        return distinct.withColumnRenamed("answer", "premise").join(other, cell).where("premise <> hypothesis")
    # entries meet by digests of the answers; the texts come back once per pair
    keyed = distinct.withColumns({"_g": F.struct(*cell), "_k": F.unhex(F.md5("answer"))})
    if share is None:
        entries = keyed.select("_g", "_k", F.explode(shared).alias("_s"))
        pairs = entries.join(entries.withColumnRenamed("_k", "_l"), ["_g", "_s"]).where("_k < _l").select("_g", "_k", "_l").distinct()
    else:
        sets = written(keyed.select(F.col("_g").alias("g"), F.col("_k").alias("k"), shared.alias("s")).where(F.size("s") > 0), "sets")
        pairs = overlapping(sets, share).select(F.col("g").alias("_g"), F.col("a").alias("_k"), F.col("b").alias("_l"))
    named = pairs.join(keyed.select("_g", "_k", F.col("answer").alias("premise")), ["_g", "_k"])
    named = named.join(keyed.select("_g", F.col("_k").alias("_l"), F.col("answer").alias("hypothesis")), ["_g", "_l"])
    named = named.select(*(F.col("_g")[c].alias(c) for c in cell), "premise", "hypothesis")
    return named.unionByName(named.select(*cell, F.col("hypothesis").alias("premise"), F.col("premise").alias("hypothesis")))


def entailed(pairs: DataFrame, nli: DataFrame, cell: list[str], criterion: str = "label", threshold: float = 0.5) -> DataFrame:
    """Pairs ``a, b`` (a < b) of a cell that entail each other."""
    if criterion not in ("label", "prob"):
        raise ValueError("the criterion is 'label' or 'prob'")
    top = (F.col("entail") >= F.col("contradict")) & (F.col("entail") >= F.col("neutral"))
    yes = pairs.join(nli, ["premise", "hypothesis"]).where(top if criterion == "label" else F.col("entail") >= threshold)
    both = yes.groupBy(*cell, F.least("premise", "hypothesis").alias("a"), F.greatest("premise", "hypothesis").alias("b")).agg(F.count_distinct("premise").alias("n"))
    return both.where("n = 2").drop("n")


def clusters(samples: DataFrame, links: DataFrame, cell: list[str], order: list[str]) -> DataFrame:
    """``cluster`` of each sample: labels 0, 1, ... of a cell's components in the order in which they are met.

    An answer's label is where it is met first; a round takes over the least label of its neighbours, then that label's own.
    """
    first = written(samples.groupBy(*cell, "answer").agg(F.min(F.struct(*order)).alias("label")), "answers")
    edges = links.select(*cell, F.col("a").alias("answer"), F.col("b").alias("other")).unionByName(links.select(*cell, F.col("b").alias("answer"), F.col("a").alias("other")))
    # named by where answers are met: two labels a row
    at = lambda name, label: first.withColumnsRenamed({"answer": name, "label": label})
    edges = written(edges.join(at("answer", "x"), [*cell, "answer"]).join(at("other", "y"), [*cell, "other"]).select(*cell, "x", "y"), "links")
    # the first round: each takes the least of its neighbours and itself
    labels = written(edges.groupBy(*cell, "x").agg(F.min("y").alias("label")).withColumn("label", F.least("x", "label")), "labels")
    while True:
        near = edges.join(labels.select(*cell, F.col("x").alias("y"), F.col("label").alias("theirs")), [*cell, "y"]).groupBy(*cell, "x").agg(F.min("theirs").alias("theirs"))
        hooked = labels.select(*cell, "x", "label").join(near, [*cell, "x"]).select(*cell, "x", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        up = labels.select(*cell, F.col("label").alias("higher"), F.col("x").alias("label"))
        now = written(hooked.join(up, [*cell, "label"], "left").select(*cell, "x", "old", F.least("label", F.coalesce("higher", "label")).alias("label")), "labels")
        forget(labels)
        labels = now
        if now.where("label <> old").isEmpty():
            break
    labels = labels.select(*cell, F.col("x").alias("_x"), F.col("label").alias("_root"))
    rooted = first.join(labels, (F.col("label") == F.col("_x")) & _equal(cell, first, labels), "left")
    rooted = rooted.select(*(first[c] for c in cell), "answer", F.coalesce("_root", first["label"]).alias("root"))
    roots = rooted.select(*cell, "root").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy(*cell).orderBy("root")) - 1)
    named = rooted.join(roots, [*cell, "root"]).drop("root")
    return samples.join(named, [*cell, "answer"])


def _equal(cell: list[str], a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for c in cell:
        out = out & (a[c] == b[c])
    return out
