"""Connected components of an edge table, by smallest labels with pointer jumping; lineage is cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import heavy_keys, matched, remove, scratch, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for each node of an edge: the smallest node of its component. Stored.

    A round takes over the smallest label among neighbours, then that label's own label. Labels of one round are a
    stored table; the driver sees only how many changed. A hub's edges and a large component's labels are heavy keys,
    which :func:`.shared.matched` joins apart.
    """
    spark = edges.sparkSession
    with scratch(spark) as keep:
        both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        both = stored(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
        hubs = heavy_keys(both, ["other"])
        labels = stored(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
        while True:
            theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
            near = matched(both, theirs, ["other"], heavy=hubs).groupBy("node").agg(F.min("theirs").alias("theirs"))
            hooked = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label")), "hooked")
            up = hooked.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            jumped = matched(hooked, up, ["label"], "left").select("node", "old", F.coalesce(F.least("label", "higher"), "label").alias("label"))
            before, labels = labels, stored(jumped, "labels")
            for done in (before, hooked):
                remove(spark, done.shared_path)
            if labels.where("label <> old").isEmpty():
                keep(labels)
                return labels.select("node", "label")
