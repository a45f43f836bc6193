"""Fill-in-the-middle transformation over relational units (op 13), in DataFrame functions only.

A text is a row of units (code points, words with their white space, or lines). Its units become rows: the matches of runs of
units are posexploded, windows sum up how many units and code points come before each run, and the two cuts of a document,
which are requests by the ordinal of a unit, are joined with the run that holds this unit. That run alone is exploded again,
in shorter runs (``RUNS``) and at last in single units, so that a document costs a few hundred rows and not one for each
of its units. The requests' offsets are summed up for each document, and ``substring`` cuts the text there.

The table is stored in buckets of the partition its rows came from. Whatever is grouped or joined is grouped or joined by
that partition and the row, so nothing is shuffled: the text is written once and read where it lies. (Spark shuffles for such
joins unless ``spark.sql.requireAllClusterKeysForCoPartition`` is false; :func:`transformed` sets this in its session.)

A document's cuts, and its form, are drawn from the SHA-256 of the seed and its id. ``plain`` texts are left as they are:
empty ones, those that hold a marker (the output could not be taken apart again), and the share that the rate leaves. ``psm``
is prefix, suffix, middle behind their markers, ``spm`` suffix, prefix, middle.

Defined results: null is the empty text; a null id is drawn as if it were the empty string; each of repeated rows is
transformed, in the same way; other columns, whatever their names, are ignored; an empty table gives an empty result. A
text of any length is cut run by run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, stored_by, text_of

#: Patterns whose matches, one after another, make up any text. None looks at what is before or behind its match.
UNITS = {"code point": r"(?s:.)", "word": r"(?s:\s*\S+\s*|\s+)", "line": r"(?:[^\n]*\n|[^\n]+)"}
#: Units of a run: a request finds its run in rows of the first length, then within that in rows of the next.
RUNS = (1024, 32, 1)
MARKERS = ("<P>", "<S>", "<M>")
#: A document's rows are told apart by its partition and its number.
ROW = ["p", "r"]


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers: the first groups of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _runs(segments: DataFrame, keys: list[str], ride: list[str], unit: str, size: int) -> DataFrame:
    """Runs of ``size`` units (fewer at the end) of each segment: ``run`` (from 0), ``part``, and the units and code points ``units_to``, ``chars_to`` up to its end."""
    pattern = UNITS[unit] if size == 1 else f"(?>{UNITS[unit]}){{1,{size}}}+"
    found = segments.select(*keys, *ride, F.posexplode(F.regexp_extract_all("segment", F.lit(pattern), F.lit(0))).alias("run", "part"))
    chars = F.char_length("part")
    units = F.lit(1) if size == 1 else chars if unit == "code point" else F.regexp_count("part", F.lit(UNITS[unit]))
    found = found.withColumns({"units": units.cast("long"), "chars": chars.cast("long")})
    upto = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumns({"units_to": F.sum("units").over(upto), "chars_to": F.sum("chars").over(upto)})


def _offsets(rows: DataFrame, requests: DataFrame, unit: str) -> DataFrame:
    """``p, r, cut, offset``: the code points up to the end of the unit that each request ``p, r, cut, ordinal`` (from 1) names."""
    first, *finer = RUNS
    runs = _runs(rows.withColumnRenamed("text", "segment"), ROW, [], unit, first)
    asked = requests.withColumn("run", F.floor((F.col("ordinal") - 1) / first).cast("int"))
    met = runs.join(asked, [*ROW, "run"])
    met = met.select(*ROW, "cut", (F.col("ordinal") - F.col("units_to") + F.col("units")).alias("ordinal"), (F.col("chars_to") - F.col("chars")).alias("base"), F.col("part").alias("segment"))
    for size in finer:  # a request that has met its run rides with it
        inside = _runs(met, [*ROW, "cut"], ["ordinal", "base"], unit, size)
        inside = inside.where((F.col("ordinal") <= F.col("units_to")) & (F.col("ordinal") > F.col("units_to") - F.col("units")))
        before = F.col("chars_to") - (0 if size == 1 else F.col("chars"))
        met = inside.select(*ROW, "cut", (F.col("ordinal") - F.col("units_to") + F.col("units")).alias("ordinal"), (F.col("base") + before).alias("base"), F.col("part").alias("segment"))
    return met.select(*ROW, "cut", F.col("base").alias("offset"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers))
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def transformed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "code point", seed: int = 1, rate: int = 90, spm: int = 20, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """A row per document: its id, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain), ``output``.

    ``rate`` per cent of the documents are transformed, ``spm`` per cent of those with the suffix first.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    with scratch(spark) as keep:
        rows = docs.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        rows = keep(stored_by(rows, "p", "units"))
    h1, h2, h3, h4 = draws("id", seed)
    marked = reduce(Column.__or__, (F.contains("text", F.lit(m)) for m in markers))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")

    counts = _runs(rows.select(*ROW, F.col("text").alias("segment")), ROW, [], unit, RUNS[0]).groupBy(*ROW).agg(F.sum("units").alias("n"))
    cuts = rows.select(*ROW, h1.alias("h1"), h2.alias("h2"), plain.alias("plain")).where(~F.col("plain")).join(counts, ROW)
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    requests = cuts.select(*ROW, F.posexplode(F.array(F.least(a, b), F.greatest(a, b))).alias("cut", "ordinal")).where("ordinal > 0")
    at = _offsets(rows.select(*ROW, "text"), requests, unit)
    at = at.groupBy(*ROW).agg(*(F.coalesce(F.max(F.when(F.col("cut") == k, F.col("offset"))), F.lit(0)).alias(f"cut{k}") for k in (0, 1)))

    out = rows.select(*ROW, "id", "text", form.alias("form")).join(counts.hint("shuffle_hash"), ROW, "left").join(at.hint("shuffle_hash"), ROW, "left")
    start, end = (F.coalesce(f"cut{k}", F.lit(0)) for k in (0, 1))
    prefix, middle, suffix = F.substring("text", F.lit(1), start), F.substring("text", start + 1, end - start), F.substring("text", end + 1, F.char_length("text"))
    pre, suf, mid = map(F.lit, markers)
    output = F.when(F.col("form") == "psm", F.concat(pre, prefix, suf, suffix, mid, middle)).when(F.col("form") == "spm", F.concat(suf, suffix, pre, prefix, mid, middle)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "form", F.when(cut, start).alias("prefix_chars"), F.when(cut, end - start).alias("middle_chars"), output.alias("output"),
    )
