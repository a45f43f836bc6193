"""Benchmark decontamination by size-partitioned MinHash containment search (op 5), in DataFrame functions only.

A text is its set of five-word shingles, hashed; an item of one to four words is one shingle, all its words, and is
looked for among the documents' shingles of that length. Items are partitioned by how many shingles they have, and each
partition is searched with its own sketches: of every item the ``s`` smallest hashes, a bottom-``s`` MinHash sketch, of
which a document must hold ``m``. Larger items ask for more (``HITS``), and ``s = u - ceil(t * u) + m`` follows from the
partition's upper size ``u`` and the containment threshold ``t``: a document that holds a share ``t`` of an item's
shingles misses at most ``u - ceil(t * u)`` of them, so the search loses nothing, and documents of any length are found,
because their side of the search is all their hashes. Candidates are verified with the shingles themselves: the exact
share of the item's distinct shingles in the document.

Documents' hashes meet the sketches where the text is read. Documents are told apart by a digest of their text, so
copies are verified once; only candidates' texts are shuffled. Tables that are small in bytes (``BROADCAST_BYTES``,
counted) are broadcast; else the same joins shuffle.

Words are runs of letters, marks and digits in lower case. Defined results: null and empty texts have no shingle and
match nothing; null ids are kept as null. A row is judged by its own text alone, never joined with another of its id:
rows of one document id and one item are reported once, with the largest share among them. Of items with one id the
shingles are joined. Other columns, whatever their names, are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, stored, text_of, union

WORDS, THRESHOLD = 5, 0.8
#: Sketch hashes that a document must hold, by the largest number of shingles of an item for which so few do.
HITS = {8: 1, 32: 2}
MOST_HITS = 3
#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 16 << 20
GAP = r"[^\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def shingles(rows: DataFrame, keep: str, k: int = WORDS) -> DataFrame:
    """``keep`` and ``s1 .. sk``, a row per run of ``k`` of the words ``w``, in order."""
    parts = [F.slice("w", j, F.size("w")).alias(f"s{j}") for j in range(2, k + 1)]
    return rows.select(keep, F.inline(F.arrays_zip(F.col("w").alias("s1"), *parts))).where(F.col(f"s{k}").isNotNull())


def _parts(k: int) -> list[str]:
    return [f"s{j}" for j in range(1, k + 1)]


def _hash(k: int) -> Column:
    return F.xxhash64(F.lit(k), *_parts(k)).alias("h")


def _string(k: int) -> Column:
    return F.concat_ws(" ", *_parts(k)).alias("s")


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    """``df``, with a broadcast hint if its bytes, which the caller has counted, allow it."""
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def _total(df: DataFrame, width: int, *strings: str) -> int:
    """Bytes of a stored table: ``width`` a row, and those of its strings."""
    own = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in strings), F.lit(width))
    return df.agg(F.sum(own)).first()[0] or 0


def sketches(items: DataFrame, upper: int, threshold: float = THRESHOLD) -> DataFrame:
    """``h, item, hits``: the sketches of one size partition of items (``item, n, hashes``; ``n`` up to ``upper``)."""
    most = next((m for u, m in sorted(HITS.items()) if upper <= u), MOST_HITS)
    hits = F.least(F.lit(most), F.ceil(threshold * F.col("n") - 1e-9)).cast("int")
    missed = upper - F.ceil(F.lit(threshold * upper - 1e-9))
    return items.select("item", hits.alias("hits"), F.explode(F.slice(F.array_sort("hashes"), F.lit(1), (missed + hits).cast("int"))).alias("h"))


def _verified(texts: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``t, item, n, n_shared``: texts of ``t, text`` by digest, and the items of ``item, text`` that they hold. Stored."""
    with scratch(texts.sparkSession) as keep:
        words = items.select("item", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
        words = stored(words.withColumn("k", F.least(F.size("w"), F.lit(WORDS))), "item-words")
        lengths = sorted(r.k for r in words.select("k").distinct().collect()) or [WORDS]  # five values at most
        sets = union([shingles(words.where(F.col("k") == k), "item", k).select("item", _string(k), _hash(k)) for k in lengths])
        sets = stored(sets.distinct(), "items")
        each = sets.groupBy("item").agg(F.collect_set("h").alias("hashes"), F.count("*").alias("n"))
        each = stored(each.withColumn("upper", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))).cast("int")), "item-hashes")
        uppers = sorted(r.upper for r in each.select("upper").distinct().collect()) or [1]  # one value per power of two
        sketch = stored(union([sketches(each.where(F.col("upper") == u), u, threshold) for u in uppers]), "sketches")

        worded = texts.select("t", words_of(F.col("text")).alias("w"))
        found = union([shingles(worded, "t", k).select("t", _hash(k)) for k in lengths])
        found = found.join(small(sketch, _total(sketch, 40, "item")), "h").dropDuplicates(["t", "item", "h"])
        found = found.groupBy("t", "item").agg(F.count("*").alias("n"), F.first("hits").alias("hits")).where("n >= hits")
        wanted = stored(found.select("t").distinct(), "candidates")

        exact = texts.join(small(wanted, _total(wanted, 64)), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
        exact = stored(exact.select("t", words_of(F.col("text")).alias("w")), "candidate-words")
        held = union([shingles(exact, "t", k).select("t", _string(k)) for k in lengths])
        held = held.join(small(sets.select("item", "s"), _total(sets, 48, "item", "s")), "s").distinct()
        counted = held.groupBy("t", "item").agg(F.count("*").alias("n_shared"))
        named = counted.join(small(each.select("item", "n"), _total(each, 48, "item")), "item")
        return keep(stored(named.where(F.col("n_shared") >= threshold * F.col("n") - 1e-9).select("t", "item", "n", "n_shared"), "contained"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item that it holds a share ``threshold`` of.

    Columns: both ids, ``n_item`` and ``n_shared`` (distinct shingles of the item, and those in the document),
    ``containment``.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(doc_col).alias("doc"), text.alias("text"), digest(text).alias("t"))
    # a struct is never null, so items without an id join like others
    named = items.select(F.struct(F.col(item_col).alias("id")).alias("item"), text_of(text_col).alias("text"))
    pairs = _verified(rows.select("t", "text"), named, threshold)
    pairs = rows.select("doc", "t").join(small(pairs, _total(pairs, 80, "item")), "t")
    pairs = pairs.groupBy("doc", "item", "n").agg(F.max("n_shared").alias("n_shared"))
    share = F.col("n_shared") / F.col("n")
    return pairs.select(F.col("doc").alias(doc_col), F.col("item.id").alias(item_col), F.col("n").alias("n_item"), "n_shared", share.alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, told apart by their texts: ids may be null or repeated."""
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    rows = docs.withColumn(own, digest(text_of(text_col)))
    named = items.select(F.struct(F.col(item_col).alias("id")).alias("item"), text_of(text_col).alias("text"))
    pairs = _verified(rows.select(F.col(own).alias("t"), text_of(text_col).alias("text")), named, threshold)
    bad = stored(pairs.select(F.col("t").alias("_bad")).distinct(), "contaminated")
    return rows.join(small(bad, _total(bad, 64)), rows[own] == bad["_bad"], "left_anti").drop(own)
