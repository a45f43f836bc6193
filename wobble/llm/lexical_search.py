"""Ranked lexical search over a tiered index (op 12).

**Index.** Terms of a text are counted where it is read, in Arrow batches; the counts are stored, document by document. A
posting's impact is what its term's weight is multiplied with. Postings of a term are dealt to tiers by impact, the highest
first: tier 0 holds the first ``TIERS[0]`` of them (and those of like impact), tier 1 those up to ``TIERS[1]``, the last tier
the rest. Where a tier ends is found from counts of ``LEVELS`` levels of impact, so no term's postings are gathered or
ranked; ``bounds`` keeps for each term and tier the largest impact below it.

**Search.** Items read tier 0 and add up what their terms give each document. The exact scores of the ``k`` best found so far
(from the stored counts) set the item's bar. Of its terms, those with the smallest bounds whose bounds add up to less than
the bar need not be read on: a document that has only such postings below cannot reach the bar. An item all of whose terms
are so has its proof; the others fall through to the next tier with the terms that lack it, and so on. At the end, each
document whose sum so far and the item's open bounds together reach the bar is scored exactly, so the result is that of a
scan of all postings.

Items are searched in blocks whose terms are small in bytes (``BROADCAST_BYTES``) and go to every task. An index may be
restricted to a vocabulary, as a batch of items known beforehand needs no other terms.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lower-cased. Scores are in
whole numbers (:func:`impact`). Defined results: null and empty texts have no term, count as no document and match nothing;
items without a term, or whose terms no document has, have no row. Items of one id, null too, are one item with the terms of
all; each of repeated documents is ranked; documents of equal score are in ascending order of their ids, null last.
Other columns, whatever their names, are ignored; empty tables give an empty result. Long texts are counted piece by piece.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontamination import BROADCAST_BYTES, _total, small
from .shared import bounded_batches, matched, scratch, shared_dir, stored, text_of, tidied, union

#: Postings of a term in the first tier, and in the first two; levels of impact that tiers are made of.
TIERS, LEVELS = (1024, 32768), 64
#: Impacts are below this.
HIGHEST = 1_000_000
#: Bytes of a vocabulary that workers hold; terms outside a larger one are dropped by a join.
VOCABULARY_BYTES = 8 << 20
#: Bytes of a text counted at a time, and rows of a batch given back.
PIECE, ROWS = 1 << 20, 1 << 17
#: Each byte of a term as it is kept, all others as a space.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    data, counts, at = text.translate(KEPT), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


def _counted(docs: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """``r, id, n, term, tf`` of ``r, id, text``: a row per term of a document (if wanted), and one with an empty term and no ``tf``; ``n`` counts all its terms."""
    kept = docs.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = kept.value
        for batch in batches:
            place, size, terms, tf = [], [], [], []

            def flushed() -> pa.RecordBatch:
                at = np.array(place, np.int64)
                r, key = (batch.column(c).take(pa.array(at)) for c in (0, 1))
                out = pa.RecordBatch.from_arrays([r, key, pa.array(size, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())], ["r", "id", "n", "term", "tf"])
                for x in (place, size, terms, tf):
                    x.clear()
                return out

            for i, text in enumerate(batch.column(2).to_pylist()):
                counts = term_counts(text)
                n = counts.total()
                found = counts.keys() if wanted is None else counts.keys() & wanted
                terms += (b"", *found)
                tf += (None, *map(counts.__getitem__, found))
                place += [i] * (len(found) + 1)
                size += [n] * (len(found) + 1)
                if len(terms) >= ROWS:
                    yield flushed()
            if terms:
                yield flushed()

    schema = docs.select("r", "id").schema.add("n", "long").add("term", "string").add("tf", "long")
    return bounded_batches(docs).mapInArrow(tidied(work), schema)


def weight(docs: int, df: Column) -> Column:
    """Of a term that ``df`` of ``docs`` documents have."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * docs + 2.0) / (2.0 * df + 1.0))).cast("long")


def impact(docs: int, terms: int, longest: int) -> Column:
    """Of ``tf`` occurrences in a document of ``n`` terms: ``1e9 tf div (1000 tf + 8 m)``, ``m = 10 + 90 n docs div terms``."""
    whole = "long" if 90 * docs * longest < 1 << 63 else "decimal(19,0)"  # 64 bits hold the product, or it is a decimal
    length = F.call_function("div", F.col("n").cast(whole) * F.lit(90 * docs).cast(whole), F.lit(max(terms, 1)).cast(whole))
    return F.call_function("div", F.lit(1_000_000_000) * F.col("tf"), 1000 * F.col("tf") + 8 * (10 + length))


@dataclass
class Index:
    """``counts`` (``r, id, n, term, tf, impact``), ``terms`` (``term, w, top, ends, bounds``) and ``postings`` (``term, r, impact, tier``)."""

    counts: DataFrame
    terms: DataFrame
    postings: DataFrame


def _tiered(counts: DataFrame, docs: int) -> DataFrame:
    """Per term: its weight, its largest impact ``top``, the lowest level in each tier but the last (``ends``), the largest impact below each (``bounds``)."""
    per_level = counts.groupBy("term", "level").agg(F.count("*").alias("c"), F.max("impact").alias("most"))
    above = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_level = per_level.withColumn("before", F.sum("c").over(above) - F.col("c"))
    ends = [F.min(F.when(F.col("before") < upto, F.col("level"))) for upto in TIERS]
    bounds = [F.coalesce(F.max(F.when(F.col("before") >= upto, F.col("most"))), F.lit(0)) for upto in TIERS]
    terms = per_level.groupBy("term").agg(F.sum("c").alias("df"), F.max("most").alias("top"), F.array(*ends).alias("ends"), F.array(*bounds).alias("bounds"))
    return terms.select("term", weight(docs, F.col("df")).alias("w"), "top", "ends", "bounds")


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: DataFrame | None = None) -> Index:
    """The tiered index of all documents: of all their terms, or of those in ``vocabulary`` (distinct ``term``, stored)."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
        held = vocabulary is not None and _total(vocabulary, 8, "term") <= VOCABULARY_BYTES
        wanted = frozenset(r.term.encode() for r in vocabulary.collect()) if held else None
        raw = stored(_counted(rows, wanted), "counts")
        sizes = raw.where("term = ''").agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.max("n"), F.lit(0)).alias("longest")).first()
        counts = raw.where("term <> ''").withColumn("impact", impact(*sizes))
        if vocabulary is not None and not held:
            counts = matched(raw.where("term <> ''"), vocabulary, ["term"]).withColumn("impact", impact(*sizes))
        counts = counts.withColumn("level", F.floor(F.col("impact") * LEVELS / HIGHEST).cast("int"))
        terms = keep(stored(_tiered(counts, sizes.docs), "terms"))
        ends = terms.select("term", "ends")
        near = small(ends, _total(ends, 64, "term"))
        dealt = counts.join(near, "term") if near is not ends else matched(counts, ends, ["term"])
        tier = sum((F.col("level") < F.col("ends")[k]).cast("int") for k in range(len(TIERS)))
        dealt = dealt.select("term", "r", "impact", tier.alias("tier")).sortWithinPartitions("tier", "term")
        path = shared_dir(spark, "postings")
        dealt.write.partitionBy("tier").parquet(path)
        postings = spark.read.schema(dealt.schema).parquet(path)
        postings.shared_path = path
        keep(raw)
        return Index(counts.drop("level"), terms, keep(postings))


def _best(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    """The ``k`` best rows of each ``q``, with their ``rank``; every task keeps ``k`` of each before any is shuffled."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def _exact(pairs: DataFrame, at: Index, asked: DataFrame) -> DataFrame:
    """``q, r, id, score`` of stored ``q, r``."""
    by_doc = stored(pairs.groupBy("r").agg(F.collect_list("q").alias("qs")), "searched")
    near = small(by_doc, by_doc.agg(F.sum(40 + 8 * F.size("qs"))).first()[0] or 0)
    found = at.counts.join(near, "r").select("r", "id", "term", "impact", F.explode("qs").alias("q"))
    found = found.join(F.broadcast(asked.select("q", "term", "w")), ["q", "term"])
    return found.groupBy("q", "r", "id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def _searched(at: Index, asked: DataFrame, k: int) -> DataFrame:
    """``q, rank, id, score`` for a block of items' terms ``q, term, w, top, bounds``, stored and small."""
    last = len(TIERS)
    with scratch(asked.sparkSession) as keep:
        state = stored(asked.withColumn("open", F.col("w") * F.col("top")).withColumn("reads", F.col("open") > 0), "terms-asked")
        sums = None
        for tier in range(last + 1):
            reading = F.broadcast(state.where("reads").select("q", "term", "w"))
            hits = at.postings.where(F.col("tier") == tier).join(reading, "term").select("q", "r", (F.col("w") * F.col("impact")).alias("score"))
            sums = stored((hits if sums is None else sums.unionByName(hits)).groupBy("q", "r").agg(F.sum("score").alias("score")), f"sums-{tier}")
            top = stored(_best(sums, k, F.desc("score"), F.col("r")).select("q", "r"), f"best-{tier}")
            bar = _exact(top, at, asked).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            bar = bar.select("q", F.when(F.col("n") >= k, F.col("least")).otherwise(0).alias("bar"))
            # terms that are read no more keep the bound where they stopped, and come first
            now = F.when(F.col("reads"), F.col("w") * (F.col("bounds")[tier] if tier < last else F.lit(0))).otherwise(F.col("open"))
            after = state.drop("bar").join(F.broadcast(bar), "q", "left").select("q", "term", "w", "bounds", "reads", now.alias("open"), F.coalesce("bar", F.lit(0)).alias("bar"))
            order = Window.partitionBy("q").orderBy("reads", "open", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            lacking = F.col("reads") & (F.col("open") > 0) & (F.sum("open").over(order) >= F.col("bar"))
            state = stored(after.withColumn("lacking", lacking).drop("reads").withColumnRenamed("lacking", "reads"), f"terms-{tier}")
            if state.where("reads").isEmpty():
                break
        bars = state.groupBy("q").agg(F.max("bar").alias("bar"), F.sum("open").alias("open"))
        near = stored(sums.join(F.broadcast(bars), "q").where(F.col("score") + F.col("open") >= F.col("bar")).select("q", "r"), "candidates")
        ranked = _best(_exact(near, at, asked).where("score > 0"), k, F.desc("score"), F.asc_nulls_last("id"), F.col("r"))
        return keep(stored(ranked.select("q", "rank", "id", "score"), "ranked"))


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``item, term``; ``item`` is a struct of the id, which is never null."""
    rows = items.select(F.struct(F.col(item_col).alias("id")).alias("item"), F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t"))
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return rows.select("item", F.explode(F.array_remove(F.split("t", gap), "")).alias("term")).distinct()


def searched(at: Index, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id") -> DataFrame:
    """The ``k`` documents of highest score above 0 of each item: its id, ``rank`` from 1, the document's id, ``score``."""
    with scratch(items.sparkSession) as keep:
        pairs = item_terms(items, item_col, text_col)
        names = keep(stored(pairs.select("item").distinct().withColumn("q", F.monotonically_increasing_id()), "items"))
        asked = stored(pairs.join(names, "item").join(at.terms, "term").select("q", "term", "w", "top", "bounds"), "asked")
        blocks = -(-_total(asked, 80, "term") // BROADCAST_BYTES) or 1
        parts = []
        for b in range(blocks):
            own = asked if blocks == 1 else stored(asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b), "asked-block")
            parts.append(keep(_searched(at, own, k)))
    return union(parts).join(names, "q").select(F.col("item.id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_col), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """:func:`searched` in an index of the items' own terms over all documents."""
    with scratch(docs.sparkSession) as keep:
        vocabulary = stored(item_terms(items, item_col, text_col).select("term").distinct(), "vocabulary")
        at = index(docs, doc_col, text_col, vocabulary)
        return keep(stored(searched(at, items, k, item_col, text_col, doc_col), "found"))
