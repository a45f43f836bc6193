"""Mixing sources to target weights (op 10): a multivariate-hypergeometric splitting tree.

The words of each source, its documents in a pseudo-random order, are one stream that is cut into blocks of equal
length (about ``BLOCKS`` of them, but of ``BLOCK_WORDS`` words at most and one at least). A source's quota is a whole
number of blocks. The quotas are split among output shards by a binary tree: each node deals its left half an exact
multivariate-hypergeometric draw from what the node holds, so every shard gets a random share and the shares add up. A
source's blocks, in a pseudo-random permutation, pass after pass, are then dealt to the shards in disjoint runs as long
as their shares; what no shard has room for is not taken. Each shard is shuffled on its own.

Shards and ranges of the pseudo-random order follow from the number of words and rows. A row per source is gathered by
the driver (sources are names of collections, few beside documents; see README), and a row per source and range is added
up by executors; blocks are decided where their documents are.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, after
the others; a source without words has target 0; repeated rows count each; equal ids are told apart by text, and
equal rows lie next to each other in the stream; other columns are kept by :func:`mixture`, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontamination import small
from .shared import SALTS, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 20240501
#: Blocks of a source, about, and words of a block at most.
BLOCKS, BLOCK_WORDS = 8192, 1 << 16
#: Words of a shard at most, about; of a small mix's shards at least, and how many those are at most.
SHARD_WORDS, LEAST_WORDS, FEW_SHARDS = 1 << 27, 1 << 18, 64
#: Rows of a range of a source's pseudo-random order, about.
RANGE_ROWS = 1 << 15


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight; what is above ``repeats`` times a source's size is shared anew."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), {i for i, s in enumerate(sizes) if s}
    while open_:
        per = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if per * weight[i] > repeats * sizes[i]}
        if not full:
            for i in open_:
                out[i] = per * weight[i]
            break
        for i in full:
            out[i] = repeats * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) that go to each shard (row); columns add up to ``quotas``."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        mid = (a + b) // 2
        total = int(have.sum())
        left = rng.multivariate_hypergeometric(have, total * (mid - a) // (b - a), method="marginals") if total else have
        todo += [(mid, b, have - left), (a, mid, left)]
    return out


def _affine(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """Factor and shift of the permutation b -> (factor * b + shift) mod n."""
    while n > 1:
        a = int(rng.integers(1, n))
        if math.gcd(a, n) == 1 and (n < 8 or n // 8 < a):
            return a, int(rng.integers(0, n))
    return 1, 0


def shard_count(words: float) -> int:
    return max(1, math.ceil(words / SHARD_WORDS), min(FEW_SHARDS, math.ceil(words / LEAST_WORDS)))


def plan(sizes: list[tuple[str | None, int]], *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, shards: int | None = None, seed: int = SEED) -> list[dict]:
    """A row per source: target, block length, blocks, permutation, and by shard the ends of its runs of dealt blocks."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    goal = targets([n for _, n in rows], weights, share, repeats)
    length = [max(1, min(BLOCK_WORDS, -(-n // BLOCKS))) for _, n in rows]
    blocks = [-(-n // k) for (_, n), k in zip(rows, length, strict=True)]
    quotas = [min(int(repeats * b), round(t * b / n)) if n else 0 for (_, n), b, t in zip(rows, blocks, goal, strict=True)]
    dealt = split_tree(quotas, shards or shard_count(sum(goal)), seed)
    rng, out = np.random.default_rng(seed + 1), []
    for i, (source, n) in enumerate(rows):
        a, c = _affine(blocks[i], rng)
        ends = np.cumsum(dealt[:, i]).tolist()
        out.append({"source": source, "source_size": n, "target": goal[i], "block_words": length[i], "blocks": blocks[i], "factor": a, "shift": c, "ends": ends})
    return out


PLAN = "source string, source_size long, target double, block_words long, blocks long, factor long, shift long, ends array<long>"


def _own(id_col: str, source_col: str, text_col: str, seed: int) -> list[Column]:
    """What tells rows apart: a hash of id, source and text, and the id beside it (a struct, which is never null)."""
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col).cast("string"), F.col(text_col))
    return [h.alias("h"), F.struct(F.col(id_col).alias("id")).alias("own")]


def placed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> tuple[DataFrame, DataFrame, int]:
    """``h, own, source, size, copies, first`` of each different row, the plan beside its source ``s``, and the number of shards.

    ``first`` is the first word in the source's stream of the first of its ``copies``.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(*_own(id_col, source_col, text_col, seed), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    slim = stored(slim.groupBy("h", "own", "source", "size").agg(F.count("*").alias("copies")), "mix-sizes")
    ranges = max(1, math.ceil(slim.count() / RANGE_ROWS))
    slim = slim.withColumn("range", F.pmod(F.shiftright("h", 7), F.lit(ranges)))
    by = stored(slim.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("n")), "mix-ranges")
    rows = plan([(r.source, int(r.n)) for r in by.groupBy("source").agg(F.sum("n").alias("n")).collect()], seed=seed, **options)
    table = docs.sparkSession.createDataFrame([tuple(r.values()) for r in rows], PLAN)
    table = table.select(F.col("source").alias("s"), F.struct(*table.columns).alias("plan"))
    near = small(table, sum(8 * len(r["ends"]) + 200 for r in rows))
    # a plan that is not small meets its source's rows in as many tasks as they have ranges
    table = near if near is not table else table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(ranges, SALTS) - 1))))

    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    w = Window.partitionBy("source", "range").orderBy("h", "own", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(w), F.lit(0))
    numbered = slim.withColumn("first", first).join(small(by, 64 * ranges * len(rows)), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    numbered = numbered.select("h", "own", "source", "size", "copies", (F.col("first") + F.col("before")).alias("first"))
    return numbered, table, len(rows[0]["ends"]) if rows else 1


# of one document (``size, first, plan``): its first and last block, a block's place in its source's permutation, the
# document's words in a block, and the shard that a block's copy of a pass is dealt to


def _last() -> Column:
    return F.col("first") + F.col("size") - 1


def _block(word: Column) -> Column:
    return F.floor(word / F.col("plan.block_words"))


def _place(block: Column) -> Column:
    return F.pmod(F.col("plan.factor") * block + F.col("plan.shift"), F.col("plan.blocks"))


def _begin(block: Column) -> Column:
    return F.greatest(block * F.col("plan.block_words"), F.col("first")) - F.col("first")


def _end(block: Column) -> Column:
    return F.least((block + 1) * F.col("plan.block_words"), _last() + 1) - F.col("first")


def _shard(at: Column, shards: int) -> Column:
    """How many runs end at or before a place, by bisection."""
    steps = F.array(*(F.lit(1 << j) for j in reversed(range(shards.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("plan.ends", low + step - 1) <= at, low + step).otherwise(low))


def with_pieces(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``pieces``: what the shards take of each document, an array of ``turn, block, shard, word_from, word_to``.

    Words are numbered from 0. A block's copy of a pass is taken if it is dealt to a shard.
    """
    quota = F.element_at("plan.ends", -1)
    at = lambda t, b: t * F.col("plan.blocks") + _place(b)
    of = lambda t: F.transform(
        F.filter("block_list", lambda b: at(t, b) < quota),
        lambda b: F.struct(t.alias("turn"), b.alias("block"), _shard(at(t, b), shards).alias("shard"), _begin(b).alias("word_from"), _end(b).alias("word_to")),
    )
    turns = F.sequence(F.lit(0).cast("long"), F.floor((quota - 1) / F.col("plan.blocks")))
    some = (F.col("size") > 0) & (quota > 0)
    listed = rows.withColumn("block_list", F.when(some, F.sequence(_block(F.col("first")), _block(_last()))))
    taken_ = F.flatten(F.transform(F.when(some, turns), of))
    return listed.withColumn("pieces", F.coalesce(taken_, F.expr("array()").cast("array<struct<turn:bigint,block:bigint,shard:int,word_from:bigint,word_to:bigint>>"))).drop("block_list")


def _planned(copies: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """Copies (``copy`` from 0) with their own first word, their source's plan and their pieces."""
    rows = copies.withColumn("first", F.col("first") + F.col("copy") * F.col("size"))
    same = F.col("source").eqNullSafe(F.col("s"))
    if "part" in table.columns:
        parts = table.agg(F.max("part")).first()[0] + 1
        same &= F.pmod(F.xxhash64("h", "copy"), F.lit(parts)) == F.col("part")
    return with_pieces(rows.join(table, same).drop("s", "part"), shards)


def taken(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``id, size, source_size, target, taken, n_shards, first_shard`` for each row of ``docs``.

    ``taken`` adds up the words of the document's pieces, repeats counted; ``n_shards`` are the shards that they were
    dealt to, ``first_shard`` is the first of them (null if there is none).
    """
    numbered, table, shards = placed(docs, id_col=id_col, **options)
    copies = numbered.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = _planned(copies, table, shards)
    words = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["word_to"] - p["word_from"])
    return rows.select(
        F.col("own.id").alias(id_col), "size", "plan.source_size", "plan.target", words.alias("taken"),
        F.size(F.array_distinct("pieces.shard")).alias("n_shards"), F.array_min("pieces.shard").alias("first_shard"),
    )


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", seed: int = SEED, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``, one for each document and pass that takes words of it.

    A document that a pass takes whole keeps its text; of one that is taken in part the drawn words are joined by
    spaces, and ``length_col``, if there, is set to the new length. A row stays whole and goes to the shard of its first
    drawn block; each shard is shuffled on its own.
    """
    numbered, table, shards = placed(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    rows = docs.select(*_own(id_col, source_col, text_col, seed), F.struct(*docs.columns).alias("row")).join(numbered, ["h", "own"])
    # of rows that are equal in id, source and text each takes one copy
    equal = Window.partitionBy("h", "own").orderBy("h")
    rows = rows.withColumn("copy", (F.row_number().over(equal) - 1).cast("long"))
    rows = _planned(rows, table, shards).where(F.size("pieces") > 0).drop("plan")
    rows = rows.withColumn("turn", F.explode(F.array_distinct("pieces.turn")))
    rows = rows.withColumn("pieces", F.filter("pieces", lambda p: p["turn"] == F.col("turn")))
    drawn = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["word_to"] - p["word_from"])
    whole, body = drawn == F.col("size"), F.col("row")[text_col]
    rows = rows.withColumn("words", F.when(~whole, F.regexp_extract_all(body, F.lit(f"({WORD})"))))
    run = lambda p: F.slice("words", (p["word_from"] + 1).cast("int"), (p["word_to"] - p["word_from"]).cast("int"))
    text = F.when(F.col("words").isNull(), body).otherwise(F.array_join(F.flatten(F.transform("pieces", run)), " "))
    rows = rows.select(F.element_at("pieces.shard", 1).alias("shard"), F.xxhash64("h", "copy", "turn").alias("order"), "row", text.alias("text"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "order")
    out = {c: F.col("row")[c].alias(c) for c in docs.columns} | {text_col: F.col("text").alias(text_col)}
    if length_col in out:
        out[length_col] = F.length("text").cast(docs.schema[length_col].dataType).alias(length_col)
    return rows.select(*out.values())
