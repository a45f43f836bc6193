"""Texts a few edits apart, and what of them stays if each is held against those kept before it.

Short texts meet by length, and only pairs whose counts of characters allow so few edits are measured: near ones are so many
among addresses that no part of a text tells them from others. Longer ones come from the pigeonhole rule: ``edits`` edits leave
one of ``edits + 1`` disjoint segments of a text as it was, and it is looked for where so many edits can have moved it. Words are
few, so texts of words are cut into ``CUTS`` times as many segments, and the rarest ``edits + 1`` are what others must hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .lineage import forget, written
from .prefix import group_of

CUTS = 2
#: Texts of fewer characters meet by length; so many of one length are a task's.
SHORT, BLOCK = 128, 1000
#: Characters that are counted together, up to four of each: four bits a kind, 16 kinds a number.
KINDS = tuple("0123456789aehinorst") + ("bp", "cg", "dl", "fm", "jkqx", "uw", "vyz", "/", ".", "-_", "?&", "=#", ":%")


def _counts(text: Column, size: Column) -> list[Column]:
    """Two numbers whose bits differ in no more places than counts of characters do: an edit changes two of them at most, one if it makes the text longer."""
    count = lambda kind: size - F.char_length(F.translate(text, kind + kind.upper() if kind.isalpha() else kind, ""))
    bits = [F.element_at(F.array(*(F.lit((1 << c) - 1).cast("long") for c in range(5))), (F.least(count(kind), F.lit(4)) + 1).cast("int")) for kind in KINDS]
    halves = (bits[:16], bits[16:32])
    out = []
    for half in halves:
        word = F.lit(0).cast("long")
        for place, b in enumerate(half):
            word = word.bitwiseOR(F.shiftleft(b, 4 * place))
        out.append(word)
    return out


def _near_short(texts: DataFrame, edits: int, between: bool) -> DataFrame:
    """``g, a, b, distance`` of near pairs whose shorter text has fewer than ``SHORT`` characters; ``BLOCK`` texts of a length meet all of another in a task."""
    size = F.char_length("t")
    signs = [c.alias(f"s{i}") for i, c in enumerate(_counts(F.col("t"), F.col("n")))]
    rows = texts.withColumn("n", size).where(F.col("n") < SHORT + edits).select("*", *signs)
    blocks = rows.groupBy("g", "n").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    more = F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("more")
    named = lambda side, *rest: [F.col(c).alias(f"{c}_{side}") for c in ("k", "t", "s0", "s1", *(["old"] if between else []))] + list(rest)
    x = rows.where(F.col("n") < SHORT).select("g", *named("a", "n", more)).withColumn("n", F.col("n") + F.col("more"))
    x = x.join(blocks, ["g", "n"]).withColumn("block", F.pmod(F.hash("k_a"), "blocks")).drop("blocks")
    y = rows.join(blocks, ["g", "n"]).select("g", "n", *named("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    apart = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))
    possible = ((F.col("more") > 0) | (F.col("k_a") < F.col("k_b"))) & (apart <= 2 * edits - F.col("more"))
    if between:
        possible = possible & (F.col("old_a") != F.col("old_b"))
    x = x.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "n", "block")  # few bytes make many pairs
    pairs = x.join(y, ["g", "n", "block"]).where(possible).select("g", F.col("t_a").alias("a"), F.col("t_b").alias("b"))
    return pairs.withColumn("distance", _distances(edits)("a", "b")).where(F.col("distance") <= edits)


def _distances(edits: int) -> Callable[..., Column]:
    """Edit distances of short texts, a batch of pairs at once; anything above ``edits`` where there are more. Only places that are so few apart are compared."""
    width = 2 * edits + 1

    @F.pandas_udf("int")
    def distances(a: pd.Series, b: pd.Series) -> pd.Series:
        n, m = a.str.len().to_numpy(int), b.str.len().to_numpy(int)
        rows, longest = len(a), int(max(n.max(initial=0), 1))
        codes = lambda texts, size: np.array(texts.tolist(), dtype=f"U{size}").view(np.uint32).reshape(rows, size).T.copy()
        x, y = codes(a, longest), np.zeros((longest + 2 * edits, rows), np.uint32)
        y[edits:] = codes(b, longest + edits)
        # now[d] is the distance of the first i characters of a and the first i + d - edits of b
        now = np.full((width, rows), 1000, np.int16)
        now[edits:] = np.arange(edits + 1)[:, None]
        end = m - n + edits
        out = np.full(rows, 1000, np.int16)
        near = (end >= 0) & (end < width)
        for i in range(longest + 1):
            if i:
                new = now + (y[i - 1 : i - 1 + width] != x[i - 1])
                np.minimum(new[:-1], now[1:] + 1, out=new[:-1])
                for d in range(1, width):
                    np.minimum(new[d], new[d - 1] + 1, out=new[d])
                now = new
            over = np.flatnonzero((n == i) & near)
            out[over] = now[end[over], over]
        return pd.Series(out.astype(np.int32))

    return distances


def _moves(edits: int) -> list[tuple[int, int]]:
    """How much longer the other text is, and by how much it can have moved a segment: edits before and behind are ``edits`` together."""
    return [(more, by) for more in range(edits + 1) for by in range(-edits, edits + 1) if abs(by) + abs(more - by) <= edits]


def _near_long(texts: DataFrame, edits: int, between: bool, words: bool) -> DataFrame:
    """``g, a, b, distance`` of near pairs by the segments that they have in common; of characters, those whose shorter text has ``SHORT`` or more.

    Of ``edits + 1`` segments in a row one is as it was that has no more edits before it than segments, and no more behind it, so
    the first can't have moved at all and the last only with the end. That holds of any ``edits + 1`` that are chosen.
    """
    units = X.tokens(F.col("t")) if words else F.col("t")
    size = F.size("u") if words else F.char_length("u")
    part = (lambda at, n: F.slice("u", at + 1, n)) if words else (lambda at, n: F.substring("u", at + 1, n))
    m = (CUTS if words else 1) * (edits + 1)
    least = 0 if words else SHORT
    flag = ["old"] if between else []
    cut = texts.select("g", "k", *flag, units.alias("u")).withColumn("n", size).where(F.col("n") >= least)
    begin = lambda i, n: F.floor(i * n / F.lit(m)).cast("int")
    key = lambda i, n, at: F.xxhash64(i, n, part(at, begin(i + 1, n) - begin(i, n)))

    own = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(i.alias("i"), key(i, F.col("n"), begin(i, F.col("n"))).alias("h")))
    segments = cut.select("g", "k", *flag, F.inline(own))
    if m > edits + 1:
        common = segments.groupBy("g", "h").agg(F.count("*").alias("times")).where("times > 1")
        rarity = F.row_number().over(Window.partitionBy("g", "k").orderBy("times", "i"))
        segments = segments.join(common, ["g", "h"], "left").withColumn("times", F.coalesce("times", F.lit(1))).withColumn("place", rarity)
        segments = segments.where(F.col("place") <= edits + 1)
    side = lambda name: [F.col("k").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in flag)]
    rare = segments.select("g", "h", *side("a"))

    # before segment i lie i others of which edits + 1 are chosen, m - 1 - i behind it
    tried = [(i, more, by) for more, by in _moves(edits) for i in range(m) if abs(by) <= i and abs(more - by) <= m - 1 - i]
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(more).alias("more"), F.lit(by).alias("move")) for i, more, by in tried))
    short = lambda c: F.col("n") - c["more"]
    where = lambda c: begin(c["i"], short(c)) + c["move"]
    fits = lambda c: (short(c) >= least) & (where(c) >= 0) & (where(c) + begin(c["i"] + 1, short(c)) - begin(c["i"], short(c)) <= F.col("n"))
    there = F.transform(F.filter(moves, fits), lambda c: F.struct(c["more"].alias("more"), key(c["i"], short(c), where(c)).alias("h")))
    held = cut.select("g", *side("b"), F.inline(there))
    pairs = rare.join(held, ["g", "h"]).where((F.col("a") != F.col("b")) & ((F.col("more") > 0) | (F.col("a") < F.col("b"))))
    if between:
        pairs = pairs.where(F.col("old_a") != F.col("old_b"))
    pairs = pairs.select("g", "a", "b").distinct()
    at = lambda name, x: texts.select("g", F.col("k").alias(name), F.col("t").alias(x))
    both = pairs.join(at("a", "x"), ["g", "a"]).join(at("b", "y"), ["g", "b"])
    distance = X.token_distance(F.col("x"), F.col("y")) if words else F.levenshtein("x", "y", edits)
    return both.select("g", F.col("x").alias("a"), F.col("y").alias("b"), distance.alias("distance")).where(F.col("distance").between(0, edits))


def near_pairs(rows: DataFrame, by: list[str], text: str, edits: int, words: bool = False, between: str | None = None) -> DataFrame:
    """``by, a, b, distance``: the pairs of different texts of a group that are ``edits`` edits (of characters, or of words) apart or fewer.

    Of a pair the shorter text is ``a``, of two of one length that with the lesser MD5. No pair is left out, whatever the length;
    null texts are in none. ``between`` names a flag, of which each text has one: only texts with different ones are paired. Of long
    texts only digests and hashes are shuffled until a pair is to be verified.
    """
    flag = [F.col(between).alias("old")] if between else []
    texts = rows.select(group_of(by).alias("g"), F.col(text).alias("t"), *flag).where("t is not null").distinct()
    texts = written(texts.withColumn("k", F.unhex(F.md5("t"))), "texts")
    near = _near_long(texts, edits, bool(between), words)
    if not words:
        near = _near_short(texts, edits, bool(between)).unionByName(near)
    return near.select(*(F.col("g")[c].alias(c) for c in by), "a", "b", "distance")


def overlapping(sets: DataFrame, share: float) -> DataFrame:
    """``g, a, b``: the pairs of ``g, k, s`` rows (a group, a key, a set of entries without repeats) of which both have ``share`` of the larger set in common; ``a < b``.

    In a common order of entries, the rarest of the group first, such sets have one of their first ``n - ceil(share n) + 1`` entries
    in common, and what follows must suffice. Pairs are made by group and entry, so a large group is dealt to many tasks.
    """
    entries = sets.select("g", "k", F.size("s").alias("n"), F.explode("s").alias("e"))
    often = entries.groupBy("g", "e").agg(F.count("*").alias("times")).where("times > 1")  # an entry of one set brings nobody together
    rarity = Window.partitionBy("g", "k").orderBy("times", "e")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("g", "k"))  # they are the rarest of all
    ordered = entries.join(often, ["g", "e"]).withColumn("place", F.row_number().over(rarity) + alone)
    need = F.greatest(F.ceil(share * F.col("n") - 1e-9), F.lit(1))
    first = written(ordered.where(F.col("place") <= F.col("n") - need + 1).select("g", "e", "k", "n", "place"), "prefixes")
    x, y = (first.select("g", "e", *(F.col(c).alias(f"{c}_{side}") for c in ("k", "n", "place"))) for side in "ab")
    larger = share * F.greatest("n_a", "n_b") - 1e-9
    enough = (F.least("n_a", "n_b") >= larger) & (F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1 >= larger)
    pairs = x.join(y, ["g", "e"]).where(F.col("k_a") < F.col("k_b")).where(enough).select("g", F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct()
    held = lambda side: sets.select("g", F.col("k").alias(side), F.col("s").alias(f"s_{side}"))
    both = pairs.join(held("a"), ["g", "a"]).join(held("b"), ["g", "b"])
    return both.where(F.size(F.array_intersect("s_a", "s_b")) >= share * F.greatest(F.size("s_a"), F.size("s_b")) - 1e-9).select("g", "a", "b")


def first_kept(pairs: DataFrame) -> DataFrame:
    """``v`` of the pairs ``u, v`` (``u`` comes before ``v``) that are not kept if, in order, each is kept that is near none kept before it.

    In a round all are kept that have nobody left before them, and those after them go. That is the sequential result, in as
    many rounds as the longest chain of decisions. Each round is a written table of the pairs still open.
    """
    open_ = written(pairs.select("u", "v").distinct(), "open")
    gone = None
    while not open_.isEmpty():
        kept = open_.select("u").distinct().join(open_.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        out = written(open_.join(kept, "u", "left_semi").select("v").distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        after = open_.join(out, "v", "left_anti").join(out.select(F.col("v").alias("u")), "u", "left_anti")
        after = written(after.join(kept, "u", "left_anti").select("u", "v"), "open")
        forget(open_)
        open_ = after
    return gone if gone is not None else open_.select("v")


def spread_out(rows: DataFrame, by: list[str], text: str, order: list[Column | str], edits: int, words: bool = False, pairs: Callable[[DataFrame], DataFrame] | None = None, steps: int = 1) -> DataFrame:
    """``by, text, kept`` of each group's different texts, blank ones aside: in order, a text is kept that is more than ``edits`` edits away from all kept before.

    A text's place is that of its first row by ``order``. ``pairs`` gives the near pairs (``by, a, b``) of ``by, text`` rows where
    another distance is wanted. Where most texts have many near ones, more ``steps`` spare their pairs: each step takes four times
    the texts of those before it, holds them against what these kept, and pairs only what is left.
    """
    rows = rows.withColumn("_g", group_of(by))
    ranked = rows.where(F.trim(text) != "").groupBy("_g", F.col(text).alias("text")).agg(F.min(F.struct(*order)).alias("p"))
    if steps > 1:
        ranked = ranked.repartitionByRange(4 ** (steps - 1), "p", "text").withColumn("range", F.spark_partition_id())
    ranked = written(ranked, "ranked")
    texts = ranked.select(*(F.col("_g")[c].alias(c) for c in by), "text", "_g")
    place = F.struct("_g", "p", "text")
    gone, kept = None, None
    for step in range(steps):
        now = ranked.where(F.col("range").between(4 ** (step - 1) if step else 0, 4**step - 1)).drop("range") if steps > 1 else ranked
        if kept is not None:
            met = kept.select("_g", "text", F.lit(True).alias("old")).unionByName(now.select("_g", "text", F.lit(False).alias("old")))
            met = near_pairs(met, ["_g"], "text", edits, words, "old")
            met = met.select("_g", F.explode(F.array("a", "b")).alias("text")).distinct()  # of these, those of this step are near a kept one
            out = written(now.join(met, ["_g", "text"], "left_semi").select("_g", "text"), "near")
            gone = out if gone is None else gone.unionByName(out)
            now = written(now.join(out, ["_g", "text"], "left_anti"), "left")
        own = now.select(*(F.col("_g")[c].alias(c) for c in by), "text", "_g")
        near = pairs(own.drop("_g")).withColumn("_g", group_of(by)) if pairs else near_pairs(own, ["_g"], "text", edits, words)
        both = near.select("_g", "a", "b").join(now.select("_g", F.col("text").alias("a"), place.alias("na")), ["_g", "a"])
        both = both.join(now.select("_g", F.col("text").alias("b"), place.alias("nb")), ["_g", "b"])
        out = first_kept(both.select(F.least("na", "nb").alias("u"), F.greatest("na", "nb").alias("v")))
        out = out.select(F.col("v._g").alias("_g"), F.col("v.text").alias("text"))
        gone = out if gone is None else gone.unionByName(out)
        if step + 1 < steps:
            stay = written(now.join(out, ["_g", "text"], "left_anti").select("_g", "text"), "kept")
            kept = stay if kept is None else kept.unionByName(stay)
    gone = gone.withColumn("kept", F.lit(False))
    return texts.join(gone, ["_g", "text"], "left").select(*by, "text", F.coalesce("kept", F.lit(True)).alias("kept"))
