"""Scores of answers from relations of model outputs; models themselves are providers (see :mod:`wobble.sources.providers`).

``nli`` has a row per pair of texts: ``premise, hypothesis, entail, contradict, neutral``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT, LENIENT, CONTRADICTION = 0.7, 0.5, 0.5


def passes(entail: str = "entail", contradict: str = "contradict", lenient: bool = False) -> Column:
    return ((F.col(entail) >= (LENIENT if lenient else STRICT)) & (F.col(contradict) < CONTRADICTION)).cast("int")


def multi_gold(answers: DataFrame, nli: DataFrame, key: list[str]) -> DataFrame:
    """``f`` and ``f_lenient``: whether any gold (array ``golds``) entails the answer; 0 without golds. An absent answer is empty."""
    rows = answers.select(*key, F.coalesce("answer", F.lit("")).alias("hypothesis"), F.explode_outer(F.filter("golds", lambda g: F.trim(g) != "")).alias("premise"))
    joined = rows.join(nli, ["premise", "hypothesis"], "left")
    best = lambda lenient: F.coalesce(F.max(passes(lenient=lenient)), F.lit(0))
    return joined.groupBy(*key).agg(best(False).alias("f"), best(True).alias("f_lenient"))


def resolved_golds(one: str, many: str) -> Column:
    """The plural golds if there are any, else the single one: trimmed, not blank, each once; null if none."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""))
    given = F.when(F.size(many) > 0, F.col(many)).otherwise(F.filter(F.array(F.col(one)), lambda x: x.isNotNull()))
    return F.when(F.size(clean(given)) > 0, clean(given))


def resolved_hops(hops: Column) -> Column:
    """Hop questions with ``#k`` replaced by the answer of hop k; numbers of no hop stay."""

    def step(text: Column, k: Column) -> Column:
        with_bound = F.concat(F.lit("#"), k.cast("string"), F.lit("(?![0-9])"))
        # a replacement's dollar signs and backslashes stand for themselves
        answer = F.regexp_replace(F.get(hops, (k - 1).cast("int"))["sub_answer"], r"([\\$])", r"\\$1")
        return F.regexp_replace(text, with_bound, answer)

    ks = F.when(F.size(hops) > 0, F.sequence(F.lit(1), F.size(hops))).otherwise(F.array().cast("array<int>"))
    return F.transform(hops, lambda h: F.aggregate(ks, h["sub_question"], step))


def facts(hops: Column) -> Column:
    """A statement per hop: its resolved question and answer, or the answer alone."""
    pairs = F.arrays_zip(resolved_hops(hops).alias("q"), F.transform(hops, lambda h: h["sub_answer"]).alias("a"))
    return F.transform(pairs, lambda p: F.when(F.trim(p["q"]) == "", p["a"]).otherwise(F.concat(F.trim(p["q"]), F.lit(" "), p["a"])))


def chain_scores(responses: DataFrame, hops: DataFrame, nli: DataFrame, key: list[str], scaffolded: DataFrame | None = None) -> DataFrame:
    """Share of a question's hops that a response recovers, in the direction that entails more, or that its scaffold gives.

    ``responses``: key and ``question_id, response``; ``hops``: ``question_id, hop, fact``; ``scaffolded``: ``question_id, hop``.
    """
    rows = responses.join(hops, "question_id")
    there = nli.select(F.col("premise").alias("response"), F.col("hypothesis").alias("fact"), F.col("entail").alias("ea"), F.col("contradict").alias("ca"))
    back = nli.select(F.col("premise").alias("fact"), F.col("hypothesis").alias("response"), F.col("entail").alias("eb"), F.col("contradict").alias("cb"))
    rows = rows.join(there, ["response", "fact"], "left").join(back, ["response", "fact"], "left")
    forward = F.coalesce(F.col("ea") >= F.col("eb"), F.lit(True))
    found = F.coalesce(F.when(forward, passes("ea", "ca")).otherwise(passes("eb", "cb")), F.lit(0))
    if scaffolded is not None:
        rows = rows.join(scaffolded.select("question_id", "hop").distinct().withColumn("given", F.lit(1)), ["question_id", "hop"], "left")
        found = F.greatest(found, F.coalesce("given", F.lit(0)))
    return rows.groupBy(*key).agg(F.avg(found.cast("double")).alias("chain_f"), F.count("*").alias("n_hops"))


def majority(votes: DataFrame, key: list[str], vote: str = "vote") -> DataFrame:
    """``admits``: more than half of all votes are yes."""
    return votes.groupBy(*key).agg((F.sum(F.coalesce(F.col(vote), F.lit(False)).cast("int")) * 2 > F.count("*")).alias("admits"))


def exact_middles(admitted: DataFrame, key: str = "question_id") -> DataFrame:
    """The first attempt that admits just the readings wanted (``attempt, text, interpretation, wanted, admits``)."""
    fits = admitted.groupBy(key, "attempt", "text").agg(F.bool_and(F.col("admits") == F.col("wanted")).alias("exact")).where("exact")
    return fits.groupBy(key).agg(F.min_by("text", "attempt").alias("text"), F.min("attempt").alias("attempts"))


def failure_kind(parsed: str = "parsed", entail: str = "entail", contradict: str = "contradict") -> Column:
    """Why a final answer scored 0 though its chain scored high."""
    near = (F.col(entail) >= 0.4) & (F.col(entail) < STRICT) & (F.col(contradict) < CONTRADICTION)
    return F.when(F.coalesce(F.col(parsed), F.lit("")) == "", "parse_failure").when(near, "nli_too_strict").otherwise("model_wrong")
