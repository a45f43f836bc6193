"""Ladders of context and of reasoning, and levels of specificity: one question becomes a row per rung."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E

LEVELS = (0, 2, 4, 6, 8, 10)


def _places(paragraphs: Column, gold: bool | None = None) -> Column:
    every = F.when(F.size(paragraphs) > 0, F.sequence(F.lit(0), F.size(paragraphs) - 1)).otherwise(F.array().cast("array<int>"))
    if gold is None:
        return every
    return F.filter(every, lambda i: F.coalesce(F.get(paragraphs, i)["is_gold"], F.lit(False)) == gold)


def gold_first(paragraphs: Column) -> Column:
    return F.concat(_places(paragraphs, True), _places(paragraphs, False))


def distractor_first(paragraphs: Column) -> Column:
    return F.concat(_places(paragraphs, False), _places(paragraphs, True))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def shuffled(seed: pd.Series, n: pd.Series) -> pd.Series:
    """0 to n - 1, shuffled by the Mersenne Twister with the seed: results depend on that generator."""

    def one(s: int, k: int) -> list[int]:
        order = list(range(k))
        random.Random(s).shuffle(order)
        return order

    return pd.Series([one(int(s), int(k)) for s, k in zip(seed, n, strict=True)], dtype=object)


def random_order(question: Column, paragraphs: Column, base_seed: int) -> Column:
    return shuffled(E.stable_hash(question) + base_seed, F.size(paragraphs))


def ladder(questions: DataFrame, kind: str, levels: tuple[int, ...] = LEVELS, base_seed: int = 42) -> DataFrame:
    """A row per question and level: the first paragraphs of the ladder's order, their titles and how many are gold."""
    order = {"gold_first": gold_first, "distractor_first": distractor_first}
    p = F.col("paragraphs")
    perm = random_order(F.col("question_id"), p, base_seed) if kind == "random" else order[kind](p)
    rungs = questions.withColumn("permutation", perm).select("question_id", "paragraphs", "permutation", F.posexplode(F.array(*map(F.lit, levels))).alias("level_idx", "level"))
    rungs = rungs.withColumn("paragraph_indices", F.slice("permutation", F.lit(1), F.col("level")))
    return rungs.select(
        "question_id",
        F.lit(kind).alias("ladder_type"),
        "level_idx",
        "level",
        "paragraph_indices",
        F.transform("paragraph_indices", lambda i: F.get(p, i)["title"]).alias("paragraph_titles"),
        F.size(F.filter("paragraph_indices", lambda i: F.get(p, i)["is_gold"])).alias("gold_count"),
        "permutation",
        F.lit("context").alias("ladder_family"),
    )


def all_ladders(questions: DataFrame, levels: tuple[int, ...] = LEVELS, base_seed: int = 42) -> DataFrame:
    one, *rest = (ladder(questions, k, levels, base_seed) for k in ("random", "gold_first", "distractor_first"))
    for r in rest:
        one = one.unionByName(r)
    return one


def reasoning_ladder(questions: DataFrame) -> DataFrame:
    """Rungs that give all hops but the last, one more on each; ``gold_count`` counts the different paragraphs given."""
    hops = F.col("question_decomposition")
    some = questions.where(F.assert_true(F.size(hops) > 0, F.lit("a reasoning ladder needs a decomposition")).isNull())
    rungs = some.select("question_id", "paragraphs", "question_decomposition", F.explode(F.sequence(F.lit(0), F.size(hops) - 1)).alias("hops_provided"))
    given = F.transform(F.slice(hops, F.lit(1), F.col("hops_provided")), lambda h: h["supporting_paragraph_idx"])
    valid = F.array_distinct(F.filter(given, lambda i: i.isNotNull() & (i >= 0) & (i < F.size("paragraphs"))))
    return rungs.select("question_id", F.lit("reasoning").alias("ladder_family"), F.col("hops_provided").alias("level_idx"), F.col("hops_provided").alias("level"), F.size(valid).alias("gold_count"), valid.alias("paragraph_indices"), "hops_provided")


def broken_ladders(rows: DataFrame) -> DataFrame:
    """Rows that break an invariant: a level's size, its prefix, or more gold than there is."""
    return rows.where((F.size("paragraph_indices") != F.least(F.col("level"), F.size("permutation"))) | (F.slice("permutation", F.lit(1), F.col("level")) != F.col("paragraph_indices")))


def bit_table(makes: DataFrame) -> DataFrame:
    """Rows with ``n`` and ``k`` at every ``level`` from 0 to ``n``: ``b_theo`` and ``coverage``."""
    rows = makes.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("n"))))
    args = (F.col("n"), F.col("k"), F.col("level"))
    return rows.withColumns({"b_theo": E.b_theo(*args), "coverage": E.hop_coverage(*args)})


# levels of specificity


def answers_of(interpretations: Column, target: Column) -> Column:
    """All answers, the target's first, each once."""
    return F.array_distinct(F.concat(F.get(interpretations, target)["answers"], F.flatten(F.transform(interpretations, lambda i: i["answers"]))))


def collides(interpretations: Column, target: Column) -> Column:
    """Whether the target's answers meet those of any other interpretation, case aside."""
    low = lambda a: F.transform(a, F.lower)
    mine = low(F.get(interpretations, target)["answers"])
    others = F.filter(interpretations, lambda x, i: i != target)
    return F.exists(others, lambda x: F.arrays_overlap(low(x["answers"]), mine))


def evidence_text(evidence: Column) -> Column:
    return F.lower(F.array_join(F.transform(evidence, lambda e: F.concat(e["title"], F.lit(" "), e["snippet"])), " "))


def covered(interpretations: Column, evidence: Column, target: Column) -> Column:
    """Whether the evidence holds any answer of the target; false without evidence."""
    text = evidence_text(evidence)
    found = F.exists(F.get(interpretations, target)["answers"], lambda a: F.contains(text, F.lower(a)))
    return (F.coalesce(F.size(evidence), F.lit(0)) > 0) & found


def leak_free(text: Column, interpretations: Column) -> Column:
    """No answer of three or more characters stands in the text."""
    answers = F.flatten(F.transform(interpretations, lambda i: i["answers"]))
    return ~F.exists(answers, lambda a: (F.length(F.trim(a)) >= 3) & F.contains(F.lower(text), F.lower(F.trim(a))))


def not_trivial(text: Column, question: Column, target_question: Column) -> Column:
    """Something other than the question and its target reading, question marks and white space aside."""
    plain = lambda t: F.trim(F.regexp_replace(F.translate(F.lower(t), "?", " "), r"(?U)\s+", " "))
    return (plain(text) != "") & ~plain(text).isin(plain(question), plain(target_question))


def spec_levels(questions: DataFrame, seed: int = 42, middle: bool = False) -> DataFrame:
    """Two rows per ambiguous question (as asked, and its target reading); with ``middle`` a third for ``mid_text, mid_subset``."""
    inter, m0 = F.col("interpretations"), F.size("interpretations")
    rows = questions.withColumn("target_idx", E.target_index(F.col("id"), m0, seed).cast("int"))
    t = F.col("target_idx")
    mine = F.get(inter, t)["answers"]
    level = lambda n, text, valid, constraint: F.struct(F.lit(n).alias("spec_level"), text.alias("question_text"), valid.cast("int").alias("m_valid"), constraint.alias("constraint_answers"))
    none = F.lit(None).cast("array<string>")
    rungs = [level(0, F.col("question"), m0, none)]
    if middle:
        subset = F.col("mid_subset")
        fits = F.array_contains(subset, t) & (F.size(subset) > 1) & (F.size(subset) < m0) & (F.trim("mid_text") != "")
        rows = rows.where(F.assert_true(fits, F.lit("a middle level names the target and some others")).isNull())
        of = F.array_distinct(F.concat(mine, F.flatten(F.transform(subset, lambda i: F.get(inter, i)["answers"]))))
        rungs.append(level(1, F.col("mid_text"), F.size(subset), of))
    rungs.append(level(len(rungs), F.get(inter, t)["disambiguated_question"], F.lit(1), none))
    wide = rows.select("*", F.inline(F.array(*rungs)))
    return wide.select(
        F.col("id").alias("question_id"), "spec_level", "question_text", mine.alias("target_answers"), answers_of(inter, t).alias("all_answers"), "m_valid", m0.alias("m0"),
        "target_idx", "evidence", "constraint_answers", collides(inter, t).alias("target_collision"), E.fi_spec(m0, F.col("m_valid")).alias("fi_spec"),
    )
