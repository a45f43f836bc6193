"""Checks and summaries of result tables: gates, orders of ladders, pools of questions, gaps between scores, and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from .factors import rank_correlation, rank_correlations
from .lineage import written
from .prefix import medians
from .relational import seeded


def filled_mean(aufi: Column, n: Column, f_mean: Column) -> Column:
    """The mean score, or where it is absent one of 1, 0 and 0.5 by how large the area is."""
    guess = F.when(aufi <= 0.05, 1.0).when(aufi >= 0.9 * F.log2(n + F.lit(1.0)), 0.0).when(aufi.isNotNull(), 0.5)
    return F.coalesce(f_mean, guess)


def fixed_information(stored: Column, m0: Column, entropy: Column) -> Column:
    """Output information against the readings of the question: ``log2(max(m0, 1)) - h``, not clamped; a stored value stays."""
    return F.coalesce(stored, F.log2(F.greatest(m0, F.lit(1)).cast("double")) - entropy)


def sensitivities(rows: DataFrame, scores: str = "f_graded_per_paraphrase", samples: str = "n_samples_per_prompt") -> DataFrame:
    """``rows`` with ``rho_f`` and ``fi_premium`` computed anew from their scores; a cell without a number of samples had ten."""
    k = F.greatest(F.coalesce(F.nullif(F.col(samples), F.lit(0)), F.lit(10)), F.lit(2))
    return rows.withColumns({"rho_f": E.rho_f(F.col(scores), k), "fi_premium": E.fi_premium(F.col(scores))})


def gate(rows: DataFrame, level: str, low, high, hard: dict[str, str], soft: dict[str, str]) -> DataFrame:
    """``name, low, high, hard, holds``: whether the means of columns move from the low to the high level as they should (``>, >=, <=``)."""
    at = lambda c, x: F.avg(F.when(F.col(level) == x, F.col(c).cast("double")))
    wanted = [(c, way, True) for c, way in hard.items()] + [(c, way, False) for c, way in soft.items()]
    missing = [c for c in hard if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    wanted = [w for w in wanted if w[0] in rows.columns]
    means = rows.agg(F.array(*(F.struct(F.lit(c).alias("name"), at(c, low).alias("low"), at(c, high).alias("high"), F.lit(way).alias("way"), F.lit(h).alias("hard")) for c, way, h in wanted)).alias("m"))
    a, b = F.col("low"), F.col("high")
    holds = F.when(F.col("way") == ">", b > a).when(F.col("way") == ">=", b >= a).otherwise(b <= a)
    return means.select(F.inline("m")).select("name", "low", "high", "hard", F.coalesce(holds, F.lit(False)).alias("holds"))


def by_ladder(rows: DataFrame, key: list[str], ladder: str, kinds: tuple[str, str, str], value: str, order: list[Column] | None = None) -> DataFrame:
    """The mean of a value for each of three ladders, a column each, and whether they are in order (null if one is absent).

    A mean of doubles depends on the order in which they are added, and so does whether equal means are in order. With ``order``
    a key's values, which are few, are added one after another, so that runs agree.
    """
    names = ("gold_first", "random", "distractor_first")
    if order is None:
        wide = rows.groupBy(*key).agg(*(F.avg(F.when(F.col(ladder) == k, F.col(value))).alias(n) for k, n in zip(kinds, names, strict=True)))
    else:
        kept = F.when(F.col(value).isNotNull() & F.col(ladder).isin(*kinds), F.struct(F.struct(*order).alias("at"), F.col(ladder).alias("kind"), F.col(value).cast("double").alias("v")))
        listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(kept)).alias("_all"))
        own = lambda k: F.transform(F.filter("_all", lambda e: e["kind"] == k), lambda e: e["v"])
        mean = lambda vs: F.aggregate(vs, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(vs), F.lit(0))
        wide = listed.select(*key, *(mean(own(k)).alias(n) for k, n in zip(kinds, names, strict=True)))
    return wide.withColumn("in_order", (F.col("gold_first") >= F.col("random")) & (F.col("random") >= F.col("distractor_first")))


def order_rate(wide: DataFrame, by: list[str]) -> DataFrame:
    """``checked, consistent, rate`` of rows of :func:`by_ladder` that have all three."""
    full = wide.where("gold_first is not null and random is not null and distractor_first is not null")
    return full.groupBy(*by).agg(F.count("*").alias("checked"), F.sum(F.col("in_order").cast("long")).alias("consistent"), F.avg(F.col("in_order").cast("double")).alias("rate"))


def quality_against_bits(rows: DataFrame, level: str, value: str, n: int, k: int, cap: float = 5.0) -> DataFrame:
    """The mean value at each level beside the bits that the level's context is worth, ``cap`` at most."""
    means = rows.groupBy(F.col(level).cast("int").alias("level")).agg(F.avg(value).alias("value"))
    return means.select("level", "value", F.least(E.b_theo(F.lit(n), F.lit(k), F.col("level")), F.lit(cap)).alias("bits"))


def rank_matrix(rows: DataFrame, values: list[str], least: int = 3) -> DataFrame:
    """``a, b, rho, n`` of every pair of columns over the rows that have them all; the rows are read once."""
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    found = rank_correlations(rows, [], values, least)
    named = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.get("rho", F.lit(k)).alias("rho"), "n") for k, (a, b) in enumerate(pairs)))
    return found.select(F.inline(named))


def redundant(rows: DataFrame, value: str, others: list[str], limit: float = 0.95, least: int = 5) -> DataFrame:
    """``name, rho, n, redundant``: rank correlations of a column with others, each over the rows that have both."""
    x = F.col(value).cast("double")
    pairs = F.array(*(F.struct(F.lit(o).alias("name"), x.alias("x"), F.col(o).cast("double").alias("y")) for o in others))
    long = rows.select(F.inline(pairs))  # one scan; each column's pairs are a group of the ranks
    found = rank_correlation(long, "x", "y", ["name"], "rho", least)
    # a column without any pair is listed too
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, others))).alias("name"))
    out = names.join(F.broadcast(found), "name", "left").select("name", "rho", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return out.withColumn("redundant", F.coalesce(F.abs("rho") > limit, F.lit(False)))


def degenerate(cells: DataFrame, by: list[str]) -> DataFrame:
    """Share of cells whose answers all fall in one cluster."""
    return cells.groupBy(*by).agg(F.avg((F.col("a_q") == 1).cast("double")).alias("degenerate"), F.count("*").alias("n"))


def planned(cells: DataFrame, samples: int, paraphrases: str, level: str, snippets: str) -> DataFrame:
    """What a run would do: cells, model calls, levels, and the median number of snippets."""
    out = cells.agg(F.count("*").alias("n_cells"), F.sum(F.col(paraphrases) * samples).alias("n_calls"), F.count_distinct(level).alias("n_levels"))
    return out.join(medians(cells, [], snippets, "median_snippets").select("median_snippets"))


def explored(rows: DataFrame, key: str, value, level: str) -> DataFrame:
    """The rows of one question in order of level."""
    return rows.where(F.col(key) == value).orderBy(level)


# pools of questions


def eligible(questions: DataFrame, k_gold: int) -> DataFrame:
    """Questions with ``k_gold`` gold paragraphs at least."""
    return questions.where(F.size(F.filter("paragraphs", lambda p: p["is_gold"])) >= k_gold)


def evidence_part(evidence: Column, fraction: float) -> Column:
    """The first share of the snippets, rounded up."""
    return F.slice(evidence, F.lit(1), F.greatest(F.ceil(F.size(evidence) * F.lit(fraction)), F.lit(0)).cast("int")) if fraction < 1 else evidence


def survives(answers: Column, evidence: Column, fraction: float = 0.5) -> Column:
    """Whether the first share of the snippets still holds one of the answers, case aside."""
    text = F.transform(evidence_part(evidence, fraction), lambda e: F.lower(e["snippet"]))
    return F.exists(answers, lambda a: F.exists(text, lambda t: F.contains(t, F.lower(a))))


def pool(questions: DataFrame, order: str, n: int | None = None, seed: int = 42, m0: tuple[int, int] | None = None, fraction: float = 1.0) -> DataFrame:
    """The first ``n`` ambiguous questions whose evidence holds the target's answer, with their evidence cut to a share."""
    from .ladders import covered

    size = F.size("interpretations")
    rows = questions.where(size > 1).withColumn("target_idx", E.target_index(F.col("id"), size, seed).cast("int"))
    rows = rows.where(covered(F.col("interpretations"), F.col("evidence"), F.col("target_idx")))
    if m0:
        rows = rows.where(size.between(*m0))
    rows = rows.orderBy(order).limit(n) if n is not None else rows
    return rows.withColumn("evidence", evidence_part(F.col("evidence"), fraction))


def holdout(questions: DataFrame) -> DataFrame:
    """Questions with evidence, and whether they are ambiguous."""
    m0 = F.size("interpretations")
    return questions.where(F.size("evidence") > 0).select("id", "question", "evidence", m0.alias("m0"), (m0 >= 2).cast("int").alias("ambiguous"))


def flagged(rows: DataFrame, flags: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with a flag by key (null where unknown) in place of the one they had."""
    return rows.drop(name).join(flags.select(key, F.col(name).cast("boolean").alias(name)), key, "left")


def per_stratum(rows: DataFrame, stratum: str, key: str, n: int, seed: int, least: int | None = None) -> DataFrame:
    """``n`` rows of each stratum in a seeded order."""
    some = rows.where(F.col(stratum) >= least) if least is not None else rows
    few = Window.partitionBy(stratum, F.substring("_h", 1, 2)).orderBy("_h", key)
    some = some.withColumn("_h", seeded(seed, key)).withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))).where(F.col("_r") <= n).drop("_h", "_r")


# gaps between a chain's score and its final answer


def gap_sample(rows: DataFrame, chain: str, final: str, key: str, n: int, bound: float = 0.8) -> DataFrame:
    """Rows whose chain scored ``bound`` or more but whose final answer failed, filled up to ``n`` with the lowest final scores."""
    clear = (F.col(chain) >= bound) & (F.col(final) == 0)
    return rows.withColumn("_first", F.when(clear, 0).otherwise(1)).orderBy("_first", F.when(~clear, F.col(final)), key).limit(n).drop("_first")


def gap_counts(rows: DataFrame, kind: Column) -> DataFrame:
    """``kind, n, share`` of the sample's rows."""
    n = rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per kind


def chat_logprobs(choice: Column) -> Column:
    """``token, logprob, top`` of a chat reply's JSON: its log-probabilities are a list of objects with alternatives."""
    one = "struct<token: string, logprob: double, top_logprobs: array<struct<token: string, logprob: double>>>"
    content = F.from_json(choice, f"struct<logprobs: struct<content: array<{one}>>>")["logprobs"]["content"]
    top = lambda t: F.map_from_entries(F.transform(F.coalesce(t["top_logprobs"], F.array().cast("array<struct<token: string, logprob: double>>")), lambda a: F.struct(a["token"], a["logprob"])))
    return F.transform(content, lambda t: F.struct(t["token"].alias("token"), t["logprob"].alias("logprob"), top(t).alias("top")))


def text_logprobs(choice: Column) -> Column:
    """``token, logprob, top`` of a completion's JSON: parallel lists, of which entries without a log-probability are left out."""
    lists = F.from_json(choice, "struct<logprobs: struct<tokens: array<string>, token_logprobs: array<double>, top_logprobs: array<map<string, double>>>>")["logprobs"]
    zipped = F.arrays_zip(lists["tokens"].alias("token"), lists["token_logprobs"].alias("logprob"), F.coalesce(lists["top_logprobs"], F.array().cast("array<map<string, double>>")).alias("top"))
    return F.filter(zipped, lambda t: t["token"].isNotNull() & t["logprob"].isNotNull())


def step_logprobs(logits: Column, token: Column, most: int) -> Column:
    """Of one step's logits: the log-probability of the token that was taken, and the ``most`` likeliest with theirs."""
    peak = F.array_max(logits)
    norm = peak + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - peak)))
    order = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    top = F.transform(F.slice(order, 1, most), lambda s: F.struct(s["i"].alias("token"), (-s["x"] - norm).alias("logprob")))
    return F.struct((F.get(logits, token) - norm).alias("logprob"), top.alias("top"))


def chat_text(messages: Column, system_role: bool = True) -> Column:
    """Messages as one text, ``role: content`` a line and a mark for the reply; a system message joins the first of the user if there is no such role."""
    first, rest = F.get(messages, 0), F.slice(messages, F.lit(2), F.size(messages))
    folded = F.transform(rest, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(first["content"], F.lit("\n\n"), m["content"])).otherwise(m["content"]).alias("content")))
    fold = (first["role"] == "system") & F.lit(not system_role) & (F.size(messages) > 1)
    used = F.when(fold, folded).otherwise(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return F.concat(F.array_join(F.transform(used, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"), F.lit("\nassistant:"))


def clustering_input(response: Column, parsed: Column) -> Column:
    """What of a response is clustered: its answer, or all of it if it has none."""
    return F.when(F.coalesce(F.trim(parsed), F.lit("")) != "", parsed).otherwise(response)


def correlations_with(cells: DataFrame, value: str, others: dict[str, Column]) -> DataFrame:
    """``name, rho, n`` of one metric with others over the cells that have both."""
    # cells are few, and each metric reads them again
    rows = written(cells.select(F.col(value).alias("_value"), *(c.alias(n) for n, c in others.items())), "cells")
    return redundant(rows, "_value", list(others), least=3).drop("redundant")


def correlations_by(cells: DataFrame, by: list[str], value: Column, others: dict[str, Column], least: int = 3) -> DataFrame:
    """``by, name, rho, n``: in each group, rank correlations of one metric with others over the cells that have both, in one pass."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), value.cast("double").alias("x"), c.cast("double").alias("y")) for n, c in others.items()))
    return rank_correlation(cells.select(*by, F.inline(pairs)), "x", "y", [*by, "name"], "rho", least)
