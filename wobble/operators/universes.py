"""Universes of paraphrases: rounds of generating, filtering and removing near-duplicates until each question has enough.

Candidates are rows ``question_id, question, role, sample_idx, pos, text`` (``pos`` is the order of arrival). What models say
of them are relations: entailment of pairs of texts, and whether a rewording still admits a gold answer or which answers
it has. A universe row is a candidate with an outcome and, if it is rejected, the reason of the first filter that it failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import text as X
from .lineage import Ledger, written
from .neighbours import spread_out

STRICT, RELAXED, OVERLAP, EDITS, TARGET = 0.9, 0.85, 0.9, 5, 10
#: Reasons that stay when the threshold is relaxed.
LASTING = ("constraint_mismatch", "edit_distance_close", "exact_duplicate")
UNIVERSE = ("question_id", "outcome", "paraphrase_idx", "role", "sample_idx", "text", "reason", "nli_fwd", "nli_bwd", "jaccard")

#: Pairs ``premise, hypothesis`` to ``entail``; candidates to ``admits`` or ``jaccard`` by ``question_id, text``.
Model = Callable[[DataFrame], DataFrame]


def requests(questions: DataFrame, first: int, count: int, roles: dict[str, str] = X.PERSONAS) -> DataFrame:
    """A row per question, persona and sample: ``question_id, question, role, persona, sample_idx, pos, messages``."""
    personas = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).alias("role"), F.lit(p).alias("persona")) for i, (r, p) in enumerate(roles.items())))).alias("p")
    rows = questions.select("question_id", "question", personas).select("*", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))).alias("sample_idx"))
    rows = rows.select("question_id", "question", "p.role", "p.persona", "sample_idx", (F.col("sample_idx") * len(roles) + F.col("p.i")).alias("pos"))
    return rows.withColumn("messages", X.rewrite_messages(F.col("question"), F.col("persona")))


def persona(role: Column) -> Column:
    """The text of a role; an unknown role is an error."""
    known = F.create_map(*(F.lit(x) for pair in X.PERSONAS.items() for x in pair))
    return F.when(F.assert_true(known[role].isNotNull(), F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))).isNull(), known[role])


def entailed_both(candidates: DataFrame, nli: DataFrame) -> DataFrame:
    """Candidates with ``nli_fwd`` (question to candidate) and ``nli_bwd``; 0 for a pair that no model judged."""
    there = nli.select(F.col("premise").alias("question"), F.col("hypothesis").alias("text"), F.col("entail").alias("nli_fwd"))
    back = nli.select(F.col("premise").alias("text"), F.col("hypothesis").alias("question"), F.col("entail").alias("nli_bwd"))
    return candidates.join(there, ["question", "text"], "left").join(back, ["question", "text"], "left").fillna(0.0, ["nli_fwd", "nli_bwd"])


def admitted(votes: DataFrame) -> DataFrame:
    """``question_id, text, admits``: whether any gold (a row each, ``vote`` null where the judge's reply is not to be read) still answers the text."""
    return votes.groupBy("question_id", "text").agg(F.bool_or(F.coalesce("vote", F.lit(False))).alias("admits"))


def answer_overlap(answers: DataFrame) -> DataFrame:
    """``question_id, text, jaccard`` of the answers listed for a text and for its question (``original`` and ``listed`` arrays)."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, X.normal), lambda a: a != ""))
    return answers.select("question_id", "text", E.jaccard(clean("original"), clean("listed")).alias("jaccard"))


def reasons(scored: DataFrame, threshold: float, identity: bool = True) -> DataFrame:
    """Candidates with ``nli_fwd, nli_bwd`` and ``admits`` or ``jaccard``, and the ``reason`` of the first filter that they fail."""
    same = F.lower(F.trim("text")) == F.lower(F.trim("question"))
    low, high = F.least("nli_fwd", "nli_bwd"), F.greatest("nli_fwd", "nli_bwd")
    kept = F.coalesce(F.col("admits"), F.lit(False)) if "admits" in scored.columns else F.coalesce(F.col("jaccard") >= OVERLAP, F.lit(False))
    reason = F.when(same & F.lit(identity), "exact_duplicate").when((low < threshold) & (high >= threshold), "nli_one_direction").when(low < threshold, "nli_low").when(~kept, "constraint_mismatch")
    rows = scored if "jaccard" in scored.columns else scored.withColumn("jaccard", F.lit(None).cast("double"))
    return rows.withColumn("reason", reason)


def priority() -> list[Column]:
    """Best first: the weaker direction of entailment, overlap, arrival."""
    return [(-F.least("nli_fwd", "nli_bwd")).alias("a"), (-F.coalesce(F.nanvl("jaccard", F.lit(0.0)), F.lit(0.0))).alias("b"), F.col("pos").alias("c")]


def distinct_texts(survivors: DataFrame, edits: int = EDITS, distance: Callable[[Column, Column], Column] = F.levenshtein) -> DataFrame:
    """Survivors with ``place`` (among those kept, from 0; null if not kept) and ``reason`` (an exact or a close copy of one kept).

    In order of :func:`priority` each question's texts are kept that are ``edits`` or more away from all kept before. Near
    texts are found by a join, by characters or words, and decided in rounds, so a question may have any number of candidates. Another
    ``distance`` is worked out for all pairs of a question.
    """
    rest = [c for c in survivors.columns if c not in ("question_id", "reason")]
    rows = survivors.select("question_id", *rest)

    def compared(texts: DataFrame) -> DataFrame:
        pairs = texts.withColumnRenamed("text", "a").join(texts.withColumnRenamed("text", "b"), "question_id").where("a < b")
        return pairs.where(distance(F.col("a"), F.col("b")) < edits)

    known = distance in (F.levenshtein, X.token_distance)
    judged_ = spread_out(rows, ["question_id"], "text", priority(), edits - 1, distance is X.token_distance, None if known else compared)
    kept = judged_.where("kept").select("question_id", "text", F.lit(True).alias("_kept"))
    joined = rows.join(kept, ["question_id", "text"], "left")
    # the first of equal texts is the one that was kept; only kept texts are numbered
    order = Window.partitionBy("question_id", "text").orderBy(*priority())
    joined = written(joined.withColumn("_first", F.col("_kept") & (F.row_number().over(order) == 1)), "survivors")
    places = joined.where("_first").withColumn("place", (F.row_number().over(Window.partitionBy("question_id").orderBy(*priority())) - 1).cast("int"))
    left = joined.where("not coalesce(_first, false)").withColumn("place", F.lit(None).cast("int"))
    reason = F.when(F.col("_kept"), "exact_duplicate").otherwise("edit_distance_close")
    out = places.select("question_id", *rest, "place", F.lit(None).cast("string").alias("reason"))
    return out.unionByName(left.select("question_id", *rest, "place", reason.alias("reason")))


def outcomes(rows: DataFrame, target: int) -> DataFrame:
    """Rows of :func:`distinct_texts` and rejected ones as a universe; kept ones beyond the target are left out."""
    rows = rows.where(F.col("place").isNull() | (F.col("place") < target))
    outcome = F.when(F.col("place").isNull(), "rejected").otherwise("accepted")
    return rows.select("question_id", outcome.alias("outcome"), F.col("place").alias("paraphrase_idx"), "role", "sample_idx", "text", "reason", "nli_fwd", "nli_bwd", "jaccard")


def judged(candidates: DataFrame, nli: Model, constraint: Model) -> DataFrame:
    pairs = candidates.select(F.col("question").alias("premise"), F.col("text").alias("hypothesis"))
    pairs = pairs.unionByName(pairs.select(F.col("hypothesis").alias("premise"), F.col("premise").alias("hypothesis"))).distinct()
    return entailed_both(candidates, nli(pairs)).join(constraint(candidates), ["question_id", "text"], "left")


def build(
    questions: DataFrame, generate: Model, nli: Model, constraint: Model, *, target: int = TARGET, samples: int = 1, most: int = 4, strict: float = STRICT, relaxed: float = RELAXED, edits: int = EDITS,
    distance: Callable[[Column, Column], Column] = F.levenshtein, ledger: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The universe, and ``question_id, attempts, threshold, dropped`` of each question.

    A round generates ``samples`` candidates per persona for the questions that still lack some. After ``most`` candidates a
    persona, questions that are short are filtered anew, all their candidates at once, with the relaxed threshold (texts equal to the
    question may pass then); those still short are marked as dropped.

    Every step of a round is a table below ``ledger`` (a fresh shared folder if it is not given). A call with the folder of
    a call that was lost goes on after its last whole step: what was generated or judged is not asked for again.
    """
    book = Ledger(questions.sparkSession, ledger)
    none = F.lit(None).cast("int")
    every = lambda name, n: book.steps([f"{name}-{i}" for i in range(1, n + 1)])
    open_, survivors = book.step("questions", lambda: questions), None
    rounds = 0
    for first in range(0, most, samples):
        rounds += 1
        asked = open_
        new = book.step(f"candidates-{rounds}", lambda: generate(requests(asked, first, samples)))  # noqa: B023  made at once or not at all
        scored = book.step(f"judged-{rounds}", lambda: reasons(judged(new, nli, constraint), strict))  # noqa: B023
        pool = scored.where("reason is null")
        pool = pool if survivors is None else survivors.unionByName(pool)
        ranked = book.step(f"ranked-{rounds}", lambda: distinct_texts(pool, edits, distance))  # noqa: B023
        failed = scored.where("reason is not null").withColumn("place", none).unionByName(ranked.where("place is null"), allowMissingColumns=True)
        book.step(f"rejected-{rounds}", lambda: failed.select(*scored.columns, "place"))  # noqa: B023
        kept = ranked.where("place is not null")
        full = kept.groupBy("question_id").agg(F.count("*").alias("n")).where(F.col("n") >= target).select("question_id")
        done = book.step(f"done-{rounds}", lambda: kept.join(full, "question_id", "left_semi").withColumn("attempts", F.lit(rounds)))  # noqa: B023
        finished = done.select("question_id").distinct()
        open_ = book.step(f"open-{rounds}", lambda: asked.join(finished, "question_id", "left_anti"))  # noqa: B023
        survivors = kept.join(finished, "question_id", "left_anti").drop("place")
        if open_.isEmpty():
            break
    raw, rejected, done = every("candidates", rounds), every("rejected", rounds), every("done", rounds)
    short = open_.select("question_id")
    scored = book.step("judged-again", lambda: reasons(judged(raw.join(short, "question_id", "left_semi"), nli, constraint), relaxed, identity=False))
    again = book.step("ranked-again", lambda: distinct_texts(scored.where("reason is null"), edits, distance))
    lasting = rejected.join(short, "question_id", "left_semi").where(F.col("reason").isin(*LASTING))
    late = scored.where("reason is not null").withColumn("place", none)
    rows = [done.drop("attempts"), rejected.join(short, "question_id", "left_anti"), again, lasting, late]
    out = None
    for r in rows:
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    enough = again.where("place is not null").groupBy("question_id").agg((F.count("*") < target).alias("short"))
    late_state = short.join(enough, "question_id", "left").select("question_id", F.lit(rounds).alias("attempts"), F.lit(relaxed).alias("threshold"), F.coalesce("short", F.lit(True)).alias("dropped"))
    state = done.select("question_id", "attempts").distinct().select("question_id", "attempts", F.lit(strict).alias("threshold"), F.lit(False).alias("dropped"))
    return outcomes(out, target), state.unionByName(late_state)


def flattened(sets: DataFrame) -> DataFrame:
    """Nested sets (``question_id, accepted, rejected``, arrays of structs) as rows; what only one kind has is null in the other."""
    kept = sets.select("question_id", F.lit("accepted").alias("outcome"), F.inline("accepted"))
    gone = sets.select("question_id", F.lit("rejected").alias("outcome"), F.inline("rejected"))
    return kept.unionByName(gone, allowMissingColumns=True)


def batch_quantiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``n, p50, p90, high`` of a batch by place: of n sorted values those at n // 2 and at int(0.9 n) - 1, not interpolated."""
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"))  # a round's batch for one question
    n = F.size("v")
    return listed.select(*by, n.alias("n"), F.get("v", F.floor(n / 2).cast("int")).alias("p50"), F.get("v", F.greatest(F.lit(0), F.floor(n * 0.9).cast("int") - 1)).alias("p90"), F.array_max("v").alias("high"))


def singletons(questions: DataFrame, universe: DataFrame) -> DataFrame:
    """The universe, with the question itself for those that have no accepted paraphrase."""
    some = universe.where("outcome = 'accepted'").select("question_id").distinct()
    alone = questions.join(some, "question_id", "left_anti").select("question_id", F.lit("singleton_fallback").alias("outcome"), F.lit(0).alias("paraphrase_idx"), F.col("question").alias("text"))
    return universe.unionByName(alone, allowMissingColumns=True)
