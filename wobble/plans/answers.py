"""Queries of answers, judgements, prompts, levels and closed forms over generated or given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import text as X
from ..operators import audits as A
from ..operators import ladders as L
from ..operators import scoring
from ..operators import universes as U
from ..sources import providers
from .records import TURNS_SQL, WHITE, paragraphs, turns
from .registry import Registry, rounded, table

query = Registry()

#: Two words of each turn as an answer, and a turn's number as the form in which it is given.
SPAN_SQL = r"spans AS (SELECT conv_id, turn, coalesce(nullif(array_to_string(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')[1:2], ' '), ''), 'none') AS a FROM conversations)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z0-9]+)")), 1, 2)
    a = F.array_join(words, " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(a != "", a).otherwise("none").alias("a"))


def forms(kind, *texts):
    """The text whose place is the kind modulo their number."""
    out = texts[-1]
    for i, t in reversed(list(enumerate(texts[:-1]))):
        out = F.when(F.pmod(kind, F.lit(len(texts))) == i, t).otherwise(out)
    return out


@query(f"WITH {SPAN_SQL} SELECT conv_id, turn, a AS answer, a AS clustered FROM spans")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers given in eight forms, read back."""
    a, lit = F.col("a"), F.lit
    text = forms(
        F.col("turn"), F.concat(lit("First this.\nAnswer: "), a), F.concat(lit("so\n**Final Answer:** "), a, lit(".")), F.concat(lit("Answer:\n\n "), a, lit("\n")), F.concat(lit("Thus the answer is "), a, lit(". More follows")),
        F.concat(lit("a line\n\n"), a), F.concat(lit("Answer: wrong\nthen\n> answer - \""), a, lit("\"")), F.concat(lit("### ANSWER — "), a), F.concat(lit("  `"), a, lit("` ")),
    )
    rows = spans(spark, sf_dir).select("conv_id", "turn", X.answer(text).alias("answer"), text.alias("text"))
    return rows.select("conv_id", "turn", "answer", A.clustering_input(F.col("text"), F.col("answer")).alias("clustered"))


@query(f"""
WITH {SPAN_SQL} SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true END AS verdict, CASE WHEN turn % 2 = 0 THEN a || '+7' ELSE '' END AS listed FROM spans
""")
def parsed_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's verdicts in six forms, and the answers that it lists, bare or in prose."""
    lit, a = F.lit, F.col("a")
    said = forms(F.col("turn"), lit('{"valid": true}'), lit('```json\n{"valid": "False"}\n```'), lit("Yes"), lit(' Sure: {"valid": false} indeed'), lit("true"), lit("perhaps"))
    lists = forms(F.col("turn"), F.concat(lit('Here: {"answers": ["'), a, lit('", 7, null, ["x"]]}')), lit("no answers"))
    return spans(spark, sf_dir).select("conv_id", "turn", X.verdict(said).alias("verdict"), F.array_join(X.listed_answers(lists), "+").alias("listed"))


@query(f"""
WITH {TURNS_SQL}, b AS (
  SELECT conv_id, turn, regexp_replace(regexp_replace(trim(lower(premise)), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{3000}}]', '', 'g'), '{WHITE}+', ' ', 'g') AS g, turn % 2 = 0 AS same FROM turns WHERE premise IS NOT NULL
) SELECT conv_id, turn, CAST(same OR g = regexp_replace(g || ' more', '{WHITE}+', ' ', 'g') AS INT) AS em FROM b
""")
def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text against itself in capitals with punctuation (even turns) or with a word more."""
    rows = turns(spark, sf_dir).where("premise is not null")
    other = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("?"), F.col("premise"), F.lit("!"))).otherwise(F.concat(F.col("premise"), F.lit(" more")))
    return rows.select("conv_id", "turn", X.exact_match(F.col("premise"), other).alias("em"))


@query(f"""
WITH {SPAN_SQL}, w AS (SELECT conv_id, turn, a, string_split(a, ' ')[1] AS first FROM spans)
SELECT conv_id, turn, a || ': ' AS stopped, 1 AS yes, 0 AS no, CAST(NULL AS INT) AS unknown, lower(a) AS normal, '- who -> ' || a || chr(10) || '- ' || a || ' -> b' AS scaffold FROM w
""")
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop strings, raters' marks, normal forms and scaffolds of short texts."""
    a = F.col("a")
    hop = lambda q, x: F.struct(q.alias("sub_question"), x.alias("sub_answer"))
    hops = F.array(hop(F.lit("who"), a), hop(a, F.lit("b")), hop(F.lit("c"), F.lit("d")))
    return spans(spark, sf_dir).select(
        "conv_id", "turn", X.stopped(F.concat(a, F.lit(": <end> x </s>")), ["</s>", "", "<end>"]).alias("stopped"), X.truth(F.lit(" YES ")).alias("yes"), X.truth(F.lit("f")).alias("no"), X.truth(a).alias("unknown"),
        X.normal(F.concat(F.lit(" (\""), a, F.lit("\"),  "))).alias("normal"), X.scaffold(hops, F.lit(2)).alias("scaffold"),
    )


PARAGRAPH_SQL = "p AS (SELECT p_partkey // 10 AS q, p_name || ': ' || p_type AS line, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS i FROM part)"


@query(f"""
WITH {PARAGRAPH_SQL}, c AS (SELECT q, string_agg(line, chr(10) || chr(10) ORDER BY i) AS block FROM p GROUP BY q)
SELECT q::VARCHAR AS question_id, sha256('Context:' || chr(10) || block || chr(10) || chr(10) || 'Question: which?' || chr(10) || chr(10) || 'Answer:') AS plain_sha256,
  sha256('Context:' || chr(10) || block || chr(10) || chr(10) || 'Question: which?' || chr(10) || chr(10) || 'Reason step by step, then end with a line starting ''Answer:''.') AS reasoned_sha256 FROM c
""")
def context_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a block of paragraphs, with and without reasoning."""
    user = lambda reasoning: F.sha2(X.qa_messages(F.lit(" which? "), F.col("paragraphs"), reasoning)[1]["content"], 256)
    return paragraphs(spark, sf_dir).select("question_id", user(False).alias("plain_sha256"), user(True).alias("reasoned_sha256"))


ROLES = ", ".join(f"('{r}', '{p.replace(chr(39), chr(39) * 2)}')" for r, p in X.PERSONAS.items())


@query(f"""
WITH r(role, persona) AS (VALUES {ROLES}), q AS (SELECT r_regionkey::VARCHAR AS question_id, r_name FROM region)
SELECT question_id, role, CAST(s AS INT) AS sample_idx, sha256('Persona to write as: ' || persona || chr(10) || chr(10) || 'Original question:' || chr(10) || r_name || chr(10) || chr(10)
  || 'Rewritten question (one line, in the persona above, with the same answer set as the original):') AS content_sha256 FROM q, r, (SELECT unnest([2, 3]) AS s)
""")
def rewrite_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one round: every question, persona and sample."""
    questions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("question_id"), F.col("r_name").alias("question"))
    rows = U.requests(questions, 2, 2)
    return rows.select("question_id", "role", "sample_idx", F.sha2(F.col("messages")[1]["content"], 256).alias("content_sha256"))


@query("""
SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 8))::BIGINT & 2147483647 AS h31, ('0x' || substr(sha256(c_name), 1, 8))::BIGINT AS h32,
  array_to_string(list_sort(list_distinct(list_transform([0.25, 0.5, 0.75, 1.0], lambda f: greatest(1, least(c_nationkey + 1, round_even(f * (c_nationkey + 1), 0)::INT))::VARCHAR))), '+') AS layers,
  CASE WHEN c_nationkey % 4 = 0 THEN CAST('inf' AS DOUBLE) WHEN c_nationkey % 5 = 0 THEN CAST('-inf' AS DOUBLE) ELSE round(log2((c_nationkey % 5) / (c_nationkey % 4)), 6) + 0.0::DOUBLE END AS b_emp FROM customer
""")
def seeds_and_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of names as seeds, layers at fractions of a depth, and observed bits of a ratio of scores."""
    n = F.col("c_nationkey")
    bits = E.b_emp(n % 5, n % 4)
    names = F.array_join(F.array_sort(F.transform(E.layers([0.25, 0.5, 0.75, 1.0], n + 1), lambda x: x.cast("string"))), "+")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", E.stable_hash(F.col("c_name")).alias("h31"), E.seed32(F.col("c_name")).alias("h32"), names.alias("layers"), F.when(F.abs(bits) == E.INF, bits).otherwise(F.round(bits, 6) + F.lit(0.0)).alias("b_emp")
    )


@query("""
SELECT event_type, user_id % 50 AS part, round(coalesce(sum(v) FILTER (r <= 3), 0), 4) AS tail FROM (
  SELECT *, value AS v, row_number() OVER (PARTITION BY event_type, user_id % 50 ORDER BY event_id DESC) AS r FROM events) GROUP BY ALL
""")
def logprob_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the last three log-probabilities of each list."""
    rows = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 50).alias("part"))
    lists = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda p: p["value"]).alias("lp")).withColumn("n", F.lit(3))
    return rounded(lists.select("event_type", "part", providers.token_logprob_tail("lp", "n").alias("tail")), 4)


@query(f"""
WITH {TURNS_SQL}, w AS (SELECT conv_id, turn, premise, hypothesis FROM turns WHERE premise IS NOT NULL AND hypothesis IS NOT NULL)
SELECT conv_id, turn, CASE WHEN trim(premise) = '' AND trim(hypothesis) = '' THEN 0 WHEN trim(premise) = '' OR trim(hypothesis) = '' OR trim(premise) = trim(hypothesis) THEN 1 ELSE 2 END AS n_golds,
  'user: s' || chr(10) || chr(10) || premise || chr(10) || 'assistant: ' || hypothesis || chr(10) || 'assistant:' AS chat FROM w
""")
def golds_and_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers made one list, and messages as one text where there is no system role."""
    rows = turns(spark, sf_dir).where("premise is not null and hypothesis is not null").withColumn("many", F.array(F.col("premise"), F.col("hypothesis"), F.concat(F.lit(" "), "premise")))
    say = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    chat = F.array(say("system", F.lit("s")), say("user", F.col("premise")), say("assistant", F.col("hypothesis")))
    return rows.select("conv_id", "turn", F.coalesce(F.size(scoring.resolved_golds("premise", "many")), F.lit(0)).alias("n_golds"), A.chat_text(chat, system_role=False).alias("chat"))


@query("""
WITH v AS (SELECT user_id AS question_id, event_id % 4 AS attempt, event_id % 3 AS interpretation, sum((value >= 5)::INT) * 2 > count(*) AS admits FROM events GROUP BY ALL),
x AS (SELECT question_id, attempt, bool_and(admits = (interpretation > 0 OR question_id % 2 = 0)) AS exact FROM v GROUP BY ALL)
SELECT question_id, 'text ' || min(attempt) AS text, min(attempt) AS attempts FROM x WHERE exact GROUP BY question_id
""")
def exact_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' votes on attempts at a middle level: the first attempt whose majority admits just the readings wanted."""
    votes = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), (F.col("event_id") % 4).alias("attempt"), (F.col("event_id") % 3).alias("interpretation"), (F.col("value") >= 5).alias("vote"))
    admitted = scoring.majority(votes, ["question_id", "attempt", "interpretation"])
    wanted = (F.col("interpretation") > 0) | (F.col("question_id") % 2 == 0)
    rows = admitted.withColumns({"wanted": wanted, "text": F.concat(F.lit("text "), F.col("attempt").cast("string"))})
    return scoring.exact_middles(rows)


@query(f"""
WITH {TURNS_SQL} SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'c' WHEN turn % 2 = 0 THEN 'a+b' ELSE 't' END AS gold, round(1 / 3, 6) AS jaccard FROM turns
""")
def gold_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers that a level is held to, and the overlap of two lists of answers."""
    lit = lambda *x: F.array(*map(F.lit, x))
    none = F.array().cast("array<string>")
    rows = turns(spark, sf_dir).select(
        "conv_id", "turn", F.when(F.col("turn") % 4 == 0, lit("c")).otherwise(none).alias("constraint_answers"), (F.col("turn") % 2).alias("spec_level"), lit("a", "b").alias("all_answers"), lit("t").alias("target_answers"),
        F.col("conv_id").alias("question_id"), F.col("hypothesis").alias("text"), lit("A.", "b", " ").alias("original"), lit("a", "C!").alias("listed"),
    )
    from ..operators.relational import gold_set

    overlap = U.answer_overlap(rows.select("question_id", F.col("turn").cast("string").alias("text"), "original", "listed")).withColumnsRenamed({"question_id": "conv_id", "text": "t"})
    golds = rows.select("conv_id", "turn", F.col("turn").cast("string").alias("t"), F.array_join(gold_set(), "+").alias("gold"))
    return rounded(golds.join(overlap, ["conv_id", "t"]).drop("t"))


@query("SELECT (p_partkey // 10)::VARCHAR AS question_id, count(*) FILTER (p_size >= 25) AS n_gold FROM part GROUP BY 1 HAVING count(*) FILTER (p_size >= 25) >= 5")
def eligible_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.eligible(paragraphs(spark, sf_dir), 5)
    return rows.select("question_id", F.size(F.filter("paragraphs", lambda p: p["is_gold"])).cast("long").alias("n_gold"))


@query("""
WITH p AS (SELECT (p_partkey // 10)::VARCHAR AS question_id, count(*) AS n FROM part GROUP BY 1), k AS (SELECT question_id, n, unnest(['random', 'gold_first', 'distractor_first']) AS ladder_type FROM p)
SELECT question_id, ladder_type, 6 AS n_levels, 0 AS n_broken, CAST(list_sum(list_transform([0, 2, 4, 6, 8, 10], lambda l: least(l, n))) AS BIGINT) AS n_paragraphs FROM k
""")
def ladder_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ladders of all questions: levels, rows that break an invariant, and paragraphs in all."""
    rows = L.all_ladders(paragraphs(spark, sf_dir))
    broken = L.broken_ladders(rows).groupBy("question_id", "ladder_type").agg(F.count("*").cast("int").alias("n_broken"))
    out = rows.groupBy("question_id", "ladder_type").agg(F.count("*").cast("int").alias("n_levels"), F.sum(F.size("paragraph_indices")).cast("long").alias("n_paragraphs"))
    return out.join(broken, ["question_id", "ladder_type"], "left").fillna(0, ["n_broken"])


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, sha256('7::' || c_custkey) AS h, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7::' || c_custkey), c_custkey) AS r FROM customer)
SELECT c_custkey, c_mktsegment FROM r WHERE r <= 3
""")
def sample_per_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: three customers of each segment."""
    return A.per_stratum(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 3, 7)


@query("""
WITH n AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 10), p AS (SELECT o_custkey FROM n ORDER BY sha256('42::' || o_custkey), o_custkey LIMIT 20)
SELECT o_orderkey, o_custkey, '' AS rater_a, '' AS rater_b FROM orders JOIN p USING (o_custkey)
""")
def rater_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for raters: all orders of twenty customers who have ten or more."""
    from ..sources.sinks import rater_sheet as sheet

    return sheet(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 10, 20, 42)
