"""Queries of record layouts, memo, streams and universes, whose inputs are built from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import text as X
from ..operators import audits as A
from ..operators import ladders as L
from ..operators import universes as U
from ..operators.lineage import shared_path
from ..operators.relational import last_wins
from ..sources import providers, records
from ..streaming import windows as S
from .records import TURNS_SQL, WORDS_SQL, turns
from .registry import Registry, rounded, table

query = Registry()


def listed(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# records of four layouts


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of neighbouring parts: ``id`` and the parts in order."""
    part = F.struct("p_partkey", "p_name", "p_type", "p_size")
    return table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("id")).agg(F.array_sort(F.collect_list(part)).alias("p"))


def paired_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose context is a pair of lists; facts name the titles of the parts of size 25 or more."""
    gold = F.filter("p", lambda x: x["p_size"] >= 25)
    name = lambda x: F.concat(x["p_partkey"].cast("string"), F.lit(" "), x["p_name"])
    return parts(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("which of "), F.col("id").cast("string")).alias("question"), F.lit("none").alias("answer"), F.lit("bridge").alias("type"),
        F.when(F.col("id") % 2 == 0, "hard").alias("level"),
        F.struct(F.transform("p", name).alias("title"), F.transform("p", lambda x: F.array(x["p_type"], F.lit("."))).alias("sentences")).alias("context"),
        F.struct(F.transform(gold, name).alias("title"), F.transform(gold, lambda x: F.lit(0)).alias("sent_id")).alias("supporting_facts"),
    )


def parsed(rows: DataFrame) -> DataFrame:
    gold = F.filter(F.transform("paragraphs", lambda p, i: F.when(p["is_gold"], i)), lambda i: i.isNotNull())
    return rows.select(
        "id", "dataset", "question_type", F.coalesce("level", F.lit("<none>")).alias("level"), F.size("paragraphs").alias("n_paragraphs"), listed(gold).alias("gold"), F.coalesce("n_hops", F.lit(0)).alias("n_hops"),
        F.sha2(F.array_join(F.transform("paragraphs", lambda p: F.concat(p["title"], F.lit("/"), F.array_join(p["sentences"], ""))), "|"), 256).alias("text_sha256"),
    )


PARTS_SQL = """
p AS (SELECT *, p_partkey // 10 AS id, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS i FROM part)"""


@query(f"""
WITH {PARTS_SQL} SELECT id::VARCHAR AS id, 'hotpot' AS dataset, 'bridge' AS question_type, CASE WHEN id % 2 = 0 THEN 'hard' ELSE '<none>' END AS level, CAST(count(*) AS INT) AS n_paragraphs,
  coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (p_size >= 25), '') AS gold, 0 AS n_hops, sha256(string_agg(p_partkey || ' ' || p_name || '/' || p_type || '.', '|' ORDER BY i)) AS text_sha256 FROM p GROUP BY id
""")
def paired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(records.paired(paired_raw(spark, sf_dir), "hotpot"))


@query(f"""
WITH {PARTS_SQL} SELECT id::VARCHAR AS id, 'twiki' AS dataset, 'bridge' AS question_type, '<none>' AS level, CAST(count(*) AS INT) AS n_paragraphs,
  coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (p_size >= 25), '') AS gold, 0 AS n_hops, sha256(string_agg(p_partkey || ' ' || p_name || '/' || p_type || '.', '|' ORDER BY i)) AS text_sha256 FROM p GROUP BY id
""")
def paired_records_without_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(records.paired(paired_raw(spark, sf_dir), "twiki", with_level=False))


def decomposed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a chain of sub-questions: paragraphs lie in reverse, ``idx`` tells their order; the gold ones are asked in turn."""
    gold = F.filter(F.transform("p", lambda x, i: F.struct(i.alias("i"), x["p_size"].alias("s"), x["p_name"].alias("n"))), lambda g: g["s"] >= 25)
    hop = lambda g, k: F.struct(k.alias("id"), F.concat(F.when(k > 0, F.concat(F.lit("after #"), k.cast("string"), F.lit(" and #9: "))).otherwise(""), F.lit("part "), g["i"].cast("string")).alias("question"), g["n"].alias("answer"), g["i"].cast("int").alias("paragraph_support_idx"))
    para = lambda x, i: F.struct(
        i.cast("int").alias("idx"), x["p_name"].alias("title"), F.when(i % 2 == 0, x["p_type"]).alias("paragraph_text"), F.when(i % 2 == 1, x["p_type"]).alias("text"), (x["p_size"] >= 25).alias("is_supporting")
    )
    none = F.lit(None).cast("array<string>").alias("answer_aliases")
    return parts(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), F.lit("which").alias("question"), F.lit("none").alias("answer"), none, F.reverse(F.transform("p", para)).alias("paragraphs"), F.transform(gold, hop).alias("question_decomposition")
    )


@query(f"""
WITH {PARTS_SQL} SELECT id::VARCHAR AS id, 'musique' AS dataset, greatest(2, least(4, count(*) FILTER (p_size >= 25))) || 'hop' AS question_type, '<none>' AS level, CAST(count(*) AS INT) AS n_paragraphs,
  coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (p_size >= 25), '') AS gold, CAST(count(*) FILTER (p_size >= 25) AS INT) AS n_hops, sha256(string_agg(p_name || '/' || p_type, '|' ORDER BY i)) AS text_sha256 FROM p GROUP BY id
""")
def decomposed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(records.decomposed(decomposed_raw(spark, sf_dir)))


@query(f"""
WITH {PARTS_SQL}, c AS (SELECT id, count(*) FILTER (p_size >= 25) AS n FROM p GROUP BY id)
SELECT 'hotpot' AS dataset, CASE WHEN id % 2 = 0 THEN 'hard' ELSE '<none>' END AS level, 'bridge' AS question_type, '<none>' AS n_hops, count(*) AS n FROM c WHERE id % 2 = 0 OR id < 0 GROUP BY ALL
UNION ALL SELECT 'musique', '<none>', greatest(2, least(4, n)) || 'hop', n::VARCHAR, count(*) FROM c WHERE id % 2 = 1 GROUP BY ALL
""")
def record_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two sets whose odd ids are in both: of equal ids the later set's record counts."""
    one = records.paired(paired_raw(spark, sf_dir), "hotpot")
    two = records.decomposed(decomposed_raw(spark, sf_dir)).where("cast(id as bigint) % 2 = 1")
    return records.manifest(records.by_id([one, two]))


@query(f"""
WITH {PARTS_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS hop, count(*) OVER (PARTITION BY id) AS n FROM p WHERE p_size >= 25),
k AS (SELECT id, hop, n, i, unnest(range(n)) AS hops_provided FROM g)
SELECT id::VARCHAR AS question_id, CAST(hops_provided AS INT) AS level, coalesce(string_agg(i::VARCHAR, ',' ORDER BY hop) FILTER (hop < hops_provided), '') AS indices,
  CAST(count(*) FILTER (hop < hops_provided) AS INT) AS gold_count FROM k GROUP BY id, hops_provided
""")
def reasoning_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.decomposed(decomposed_raw(spark, sf_dir)).where("n_hops > 0").withColumnRenamed("id", "question_id")
    return L.reasoning_ladder(rows).select("question_id", "level", listed("paragraph_indices").alias("indices"), "gold_count")


FACTS_SQL = f"""
{PARTS_SQL}, g AS (SELECT id, i, p_name, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS hop FROM p WHERE p_size >= 25),
facts AS (
  SELECT g.id, g.hop, CASE WHEN g.hop = 0 THEN 'part ' || g.i ELSE 'after ' || coalesce(b.p_name, '') || ' and ' || coalesce(n.p_name, '#9') || ': part ' || g.i END || ' ' || g.p_name AS fact, g.p_name
  FROM g LEFT JOIN g b ON b.id = g.id AND b.hop = g.hop - 1 LEFT JOIN g n ON n.id = g.id AND n.hop = 8
)"""


@query(f"WITH {FACTS_SQL} SELECT id::VARCHAR AS question_id, CAST(hop AS INT) AS hop, fact FROM facts")
def chain_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per hop, with references to earlier hops resolved."""
    from ..operators import scoring

    rows = records.decomposed(decomposed_raw(spark, sf_dir))
    return rows.select(F.col("id").alias("question_id"), F.posexplode(scoring.facts(F.col("question_decomposition"))).alias("hop", "fact"))


@query(f"""
WITH {FACTS_SQL}, r AS (SELECT id, hop, fact, (SELECT min(p_name) FROM facts f WHERE f.id = facts.id AND f.hop = 0) AS response FROM facts),
w AS (SELECT id, hop, {WORDS_SQL.format("fact")} AS f, {WORDS_SQL.format("response")} AS r FROM r),
e AS (SELECT id, hop, len(list_intersect(f, r)) / len(f) AS ea, CASE WHEN len(r) > 0 THEN len(list_intersect(f, r)) / len(r) ELSE 0 END AS eb FROM w)
SELECT id::VARCHAR AS question_id, round(avg(CASE WHEN hop = 0 THEN 1 WHEN ea >= eb THEN CAST(ea >= 0.7 AND (1 - ea) / 2 < 0.5 AS INT) ELSE CAST(eb >= 0.7 AND (1 - eb) / 2 < 0.5 AS INT) END), 6) AS chain_f, count(*) AS n_hops
FROM e GROUP BY id
""")
def chain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's first answer as a response: the share of its hops that it recovers; the scaffold gives the first."""
    from ..operators import scoring

    rows = records.decomposed(decomposed_raw(spark, sf_dir)).where("n_hops > 0")
    hops = rows.select(F.col("id").alias("question_id"), F.posexplode(scoring.facts(F.col("question_decomposition"))).alias("hop", "fact"))
    responses = rows.select(F.col("id").alias("question_id"), F.get("question_decomposition", 0)["sub_answer"].alias("response"))
    pairs = responses.join(hops, "question_id").select(F.col("response").alias("premise"), F.col("fact").alias("hypothesis"))
    nli = providers.overlap(pairs.unionByName(pairs.select(F.col("hypothesis").alias("premise"), F.col("premise").alias("hypothesis"))).distinct())
    given = hops.where("hop = 0").select("question_id", "hop")
    return rounded(scoring.chain_scores(responses, hops, nli, ["question_id"], given))


# ambiguous questions


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.struct("n_nationkey", "n_name")
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(nation)).alias("n"))
    return table(spark, sf_dir, "region").join(nations, "r_regionkey")


def rowwise_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose annotations are a list: the first is of no use, the second has each nation twice; evidence repeats and holds markup."""
    pair = lambda x: F.struct(F.concat(F.lit(" the  nation "), x["n_name"]).alias("question"), F.array(F.concat(F.lit(" "), x["n_name"]), F.lit(" ")).alias("answer"))
    again = lambda x: F.struct(F.concat(F.lit("THE nation "), x["n_name"]).alias("question"), F.array(F.lit("again")).alias("answer"))
    pairs = "array<struct<question: string, answer: array<string>>>"
    empty = F.struct(F.lit("multipleQAs").alias("type"), F.lit(None).cast("array<string>").alias("answer"), F.array().cast(pairs).alias("qaPairs"))
    full = F.struct(F.lit("multipleQAs").alias("type"), F.lit(None).cast("array<string>").alias("answer"), F.concat(F.transform("n", pair), F.transform("n", again)).alias("qaPairs"))
    hit = lambda x: F.struct(F.lit("<b>nation</b>").alias("title"), F.concat(F.lit("<b>It&#39;s</b>  "), x["n_name"], F.lit("&nbsp;")).alias("snippet"))
    used = F.array(F.struct(F.lit("q").alias("query"), F.concat(F.transform("n", hit), F.transform("n", hit)).alias("results")))
    return readings(spark, sf_dir).select(F.concat(F.lit(" "), "r_name").alias("id"), F.concat(F.lit("which nation of "), "r_name").alias("question"), F.array(empty, full).alias("annotations"), used.alias("used_queries"))


def columnar_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with parallel lists."""
    a = F.col("annotations")
    lists = lambda q: F.struct(F.transform(q, lambda p: p["question"]).alias("question"), F.transform(q, lambda p: p["answer"]).alias("answer"))
    used = F.col("used_queries")
    results = F.transform(used, lambda u: F.struct(F.transform(u["results"], lambda r: r["title"]).alias("title"), F.transform(u["results"], lambda r: r["snippet"]).alias("snippet")))
    return rowwise_raw(spark, sf_dir).select(
        "id", "question", F.struct(F.transform(a, lambda x: x["type"]).alias("type"), F.transform(a, lambda x: x["answer"]).alias("answer"), F.transform(a, lambda x: lists(x["qaPairs"])).alias("qaPairs")).alias("annotations"),
        F.struct(F.transform(used, lambda u: u["query"]).alias("query"), results.alias("results")).alias("used_queries"),
    )


def ambiguous_summary(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", "question", F.size("interpretations").alias("m0"), F.array_join(F.transform("interpretations", lambda i: F.concat(i["disambiguated_question"], F.lit("="), F.array_join(i["answers"], "+"))), "|").alias("readings"),
        F.array_join(F.transform("evidence", lambda e: F.concat(e["title"], F.lit(": "), e["snippet"])), "|").alias("evidence"),
    )


AMBIGUOUS_SQL = """
SELECT r_name AS id, 'which nation of ' || r_name AS question, CAST(count(*) AS INT) AS m0, string_agg('the  nation ' || n_name || '=' || n_name, '|' ORDER BY n_nationkey) AS readings,
  string_agg('nation: It''s ' || n_name, '|' ORDER BY n_nationkey) AS evidence FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
"""


@query(AMBIGUOUS_SQL)
def ambiguous_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ambiguous_summary(records.accepted(records.ambiguous(rowwise_raw(spark, sf_dir))))


@query(AMBIGUOUS_SQL)
def ambiguous_records_columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ambiguous_summary(records.accepted(records.ambiguous(columnar_raw(spark, sf_dir), columnar=True)))


HASHED = "list_reduce(list_transform(string_split(sha256(id || '::42'), ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT)), lambda a, d: (a * 16 + d) % m0) % m0"
LEVELS_SQL = f"""
m AS (SELECT r_name AS id, r_regionkey AS k, count(*) AS m0 FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL), t AS (SELECT *, {HASHED} AS t FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)"""


@query(f"""
WITH {LEVELS_SQL}, o AS (
  SELECT t.id, t.t, m0, i, n_name, row_number() OVER (PARTITION BY t.id ORDER BY CASE WHEN i = t THEN '' ELSE sha256(t.id || '::42::mid::' || i) END) AS r FROM t JOIN n ON n_regionkey = k
), s AS (SELECT id, string_agg(i::VARCHAR, ',' ORDER BY i) AS subset, count(*) AS size, string_agg(n_name, ',' ORDER BY CASE WHEN i = t THEN -1 ELSE i END) AS names FROM o WHERE r <= ceil(m0 / 2) GROUP BY id)
SELECT s.id AS question_id, CAST(l AS INT) AS spec_level, CAST(CASE l WHEN 0 THEN m0 WHEN 1 THEN size ELSE 1 END AS INT) AS m_valid, subset, CASE WHEN l = 1 THEN names ELSE '' END AS constraint_answers,
  round(log2(m0 / CASE l WHEN 0 THEN m0 WHEN 1 THEN size ELSE 1 END), 6) + 0.0::DOUBLE AS fi_spec FROM s JOIN m USING (id), (SELECT unnest([0, 1, 2]) AS l)
""")
def three_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of specificity with a middle one: half of the readings, the target among them."""
    rows = records.ambiguous(rowwise_raw(spark, sf_dir))
    m0 = F.size("interpretations")
    target = E.target_index(F.col("id"), m0, 42).cast("int")
    rows = rows.withColumn("mid_subset", E.mid_subset(F.col("id"), m0, target, 42)).withColumn("mid_text", F.concat(F.lit("some of "), "id"))
    levels = L.spec_levels(rows, middle=True).join(rows.select(F.col("id").alias("question_id"), listed("mid_subset").alias("subset")), "question_id")
    return rounded(levels.select("question_id", "spec_level", "m_valid", "subset", F.coalesce(F.array_join("constraint_answers", ","), F.lit("")).alias("constraint_answers"), "fi_spec"))


@query(f"""
WITH {LEVELS_SQL} SELECT t.id AS question_id, CAST(m0 AS INT) AS m0, CAST(m0 >= 2 AS INT) AS ambiguous, CAST(ceil(m0 / 2) AS INT) AS n_half, t < ceil(m0 / 2) AS survives,
  false AS leak_free, true AS trivial FROM t
""")
def question_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose evidence holds the target's answer, and whether its first half still does; the target reading as a rewrite leaks and is trivial."""
    rows = records.ambiguous(rowwise_raw(spark, sf_dir))
    chosen = A.pool(rows, "id", fraction=0.5)
    mine = F.get("interpretations", F.col("target_idx"))
    some = rows.select("id", F.col("evidence").alias("all_evidence"))
    kept = chosen.join(some, "id").join(A.holdout(rows).select("id", "ambiguous", "m0"), "id")
    text = mine["disambiguated_question"]
    return kept.select(
        F.col("id").alias("question_id"), "m0", "ambiguous", F.size("evidence").alias("n_half"), A.survives(mine["answers"], F.col("all_evidence")).alias("survives"),
        L.leak_free(text, F.col("interpretations")).alias("leak_free"), (~L.not_trivial(F.concat(text, F.lit("?")), F.col("question"), text)).alias("trivial"),
    )


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 = 1 END AS target_collision FROM orders")
def backfilled_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a flag of their customer; customers whose key divides by three have none."""
    flags = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 3 == 1).alias("target_collision"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(True).alias("target_collision"))
    known = rows.select("o_custkey").distinct().where("o_custkey % 3 <> 0").join(flags, "o_custkey", "full")
    known = known.withColumn("target_collision", F.coalesce("target_collision", F.col("o_custkey") % 3 == 1))
    return A.flagged(rows, known, "o_custkey", "target_collision").select("o_orderkey", "target_collision")


# model outputs behind the memo


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    body = F.to_json(F.struct(F.col("conv_id").alias("id"), F.lit("m").alias("model"), F.col("turn").alias("turn")))
    return rows.select("conv_id", "turn", body.alias("request_json")).withColumn("request_hash", X.request_key(F.col("request_json")))


@query("""
WITH r AS (SELECT conv_id, turn, sha256('{"id":' || conv_id || ',"model":"m","turn":' || turn || '}') AS request_hash FROM conversations WHERE text IS NOT NULL)
SELECT request_hash, max(conv_id) AS conv_id, max(turn) AS turn, true AS cached, (SELECT count(DISTINCT request_hash) FROM r) AS size FROM r GROUP BY request_hash
""")
def memo_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered through a memo: half are asked first, then all; no request is asked twice."""
    memo = providers.Memo(spark, shared_path(spark, "memo"))
    rows = asked(spark, sf_dir).dropDuplicates(["request_hash"])
    requests = rows.select("request_hash", F.lit("local").alias("provider"), F.lit("m").alias("model_id"), F.lit("answer").alias("purpose"), "request_json")
    memo.complete(requests.where(F.pmod(F.xxhash64("request_hash"), F.lit(2)) == 0), providers.echo)
    memo.complete(requests, providers.echo)
    answered = memo.answered(requests).join(memo.for_purpose("answer", "id bigint, turn bigint"), "request_hash")
    return answered.select("request_hash", F.col("id").alias("conv_id"), "turn", "cached", F.lit(memo.size()).alias("size"))


# candidates of a universe


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a rewording of the one before; its role and place of arrival follow from the turn."""
    rows = turns(spark, sf_dir).where("premise is not null and hypothesis is not null")
    return rows.select(F.col("conv_id").alias("question_id"), F.col("premise").alias("question"), F.lit("neutral").alias("role"), F.col("turn").alias("sample_idx"), F.col("turn").alias("pos"), F.col("hypothesis").alias("text"))


REASONS_SQL = f"""
{TURNS_SQL}, w AS (SELECT conv_id, turn, premise, hypothesis, {WORDS_SQL.format("premise")} AS p, {WORDS_SQL.format("hypothesis")} AS h FROM turns WHERE premise IS NOT NULL AND hypothesis IS NOT NULL),
s AS (SELECT *, CASE WHEN len(h) > 0 THEN len(list_intersect(h, p)) / len(h) ELSE 0 END AS fwd, CASE WHEN len(p) > 0 THEN len(list_intersect(h, p)) / len(p) ELSE 0 END AS bwd FROM w),
r AS (
  SELECT *, CASE WHEN lower(trim(hypothesis)) = lower(trim(premise)) THEN 'exact_duplicate' WHEN least(fwd, bwd) < 0.15 AND greatest(fwd, bwd) >= 0.15 THEN 'nli_one_direction' WHEN least(fwd, bwd) < 0.15 THEN 'nli_low'
    WHEN NOT bool_or(turn % 3 <> 0) OVER (PARTITION BY conv_id, hypothesis) THEN 'constraint_mismatch' END AS reason FROM s
)"""


@query(f"WITH {REASONS_SQL} SELECT conv_id AS question_id, turn AS sample_idx, round(fwd, 6) AS nli_fwd, round(bwd, 6) AS nli_bwd, coalesce(reason, 'passed') AS reason FROM r")
def candidate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first filter that each candidate fails; equal texts of one question share the verdict of any of their votes."""
    votes = lambda c: U.admitted(c.select("question_id", "text", (F.col("sample_idx") % 3 != 0).alias("vote")))
    scored = U.judged(candidates(spark, sf_dir), providers.overlap, votes)
    return rounded(U.reasons(scored, 0.15).select("question_id", "sample_idx", "nli_fwd", "nli_bwd", F.coalesce("reason", F.lit("passed")).alias("reason")))


@query(f"""
WITH {REASONS_SQL}, q AS (SELECT conv_id, list(least(fwd, bwd) ORDER BY least(fwd, bwd)) AS v FROM r GROUP BY conv_id)
SELECT conv_id AS question_id, CAST(len(v) AS INT) AS n, round(v[len(v) // 2 + 1], 6) AS p50, round(v[greatest(0, CAST(floor(len(v) * 0.9) AS INT) - 1) + 1], 6) AS p90, round(v[len(v)], 6) AS high FROM q
""")
def batch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = U.entailed_both(candidates(spark, sf_dir), providers.overlap(_both(candidates(spark, sf_dir))))
    return rounded(U.batch_quantiles(scored.withColumn("low", F.least("nli_fwd", "nli_bwd")), ["question_id"], "low"))


def _both(rows: DataFrame) -> DataFrame:
    pairs = rows.select(F.col("question").alias("premise"), F.col("text").alias("hypothesis"))
    return pairs.unionByName(pairs.select(F.col("hypothesis").alias("premise"), F.col("premise").alias("hypothesis"))).distinct()


@query(f"""
WITH {REASONS_SQL}, o AS (SELECT conv_id, turn, round(least(fwd, bwd), 6) AS low, row_number() OVER (PARTITION BY conv_id ORDER BY round(least(fwd, bwd), 6) DESC, turn) - 1 AS place FROM r)
SELECT conv_id AS question_id, turn AS sample_idx, CAST(place AS INT) AS place FROM o
""")
def trusted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in order of trust."""
    rows = candidates(spark, sf_dir)
    scored = U.entailed_both(rows, providers.overlap(_both(rows))).withColumns({"jaccard": F.lit(0.0), "nli_fwd": F.round("nli_fwd", 6), "nli_bwd": F.round("nli_bwd", 6)})
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(*U.priority())) - 1
    return scored.select("question_id", "sample_idx", place.alias("place"))


@query(f"""
WITH RECURSIVE {REASONS_SQL}, u AS (SELECT conv_id AS g, turn, hypothesis AS t, row_number() OVER (PARTITION BY conv_id ORDER BY round(least(fwd, bwd), 6) DESC, turn) AS pos FROM r),
k AS (
  SELECT g, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS kept FROM (SELECT DISTINCT g FROM u)
  UNION ALL
  SELECT k.g, u.pos, CASE WHEN trim(u.t) = '' OR len(list_filter(k.kept, lambda x: CASE WHEN abs(length(x) - length(u.t)) < 5 THEN levenshtein(x, u.t) < 5 ELSE false END)) > 0 THEN k.kept ELSE list_append(k.kept, u.t) END
  FROM k JOIN u ON u.g = k.g AND u.pos = k.pos + 1
), f AS (SELECT g, arg_max(kept, pos) AS kept FROM k GROUP BY g),
o AS (SELECT u.*, kept, row_number() OVER (PARTITION BY u.g, t ORDER BY u.pos) AS copy FROM u JOIN f ON u.g = f.g)
SELECT g AS question_id, turn AS sample_idx, CAST(CASE WHEN copy = 1 AND list_contains(kept, t) THEN list_position(kept, t) - 1 END AS INT) AS place,
  CASE WHEN copy = 1 AND list_contains(kept, t) THEN NULL WHEN list_contains(kept, t) THEN 'exact_duplicate' ELSE 'edit_distance_close' END AS reason FROM o
""")
def kept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's candidates in order of trust: the place of those that are kept, and why the others are not."""
    rows = candidates(spark, sf_dir)
    scored = U.entailed_both(rows, providers.overlap(_both(rows))).withColumns({"jaccard": F.lit(0.0), "nli_fwd": F.round("nli_fwd", 6), "nli_bwd": F.round("nli_bwd", 6)})
    return U.distinct_texts(scored).select("question_id", "sample_idx", "place", "reason")


@query(f"""
WITH {REASONS_SQL} SELECT conv_id AS question_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, turn AS sample_idx, hypothesis AS text, reason FROM r
""")
def flattened_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of accepted and rejected candidates, nested by question, as rows again."""
    votes = lambda c: U.admitted(c.select("question_id", "text", (F.col("sample_idx") % 3 != 0).alias("vote")))
    rows = U.reasons(U.judged(candidates(spark, sf_dir), providers.overlap, votes), 0.15)
    both = {"accepted": F.when(F.isnull("reason"), F.struct("sample_idx", "text")), "rejected": F.when(F.isnotnull("reason"), F.struct("sample_idx", "text", "reason"))}
    sets = rows.groupBy("question_id").agg(*(F.collect_list(c).alias(n) for n, c in both.items()))  # a question's candidates are personas times samples
    return U.flattened(sets).select("question_id", "outcome", "sample_idx", "text", "reason")


# streams


@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1
""")
def streamed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream, kept by micro-batch, and the last of each user."""
    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("user_id", "event_id", "event_type", "value")
    path = shared_path(spark, "stream")
    S.upsert_batches(stream, path, shared_path(spark, "stream-state")).awaitTermination()
    # the folder of a batch is no order of events
    return last_wins(spark.read.parquet(path).drop("batch"), ["user_id"], ["event_id"])


#: Every so many events come with the part after their own; parts are quarters of the events in order of time.
LATE, PARTS, FILES = 20, 4, 4
PARTED_SQL = f"""
ordered AS (SELECT *, least({PARTS - 1}, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {PARTS} // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) + CASE WHEN event_id % {LATE} = 0 THEN 1 ELSE 0 END) AS part FROM events WHERE ts IS NOT NULL),
marks AS (SELECT part, max(max(epoch_us(ts))) OVER (ORDER BY part) - 3600000000 AS mark FROM ordered GROUP BY part),
timely AS (
  SELECT event_type, value, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS opened_us, coalesce((SELECT max(mark) FROM marks m WHERE m.part < o.part - 1), -1) AS mark FROM ordered o
)"""


@query(f"""
WITH {PARTED_SQL} SELECT event_type, opened_us, count(*) AS n, round(sum(value), 4) AS total FROM timely WHERE opened_us + 21600000000 > mark GROUP BY ALL
HAVING opened_us + 21600000000 <= (SELECT max(mark) FROM marks)
""")
def watermarked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours over a stream of four batches: events whose window closed with the batch before are dropped, windows still open are not given."""
    rows = table(spark, sf_dir, "events").where("ts is not null").select("event_id", "event_type", "value", F.unix_micros(F.to_utc_timestamp(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"), "UTC")).alias("us"))
    ends = rows.agg(F.min("us").alias("low"), F.max("us").alias("high"))
    part = F.floor((F.col("us") - F.col("low")) * PARTS / (F.col("high") - F.col("low") + 1)) + (F.col("event_id") % LATE == 0).cast("int")
    dealt = rows.join(F.broadcast(ends), how="cross").withColumn("part", F.least(F.lit(PARTS - 1), part))  # one row
    path = shared_path(spark, "arrivals")
    for i in range(PARTS):  # files arrive part by part
        dealt.where(F.col("part") == i).select("event_type", F.timestamp_micros("us").alias("ts"), "value").repartition(FILES).write.mode("append").parquet(path)
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", FILES).parquet(path)
    out = shared_path(spark, "closed")
    S.windows_to(S.watermarked(stream, "ts", "1 hour", "6 hours", ["event_type"], "value"), out, shared_path(spark, "windows-state")).awaitTermination()
    closed = spark.read.schema("event_type string, opened timestamp, n long, total double").parquet(out)
    return rounded(closed.select("event_type", F.unix_micros("opened").alias("opened_us"), "n", "total"), 4)


@query("""
WITH t AS (SELECT conv_id, lower(coalesce(text, '')) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
a AS (SELECT conv_id, regexp_extract(text, '[a-z]+') AS answer FROM t WHERE i = n), f AS (SELECT unnest([0.25, 0.5, 1.0]::DOUBLE[]) AS fraction),
s AS (SELECT fraction, t.conv_id, max(n) AS n, bool_or(i <= ceil(n * fraction) AND contains(text, answer)) AS survives FROM t JOIN a USING (conv_id), f GROUP BY ALL)
SELECT fraction, count(*) FILTER (survives) AS n_questions, round(avg(n) FILTER (survives), 6) AS mean_size FROM s GROUP BY fraction
""")
def evidence_dial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first share of turns still holds the first word of the last: how many, and their mean size."""
    turn = F.struct("turn", F.coalesce("text", F.lit("")).alias("snippet"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("evidence"))
    answer = F.array(F.regexp_extract(F.lower(F.get("evidence", F.size("evidence") - 1)["snippet"]), "[a-z]+", 0))
    at = [rows.select(F.lit(f).alias("fraction"), F.size("evidence").alias("n"), A.survives(answer, F.col("evidence"), f).alias("survives")) for f in (0.25, 0.5, 1.0)]
    every = at[0].unionByName(at[1]).unionByName(at[2])
    return rounded(every.groupBy("fraction").agg(F.sum(F.col("survives").cast("long")).alias("n_questions"), F.avg(F.when(F.col("survives"), F.col("n"))).alias("mean_size")))


@query(f"""
WITH {PARTS_SQL}, q AS (SELECT id, count(*) FILTER (p_size >= 25) AS n FROM p GROUP BY id), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY sha256('9::' || id), id::VARCHAR) AS r FROM q)
SELECT 'musique' AS dataset, n::VARCHAR AS hops, count(*) AS n FROM r WHERE r <= 2 AND n >= 2 GROUP BY n
""")
def sample_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: two questions of each number of hops from two on, counted by stratum."""
    from ..sources.sinks import sample_manifest as manifest

    rows = records.decomposed(decomposed_raw(spark, sf_dir)).select("id", F.col("n_hops").alias("hops"))
    sample = A.per_stratum(rows, "hops", "id", 2, 9, least=2).withColumn("hops", F.col("hops").cast("string"))
    return manifest(sample, "musique", ["hops"])[1]
