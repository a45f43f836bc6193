"""Queries of checks and summaries: gates, ladder orders, rank matrices, pools, gaps, dumps of vectors and token probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import audits as A
from ..operators import cells as C
from ..operators import scoring
from ..operators.factors import factors
from ..sources import sinks
from .metrics import COUNTS_SQL, INPUT_SQL, by_model, model_facts, samples
from .registry import Registry, rounded, table

query = Registry()

GATE_SQL = """
means AS (
  SELECT avg(l_quantity) FILTER (l_linestatus = 'F') AS q0, avg(l_quantity) FILTER (l_linestatus = 'O') AS q1, avg(l_discount) FILTER (l_linestatus = 'F') AS d0,
    avg(l_discount) FILTER (l_linestatus = 'O') AS d1, avg(l_tax) FILTER (l_linestatus = 'F') AS t0, avg(l_tax) FILTER (l_linestatus = 'O') AS t1 FROM lineitem
)"""


@query(f"""
WITH {GATE_SQL} SELECT 'l_quantity' AS name, round(q0, 6) AS low, round(q1, 6) AS high, true AS hard, q1 > q0 AS holds FROM means
UNION ALL SELECT 'l_discount', round(d0, 6), round(d1, 6), true, d1 >= d0 FROM means UNION ALL SELECT 'l_tax', round(t0, 6), round(t1, 6), false, t1 <= t0 FROM means
""")
def level_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.gate(table(spark, sf_dir, "lineitem"), "l_linestatus", "F", "O", {"l_quantity": ">", "l_discount": ">="}, {"l_tax": "<=", "absent": ">="}))


def laddered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are added in the order in which the table holds them, as SQL's engine meets them on one thread."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return A.by_ladder(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber"], "l_returnflag", ("R", "N", "A"), "l_discount", place)


LADDER_SQL = """
wide AS (
  SELECT l_partkey, l_linenumber, avg(l_discount) FILTER (l_returnflag = 'R') AS gold_first, avg(l_discount) FILTER (l_returnflag = 'N') AS random, avg(l_discount) FILTER (l_returnflag = 'A') AS distractor_first
  FROM lineitem GROUP BY ALL
)"""


@query(f"""
WITH {LADDER_SQL} SELECT l_partkey, l_linenumber, round(gold_first, 6) AS gold_first, round(random, 6) AS random, round(distractor_first, 6) AS distractor_first,
  gold_first >= random AND random >= distractor_first AS in_order FROM wide
""")
def ladder_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as ladders: the mean of each for every question and level."""
    return rounded(laddered(spark, sf_dir))


@query(f"""
WITH {LADDER_SQL}, f AS (SELECT l_linenumber % 2 AS half, gold_first >= random AND random >= distractor_first AS ok FROM wide WHERE gold_first IS NOT NULL AND random IS NOT NULL AND distractor_first IS NOT NULL)
SELECT half, count(*) AS checked, CAST(sum(ok::INT) AS BIGINT) AS consistent, round(avg(ok::INT), 6) AS rate FROM f GROUP BY half
""")
def ladder_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.order_rate(laddered(spark, sf_dir).withColumn("half", F.col("l_linenumber") % 2), ["half"]))


@query("""
SELECT CAST(l_linenumber AS INT) AS level, round(avg(l_discount), 6) AS value,
  round(least(5, CASE WHEN l_linenumber > 8 THEN 0 ELSE -log2(1 - (10 - l_linenumber) * (9 - l_linenumber) / 90) END), 6) AS bits FROM lineitem GROUP BY l_linenumber
""")
def quality_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.quality_against_bits(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_discount", 10, 2))


RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"
METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""
WITH r AS (SELECT {", ".join(f"{RANK.format(m)} AS {m}" for m in METRICS)} FROM lineitem WHERE {" AND ".join(f"{m} IS NOT NULL" for m in METRICS)})
{" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho, count(*) AS n FROM r" for i, a in enumerate(METRICS) for b in METRICS[i + 1 :])}
""")
def rank_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.rank_matrix(table(spark, sf_dir, "lineitem"), list(METRICS)))


GROUP_RANK = "rank() OVER (PARTITION BY l_returnflag ORDER BY {0}) + (count(*) OVER (PARTITION BY l_returnflag, {0}) - 1) / 2"
#: The matrix 4 - C of each group, whose largest eigenvalue (by powers) is 4 less the smallest of C.
POWER_SQL = f"""
WITH RECURSIVE r AS (SELECT l_returnflag, {", ".join(f"{GROUP_RANK.format(m)} AS {m}" for m in METRICS)} FROM lineitem WHERE {" AND ".join(f"{m} IS NOT NULL" for m in METRICS)}),
m AS (SELECT l_returnflag, [{", ".join("[" + ", ".join("3.0" if a == b else f"-coalesce(corr({a}, {b}), 0)" for b in METRICS) + "]" for a in METRICS)}] AS m FROM r GROUP BY l_returnflag),
v AS (
  SELECT l_returnflag, 0 AS i, [0.7, 0.1, -0.5, 0.4]::DOUBLE[] AS v FROM m
  UNION ALL SELECT l_returnflag, i + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u)))
  FROM (SELECT l_returnflag, i, list_transform(m, lambda w: list_dot_product(w, v)) AS u FROM v JOIN m USING (l_returnflag) WHERE i < 2000)
)"""


@query(f"""
{POWER_SQL} SELECT l_returnflag, 4.0::DOUBLE AS total, round(list_dot_product(v, list_transform(m, lambda w: list_dot_product(w, v))) / 4, 6) AS explained
FROM v JOIN m USING (l_returnflag) WHERE i = 2000
""")
def factor_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the eigenvalues of each group's rank matrix, and the share of the first three."""
    found = factors(table(spark, sf_dir, "lineitem"), ["l_returnflag"], list(METRICS))
    return rounded(found.groupBy("l_returnflag").agg(F.sum("eigenvalue").alias("total"), F.max("explained").alias("explained")))


@query()
def factor_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated loadings of a line's numbers on three factors, for each return flag."""
    found = factors(table(spark, sf_dir, "lineitem"), ["l_returnflag"], list(METRICS))
    return rounded(found.select("l_returnflag", "name", "factor", *(F.col("loadings")[k].alias(f"loading_{k}") for k in range(3))))


@query(f"""
{" UNION ALL ".join(f"SELECT '{m}' AS name, round(corr(x, y), 6) AS rho, count(*) AS n, abs(corr(x, y)) > 0.95 AS redundant FROM (SELECT {RANK.format('l_quantity')} AS x, {RANK.format(m)} AS y FROM lineitem WHERE l_quantity IS NOT NULL AND {m} IS NOT NULL)" for m in METRICS[1:])}
""")
def collinearity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.redundant(table(spark, sf_dir, "lineitem"), "l_quantity", list(METRICS[1:])))


MODEL_CELLS_SQL = f"""{by_model(INPUT_SQL)}, counts AS (SELECT cell, par, cluster, count(*) AS n FROM samples GROUP BY ALL), shares AS (SELECT *, n / sum(n) OVER (PARTITION BY cell, par) AS p FROM counts),
h AS (SELECT cell, avg(h) AS h_sem_mean FROM (SELECT cell, par, sum(-p * log2(p)) AS h FROM shares GROUP BY cell, par) GROUP BY cell), a AS (SELECT cell, count(DISTINCT cluster) AS a_q FROM counts GROUP BY cell)"""
RANKED = "rank() OVER (ORDER BY round({0}, 9)) + (count(*) OVER (PARTITION BY round({0}, 9)) - 1) / 2"


def model_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["cell", "model"]
    rows = samples(spark, sf_dir).withColumn("model", (F.col("par") % 5).cast("int"))
    return C.input_metrics(model_facts(spark, sf_dir), by).join(C.output_metrics(C.cluster_counts(rows, by), by), by)


@query(f"""
WITH {MODEL_CELLS_SQL}, j AS (SELECT * FROM input JOIN h USING (cell) WHERE f_mean IS NOT NULL)
{" UNION ALL ".join(f"SELECT '{n}' AS name, round(corr(x, y), 6) AS rho, count(*) AS n FROM (SELECT {RANKED.format('f_mean')} AS x, {RANKED.format(c)} AS y FROM j)" for n, c in (("aufi", "aufi"), ("entropy", "h_sem_mean"), ("fragility", "rho_f")))}
""")
def metric_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of accuracy with the other metrics over the cells of five models."""
    r = lambda c: F.round(c, 9)
    rows = model_cells(spark, sf_dir).withColumn("f_mean", r("f_mean"))
    return rounded(A.correlations_with(rows, "f_mean", {"aufi": r("aufi"), "entropy": r("h_sem_mean"), "fragility": r("rho_f")}))


#: Cells of three models: a fifth of a model's users and one type of events. Prompts and answers of a matrix are four each.
SMALL_CELL_SQL = "event_type || '/' || (user_id // 3 % 5) || '/' || (user_id % 3)"
SMALL_SQL = f"""{INPUT_SQL.replace("event_type AS cell, user_id AS par", SMALL_CELL_SQL + " AS cell, user_id AS par")}, counts AS (SELECT cell, par, cluster, count(*) AS n FROM samples GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY cell, par) AS p FROM counts), h AS (SELECT cell, par, sum(-p * log2(p)) AS h FROM shares GROUP BY cell, par), a AS (SELECT cell, count(DISTINCT cluster) AS a_q FROM counts GROUP BY cell),
output AS (SELECT cell, avg(h) AS h_sem_mean, avg(CASE WHEN a_q <= 1 THEN 0 ELSE h / log2(a_q) END) AS s_tau_mean FROM h JOIN a USING (cell) GROUP BY cell),
pars AS (SELECT DISTINCT cell, par FROM counts), pairs AS (SELECT x.cell, x.par AS a, y.par AS b FROM pars x JOIN pars y ON x.cell = y.cell AND x.par < y.par),
common AS (SELECT x.cell, x.par AS a, y.par AS b, sum(least(x.p, y.p)) AS s FROM shares x JOIN shares y ON x.cell = y.cell AND x.cluster = y.cluster AND x.par < y.par GROUP BY ALL),
agree AS (SELECT cell, avg(coalesce(s, 0)) AS consistency FROM pairs LEFT JOIN common USING (cell, a, b) GROUP BY cell),
matrix AS (SELECT {SMALL_CELL_SQL} AS cell, user_id // 15 % 4 AS i, CAST(json_extract_string(props, '$.k') AS INT) // 10 // 3 AS j, -avg(value) AS lp FROM events GROUP BY ALL),
psi AS (SELECT m.cell, coalesce(avg(abs(m.lp - o.lp) / (1 + m.j % 7)) FILTER (m.i <> m.j), 0) AS psi FROM matrix m JOIN matrix o ON o.cell = m.cell AND o.i = m.j AND o.j = m.j GROUP BY m.cell),
wide AS (
  SELECT CAST(string_split(cell, '/')[3] AS INT) AS model, round(psi, 9) AS x, round(1 - coalesce(consistency, 1), 9) AS tvd_sensitivity, round(h_sem_mean, 9) AS h_sem_mean, round(s_tau_mean, 9) AS s_tau_mean, round(rho_f, 9) AS rho_f
  FROM psi JOIN output USING (cell) LEFT JOIN agree USING (cell) LEFT JOIN input USING (cell)
), tall AS (SELECT model, x, name, y FROM wide UNPIVOT (y FOR name IN (tvd_sensitivity, h_sem_mean, s_tau_mean, rho_f)) WHERE y IS NOT NULL AND NOT isnan(y)),
ranks AS (
  SELECT model, name, rank() OVER (PARTITION BY model, name ORDER BY x) + (count(*) OVER (PARTITION BY model, name, x) - 1) / 2 AS p, rank() OVER (PARTITION BY model, name ORDER BY y) + (count(*) OVER (PARTITION BY model, name, y) - 1) / 2 AS q FROM tall
)"""


@query(f"""
WITH {SMALL_SQL} SELECT model, name, round(CASE WHEN count(*) >= 3 AND stddev_pop(p) > 0 AND stddev_pop(q) > 0 THEN corr(p, q) END, 6) AS rho, count(*) AS n FROM ranks GROUP BY model, name
""")
def posix_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model, rank correlations over cells of the log-probability index with three measures of dispersion and with fragility."""
    by, block, model = ["cell", "block", "model"], F.floor(F.col("user_id") / 3) % 5, (F.col("user_id") % 3).cast("int")
    rows = samples(spark, sf_dir).withColumns({"user_id": F.col("par"), "block": F.floor(F.col("par") / 3) % 5, "model": (F.col("par") % 3).cast("int")})
    counts = C.cluster_counts(rows, by)
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), block.alias("block"), model.alias("model"), (F.floor(F.col("user_id") / 15) % 4).alias("i"), F.floor(F.floor(F.get_json_object("props", "$.k").cast("int") / 10) / 3).alias("j"), "value")
    matrix = events.groupBy(*by, "i", "j").agg((-F.avg("value")).alias("lp"))
    lengths = matrix.select(*by, "j", (1 + F.col("j") % 7).alias("len")).distinct()
    wide = C.posix(matrix, lengths, by).join(C.output_metrics(counts, by), by).join(C.consistency(counts, by), by, "left")
    wide = wide.join(C.input_metrics(C.facts(C.graded(rows, by), by), by).select(*by, "rho_f"), by, "left")
    others = {"tvd_sensitivity": 1 - F.coalesce("consistency", F.lit(1.0)), "h_sem_mean": F.col("h_sem_mean"), "s_tau_mean": F.col("s_tau_mean"), "rho_f": F.col("rho_f")}
    return rounded(A.correlations_by(wide, ["model"], F.round("posix_psi", 9), {n: F.round(c, 9) for n, c in others.items()}))


@query("""
WITH c AS (SELECT event_type, user_id, event_id % 7 AS block, count(DISTINCT CAST(json_extract_string(props, '$.k') AS INT) // 10) AS a_q FROM events GROUP BY ALL)
SELECT CAST(user_id % 5 AS INT) AS model, round(avg((a_q = 1)::INT), 6) AS degenerate, count(*) AS n FROM c GROUP BY 1
""")
def degenerate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cells with one cluster of answers: a user's events of one type, in seven blocks, by model."""
    rows = samples(spark, sf_dir).withColumns({"model": (F.col("par") % 5).cast("int"), "block": F.col("sample") % 7, "user": F.col("par")})
    by = ["cell", "user", "block", "model"]
    return rounded(A.degenerate(C.answer_space(C.cluster_counts(rows, by), by), ["model"]))


@query("""
WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT count(*) AS n_cells, CAST(sum(n * 10) AS BIGINT) AS n_calls, count(DISTINCT o_orderstatus) AS n_levels, median(n)::DOUBLE AS median_snippets FROM c
""")
def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return A.planned(cells, 10, "n", "o_orderstatus", "n")


# arrays of scores, as stored with a cell

ARRAYS_SQL = """
scores AS (SELECT event_type AS cell, user_id % 25 AS part, user_id AS par, avg((value >= 10 + 10 * (user_id % 7))::INT) AS f FROM events GROUP BY ALL),
sums AS (
  SELECT cell, part, count(*) AS n, avg(f) AS m, 10 * var_samp(f) AS msb, avg(10 * f * (1 - f)) / 9 AS msw, count(*) FILTER (f >= 0.5 - 1e-9) AS p5, count(*) FILTER (f >= 1 - 1e-9) AS p10,
    count(*) FILTER (f >= 0.25) AS p4 FROM scores GROUP BY ALL
)"""


@query(f"""
WITH {ARRAYS_SQL} SELECT cell, part, round(CASE WHEN n > 1 AND msb + 9 * msw > 0 THEN least(1, greatest(0, (msb - msw) / (msb + 9 * msw))) END, 6) AS rho_f,
  round(greatest(0, least(log2(n + 1), CASE WHEN p10 = 0 THEN 1e9 ELSE log2(n / p10) END) - least(log2(n + 1), CASE WHEN p5 = 0 THEN 1e9 ELSE log2(n / p5) END)), 6) AS fi_premium,
  CASE WHEN p4 = 0 THEN CAST('inf' AS DOUBLE) ELSE round(log2(n / p4), 6) + 0.0::DOUBLE END AS fi_quarter, round(coalesce(m, 0.5), 6) AS f_mean, round(log2(greatest(n, 1)) - m, 6) AS fi_out_fixed
FROM sums
""")
def stored_sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivities computed anew from the arrays of scores that rows hold."""
    events = table(spark, sf_dir, "events")
    y = (F.col("value") >= 10 + 10 * (F.col("user_id") % 7)).cast("int")
    users = events.groupBy(F.col("event_type").alias("cell"), (F.col("user_id") % 25).alias("part"), "user_id").agg(F.avg(y).alias("f"))
    rows = users.groupBy("cell", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "f"))), lambda p: p["f"]).alias("f_graded_per_paraphrase"))
    rows = A.sensitivities(rows.withColumn("n_samples_per_prompt", F.lit(0)))
    s = F.col("f_graded_per_paraphrase")
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
    fi = E.fi_at(s, 0.25)
    rho = F.when(~F.isnan("rho_f"), F.round("rho_f", 6))
    none = F.lit(None).cast("double")
    return rows.select(
        "cell", "part", rho.alias("rho_f"), F.round("fi_premium", 6).alias("fi_premium"), F.when(fi == E.INF, fi).otherwise(F.round(fi, 6)).alias("fi_quarter"),
        F.round(A.filled_mean(E.aufi(E.fi_curve(s), F.size(s)), F.size(s), mean), 6).alias("f_mean"), F.round(A.fixed_information(none, F.size(s), mean), 6).alias("fi_out_fixed"),
    )


# gaps between a chain and its final answer

GAP_SQL = """
chains AS (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) / 100 AS chain_f, CAST(value >= 20 AS INT) AS final_f, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS parsed,
    (event_id % 10) / 10 AS entail, (event_id % 3) / 4 AS contradict FROM events
), sample AS (SELECT * FROM chains ORDER BY CASE WHEN chain_f >= 0.8 AND final_f = 0 THEN 0 ELSE 1 END, CASE WHEN NOT (chain_f >= 0.8 AND final_f = 0) THEN final_f END NULLS FIRST, event_id LIMIT 50)"""


@query(f"""
WITH {GAP_SQL}, k AS (
  SELECT CASE WHEN parsed = '' THEN 'parse_failure' WHEN entail >= 0.4 AND entail < 0.7 AND contradict < 0.5 THEN 'nli_too_strict' ELSE 'model_wrong' END AS kind FROM sample
) SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY kind
""")
def final_answer_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why final answers fail though their chains score high: a report of fifty."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(
        "event_id", (k / 100).alias("chain_f"), (F.col("value") >= 20).cast("int").alias("final_f"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("parsed"),
        (F.col("event_id") % 10 / 10).alias("entail"), (F.col("event_id") % 3 / 4).alias("contradict"),
    )
    return rounded(A.gap_counts(A.gap_sample(rows, "chain_f", "final_f", "event_id", 50), scoring.failure_kind()))


# dumps of vectors


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as hidden states of three layers: prompt ``vec_id // 3``, four prompts a cell."""
    v, prompt = F.col("vec_id"), F.floor(F.col("vec_id") / 3)
    return table(spark, sf_dir, "embeddings").select(
        F.floor(prompt / 4).cast("string").alias("question_id"), F.lit(0).alias("spec_level"), (v % 2).cast("string").alias("model_key"), (prompt % 4).cast("int").alias("paraphrase_idx"),
        F.lit("tbg").alias("position"), (v % 3).cast("int").alias("layer_idx"), ((v % 3 + 2) / 4).alias("layer_frac"), F.size("embedding").alias("dim"), F.lit("float16").alias("dtype"),
        prompt.alias("prompt"), "embedding", sinks.half("embedding").alias("vec"),
    )


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dim, true AS close FROM embeddings WHERE embedding IS NOT NULL")
def decoded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors coded in half precision and decoded: every number is within half a unit of its eleventh bit."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding", sinks.whole(sinks.half("embedding"), F.size("embedding")).alias("again"))
    near = F.forall(F.arrays_zip("embedding", "again"), lambda p: F.abs(p["embedding"].cast("double") - p["again"].cast("double")) <= F.abs(p["embedding"].cast("double")) / 2048 + 2.0**-25)
    return rows.select("vec_id", F.size("again").alias("dim"), near.alias("close"))


@query("""
WITH d AS (SELECT vec_id // 3 // 4 AS q, vec_id % 2 AS m, vec_id // 3 % 4 AS i, vec_id % 3 AS layer FROM embeddings),
runs AS (SELECT m, q, layer, min(i) = 0 AND max(i) + 1 = count(*) AND count(DISTINCT i) = count(*) AS ok FROM d GROUP BY m, q, layer),
sets AS (SELECT m, count(DISTINCT layers) AS n FROM (SELECT m, q, list_sort(list(DISTINCT layer)) AS layers FROM d GROUP BY m, q) GROUP BY m)
SELECT m::VARCHAR AS model_key, 'gaps' AS problem, count(*) AS n FROM runs WHERE NOT ok GROUP BY m
UNION ALL SELECT m::VARCHAR, 'layer_sets', n FROM sets WHERE n > 1
""")
def dump_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dump_problems(dump(spark, sf_dir))


@query("""
WITH p AS (SELECT vec_id // 3 AS prompt, vec_id % 3 AS layer, embedding::DOUBLE[] AS e FROM embeddings)
SELECT prompt, CAST(sum(len(e)) AS INT) AS dims, round(sum(list_sum(e) * (layer + 1)), 3) AS checksum FROM p GROUP BY prompt HAVING count(*) = 3
""")
def layer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.layer_features(dump(spark, sf_dir).withColumn("x", F.transform("embedding", lambda x: x.cast("double"))), ["prompt"], [0.5, 0.75, 1.0])
    n = F.size("features")
    total = F.aggregate(F.transform("features", lambda x, i: x * (F.floor(i / (n / 3)) + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("prompt", n.alias("dims"), F.round(total, 3).alias("checksum"))


@query("""
WITH v AS (SELECT vec_id, list_sum(embedding::DOUBLE[]) AS s, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS l FROM embeddings),
m AS (SELECT vec_id // 4 AS text_id, avg(s) FILTER (vec_id % 4 < 3) AS pooled FROM v GROUP BY 1)
SELECT vec_id, round(CASE WHEN l > 0 THEN s / l ELSE s END, 4) AS unit_sum, round(pooled, 4) AS pooled_sum FROM v JOIN m ON text_id = vec_id // 4
""")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length 1, and the masked mean of four token vectors each, by the sum of their numbers."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 4).alias("text_id"))
    token = F.struct("vec_id", "embedding")
    texts = rows.groupBy("text_id").agg(F.array_sort(F.collect_list(token)).alias("t"))
    mask = F.transform("t", lambda t: (t["vec_id"] % 4 < 3).cast("int"))
    pooled = sinks.masked_mean(F.transform("t", lambda t: t["embedding"]), mask)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    texts = texts.select("text_id", F.round(total(pooled), 4).alias("pooled_sum"))
    return rows.join(texts, "text_id").select("vec_id", F.round(total(sinks.unit(F.col("embedding"))), 4).alias("unit_sum"), "pooled_sum")


@query("""
WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
n AS (SELECT vec_id, max(x) + ln(sum(exp(x))) - max(x) AS norm FROM l GROUP BY vec_id),
r AS (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM l)
SELECT vec_id, CAST(max(i) FILTER (r = 1) AS INT) AS likeliest, round(max(x) FILTER (r = 1) - max(norm), 5) AS logprob, round(max(x) FILTER (i = vec_id % 64) - max(norm), 5) AS taken
FROM r JOIN n USING (vec_id) GROUP BY vec_id
""")
def step_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as logits of one step: log-probabilities of the taken and of the likeliest token."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", A.step_logprobs(logits, (F.col("vec_id") % 64).cast("int"), 3).alias("s"))
    return rows.select("vec_id", F.get("s.top", 0)["token"].alias("likeliest"), F.round(F.get("s.top", 0)["logprob"], 5).alias("logprob"), F.round("s.logprob", 5).alias("taken"))


@query("""
WITH e AS (SELECT event_type, user_id % 40 AS prompt, event_id, value FROM events WHERE event_type IS NOT NULL)
SELECT event_type, prompt, count(*) AS n_tokens, round(sum(-value / 10), 4) AS chat_total, round(coalesce(sum(-value / 10) FILTER (event_id % 3 <> 0), 0), 4) AS text_total FROM e GROUP BY ALL
""")
def reply_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities in the two shapes that services reply with, parsed and added up; the second leaves out entries without one."""
    rows = table(spark, sf_dir, "events").where("event_type is not null").select("event_type", (F.col("user_id") % 40).alias("prompt"), "event_id", (-F.col("value") / 10).alias("lp"))
    token = F.struct(F.col("event_id").cast("string").alias("token"), F.col("lp").alias("logprob"))
    known = F.when(F.col("event_id") % 3 != 0, F.col("lp"))
    lists = rows.groupBy("event_type", "prompt").agg(F.collect_list(token).alias("content"), F.collect_list(F.struct(F.col("event_id").cast("string").alias("t"), known.alias("p"))).alias("l"))
    chat = F.to_json(F.struct(F.struct("content").alias("logprobs")))
    text = F.to_json(F.struct(F.struct(F.col("l.t").alias("tokens"), F.col("l.p").alias("token_logprobs")).alias("logprobs")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, t: a + t["logprob"])
    parsed = lists.select("event_type", "prompt", A.chat_logprobs(chat).alias("c"), A.text_logprobs(text).alias("t"))
    return parsed.select("event_type", "prompt", F.size("c").cast("long").alias("n_tokens"), F.round(total("c"), 4).alias("chat_total"), F.round(total("t"), 4).alias("text_total"))
