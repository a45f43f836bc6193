"""Queries of the per-cell metrics.

Cells come from ``events``: the cell is the type, the paraphrase the user, the samples all of a user's events of the
type; a sample succeeds if its value reaches a bound of the user's, and its cluster is the tens digit of ``props.k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import bootstrap as B
from ..operators import cells as C
from ..operators.factors import rank_correlation as correlated
from .registry import Registry, rounded, table

query = Registry()
CELL = ["cell"]
RESAMPLES = 200

SAMPLES_SQL = """
samples AS (
  SELECT event_type AS cell, user_id AS par, event_id AS sample, CAST(value >= 10 + 10 * (user_id % 7) AS INT) AS y,
    CAST(json_extract_string(props, '$.k') AS INT) // 10 AS cluster FROM events
)"""
GRADED_SQL = f"{SAMPLES_SQL}, graded AS (SELECT cell, par, avg(y) AS f, count(*) AS k FROM samples GROUP BY cell, par)"
CURVE_SQL = f"""{GRADED_SQL}, passing AS (
  SELECT cell, step, count(*) AS n, count(*) FILTER (f >= CAST(step AS DOUBLE) * CAST(0.05 AS DOUBLE)) AS p
  FROM graded, (SELECT unnest(range(21)) AS step) GROUP BY cell, step
), curve AS (SELECT cell, step, n, CASE WHEN p = 0 THEN CAST('inf' AS DOUBLE) ELSE log2(n / p) END AS fi FROM passing)"""
COUNTS_SQL = f"{SAMPLES_SQL}, counts AS (SELECT cell, par, cluster, count(*) AS n, min(sample) AS first FROM samples GROUP BY ALL)"
SHARES_SQL = f"{COUNTS_SQL}, shares AS (SELECT *, n / sum(n) OVER (PARTITION BY cell, par) AS p FROM counts)"
OUTPUT_SQL = f"""{SHARES_SQL}, h AS (SELECT cell, par, sum(-p * log2(p)) AS h FROM shares GROUP BY cell, par),
a AS (SELECT cell, count(DISTINCT cluster) AS a_q FROM counts GROUP BY cell)"""
LONG_SQL = """
long AS (
  SELECT vec_id, vec_id % 5 AS cell, label AS par, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    y = (F.col("value") >= 10 + 10 * (F.col("user_id") % 7)).cast("int")
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_type").alias("cell"), F.col("user_id").alias("par"), F.col("event_id").alias("sample"), y.alias("y"), F.floor(k / 10).cast("int").alias("cluster"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.graded(samples(spark, sf_dir), CELL)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facts(scored(spark, sf_dir), CELL)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster_counts(samples(spark, sf_dir), CELL)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("cell"), F.col("label").alias("par"), "vec_id", "embedding")


@query(f"WITH {GRADED_SQL} SELECT cell, par, round(f, 6) AS f, k FROM graded")
def graded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.graded(samples(spark, sf_dir), CELL))


@query(f"WITH {CURVE_SQL} SELECT cell, CAST(step AS INT) AS step, round(step * 0.05, 2)::DOUBLE AS k, CASE WHEN isinf(fi) THEN fi ELSE round(fi, 6) END AS fi FROM curve")
def information_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    fi = F.when(F.col("fi") == E.INF, F.col("fi")).otherwise(F.round("fi", 6))
    return C.curves(facts(spark, sf_dir), CELL).withColumn("fi", fi)


INPUT_SQL = f"""{CURVE_SQL}, clamped AS (SELECT cell, step, least(fi, log2(n + 1)) AS v FROM curve),
area AS (SELECT cell, sum((v + up) * 0.025) AS aufi FROM (SELECT cell, v, lead(v) OVER (PARTITION BY cell ORDER BY step) AS up FROM clamped) GROUP BY cell),
sums AS (
  SELECT cell, avg(f) AS f_mean, max(f) - min(f) AS spread, count(*) AS n, sum(k) AS t, sum(k * f) AS h, sum(k * f * f) AS q, sum(k * k) AS k2,
    count(*) FILTER (f >= 0.5 - 1e-9) AS p5, count(*) FILTER (f >= 1 - 1e-9) AS p10
  FROM graded GROUP BY cell
), squares AS (SELECT *, (q - h * h / t) / (n - 1) AS msb, (h - q) / (t - n) AS msw, (t - k2 / t) / (n - 1) AS k0 FROM sums WHERE n > 1),
input AS (
  SELECT cell, f_mean, aufi, spread, least(1, greatest(0, (msb - msw) / (msb + (k0 - 1) * msw))) AS rho_f,
    greatest(0, least(log2(n + 1), CASE WHEN p10 = 0 THEN 1e9 ELSE log2(n / p10) END) - least(log2(n + 1), CASE WHEN p5 = 0 THEN 1e9 ELSE log2(n / p5) END)) AS fi_premium,
    n AS n_paraphrases, t / n AS n_samples_per_prompt
  FROM squares JOIN area USING (cell)
)"""


@query(f"""
WITH {INPUT_SQL} SELECT cell, round(f_mean, 9) AS f_mean, round(aufi, 9) AS aufi, round(spread, 9) AS spread, round(rho_f, 9) AS rho_f, round(fi_premium, 9) AS fi_premium, n_paraphrases
FROM input
""")
def input_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.input_metrics(facts(spark, sf_dir), CELL), 9)


@query(f"WITH {OUTPUT_SQL} SELECT cell, par, round(h, 6) AS h FROM h")
def semantic_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.entropies(counts(spark, sf_dir), CELL))


@query(f"""
WITH {OUTPUT_SQL} SELECT cell, round(avg(h), 6) AS h_sem_mean, round(var_pop(h), 6) AS h_sem_var, max(a_q) AS a_q,
  round(avg(greatest(0, log2(a_q) - h)), 6) AS fi_out_mean, round(var_pop(greatest(0, log2(a_q) - h)), 6) AS fi_out_var,
  round(avg(CASE WHEN a_q <= 1 THEN 0 ELSE h / log2(a_q) END), 6) AS s_tau_mean
FROM h JOIN a USING (cell) GROUP BY cell
""")
def output_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.output_metrics(counts(spark, sf_dir), CELL))


@query(f"""
WITH {SHARES_SQL}, pars AS (SELECT DISTINCT cell, par FROM counts), pairs AS (
  SELECT p.cell, p.par AS a, q.par AS b FROM pars p JOIN pars q ON p.cell = q.cell AND p.par < q.par
), common AS (
  SELECT x.cell, x.par AS a, y.par AS b, sum(least(x.p, y.p)) AS s
  FROM shares x JOIN shares y ON x.cell = y.cell AND x.cluster = y.cluster AND x.par < y.par GROUP BY ALL
) SELECT cell, round(avg(coalesce(s, 0)), 6) AS consistency FROM pairs LEFT JOIN common USING (cell, a, b) GROUP BY cell
""")
def pairwise_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.consistency(counts(spark, sf_dir), CELL))


@query(f"""
WITH {COUNTS_SQL}, p AS (
  SELECT cell, par, {", ".join(f"coalesce(sum(n) FILTER (cluster = {c}), 0) / sum(n) AS p{c}" for c in (0, 2, 5, 9))} FROM counts GROUP BY cell, par
) SELECT cell, par, {", ".join(f"round(p{c}, 6) AS p{c}" for c in (0, 2, 5, 9))}, round((abs(p0 - 0.25) + abs(p2 - 0.25) + abs(p5 - 0.25) + abs(p9 - 0.25)) / 2, 6) AS distance FROM p
""")
def cluster_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paraphrase's shares in four clusters, and their distance to even ones."""
    rows = C.proportions(counts(spark, sf_dir), CELL, [0, 2, 5, 9])
    distance = E.total_variation(F.col("shares"), F.array(*[F.lit(0.25)] * 4))
    return rounded(rows.select("cell", "par", *(F.get("shares", F.lit(i)).alias(f"p{c}") for i, c in enumerate((0, 2, 5, 9))), distance.alias("distance")))


@query(f"""
WITH {COUNTS_SQL}, q AS (SELECT cell, cluster, sum(n) / sum(sum(n)) OVER (PARTITION BY cell) AS q FROM counts GROUP BY cell, cluster),
pars AS (SELECT cell, par, sum(n) AS total FROM counts GROUP BY cell, par),
every AS (SELECT cell, par, cluster, q, total FROM pars JOIN q USING (cell))
SELECT cell, par, round(sum(abs(coalesce(n, 0) / total - q)) / 2, 6) AS distance FROM every LEFT JOIN counts USING (cell, par, cluster) GROUP BY cell, par
""")
def pool_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each paraphrase's clusters are from those of its whole cell."""
    return rounded(C.pool_distances(counts(spark, sf_dir), CELL))


@query(f"""
WITH {COUNTS_SQL}, top AS (
  SELECT cell, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cell, par ORDER BY n DESC, first) AS r FROM counts) WHERE r = 1
) SELECT cell, round(1 - max(n) / sum(n), 6) AS variation_ratio FROM (SELECT cell, cluster, count(*) AS n FROM top GROUP BY ALL) GROUP BY cell
""")
def mode_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.variation_ratio(counts(spark, sf_dir), CELL))


@query(f"WITH {LONG_SQL} SELECT cell, round(sum(v), 6) AS ess_in FROM (SELECT cell, d, var_samp(x) AS v FROM long GROUP BY cell, d) GROUP BY cell")
def embedding_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.ess_in(vectors(spark, sf_dir), CELL))


@query(f"""
WITH {LONG_SQL}, c AS (SELECT *, avg(x) OVER (PARTITION BY cell, d) AS m, avg(x) OVER (PARTITION BY cell, par, d) AS mp FROM long),
t AS (SELECT cell, d, avg((mp - m) * (mp - m)) AS a, avg((x - mp) * (x - mp)) AS e FROM c GROUP BY cell, d)
SELECT cell, round(sum(a) + sum(e), 6) AS u_t, round(sum(a), 6) AS u_a, round(sum(e), 6) AS u_e, round(sum(e) / (sum(a) + sum(e) + 1e-12), 6) AS rho_u FROM t GROUP BY cell
""")
def embedding_variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.rho_u(vectors(spark, sf_dir), CELL))


MATRIX_SQL = """
matrix AS (SELECT event_type AS cell, user_id % 10 AS i, CAST(json_extract_string(props, '$.k') AS INT) // 10 AS j, -avg(value) AS lp FROM events GROUP BY ALL),
psi AS (
  SELECT m.cell, coalesce(avg(abs(m.lp - o.lp) / (1 + m.j % 7)) FILTER (m.i <> m.j), 0) AS posix_psi
  FROM matrix m JOIN matrix o ON o.cell = m.cell AND o.i = m.j AND o.j = m.j GROUP BY m.cell
)"""


def log_prob_matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Log-probabilities ``lp`` of answer j under prompt i: ten prompts (users by their last digit) and ten answers (clusters) of each cell, from all events."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), (F.col("user_id") % 10).alias("i"), F.floor(F.get_json_object("props", "$.k").cast("int") / 10).alias("j"), "value")
    matrix = rows.groupBy("cell", "i", "j").agg((-F.avg("value")).alias("lp"))
    return matrix, matrix.select("cell", "j", (1 + F.col("j") % 7).alias("len")).distinct()


@query(f"WITH {MATRIX_SQL} SELECT cell, round(posix_psi, 6) AS posix_psi FROM psi")
def log_prob_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, lengths = log_prob_matrix(spark, sf_dir)
    return rounded(C.posix(matrix, lengths, CELL))


@query(f"""
WITH {CURVE_SQL}, b AS (
  SELECT cell, step, p / n AS p, n, 1 + 3.8416 / n AS d FROM passing
) SELECT cell, CAST(step AS INT) AS step, round(greatest(0, (p + 1.9208 / n) / d - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / d), 6) AS low,
  round(least(1, (p + 1.9208 / n) / d + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / d), 6) AS high FROM b
""")
def pass_rate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.transform("passing", lambda p: p / F.col("n").cast("double"))
    rows = facts(spark, sf_dir).withColumn("rates", rates).select("cell", F.col("n").cast("double").alias("n"), F.posexplode("rates").alias("step", "p"))
    low, high = E.wilson(F.col("p"), F.col("n"))
    return rounded(rows.select("cell", "step", low.alias("low"), high.alias("high")))


@query("""
WITH r AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
m AS (SELECT count(*) AS n, avg((a = b)::INT) AS p_obs, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS p_exp FROM r)
SELECT n, round(p_obs, 6) AS p_obs, round(p_exp, 6) AS p_exp, round(CASE WHEN abs(1 - p_exp) < 1e-12 THEN 1 ELSE (p_obs - p_exp) / (1 - p_exp) END, 6) AS kappa FROM m
""")
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


RANKS_SQL = """
r AS (
  SELECT lang, quality, n_chars,
    rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS x,
    rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2 AS z
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL
)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {RANKS_SQL} SELECT lang, round(CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(z) > 0 THEN corr(x, z) END, 6) AS rho, count(*) AS n FROM r GROUP BY lang")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correlated(judged(spark, sf_dir), "n_chars", "quality", ["lang"], "rho"))


@query("""
WITH s AS (SELECT vec_id % 5 AS cell, vec_id AS par, label / 10 AS f, embedding::DOUBLE[] AS e FROM embeddings),
b AS (SELECT cell, par AS best_par, e AS be FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY f DESC, length(par::VARCHAR), par::VARCHAR) AS r FROM s) WHERE r = 1),
o AS (SELECT cell, f, round(list_distance(e, be), 9) AS dist FROM s JOIN b USING (cell) WHERE par <> best_par),
r AS (
  SELECT cell, rank() OVER (PARTITION BY cell ORDER BY f) + (count(*) OVER (PARTITION BY cell, f) - 1) / 2 AS x,
    rank() OVER (PARTITION BY cell ORDER BY dist) + (count(*) OVER (PARTITION BY cell, dist) - 1) / 2 AS z FROM o
) SELECT cell, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(z) > 0 AND count(*) >= 2 THEN corr(x, z) END, 4) AS rho, count(*) AS n FROM r GROUP BY cell
""")
def best_paraphrase_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    rows = v.select("cell", F.col("vec_id").alias("par"), F.col("vec_id").cast("string").alias("text"), (F.col("par") / 10).alias("f"), "embedding")
    return rounded(C.distance_correlation(rows, CELL), 4)


STEP_BOUNDS_SQL = f"""{CURVE_SQL}, bounds AS (
  SELECT cell, step, least(CASE WHEN p = 0 THEN CAST('inf' AS DOUBLE) ELSE log2(n / p) END, log2(n + 1)) AS v,
    greatest(0, (p / n + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(p / n * (1 - p / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) AS worst,
    least(1, (p / n + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(p / n * (1 - p / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) AS best, log2(n + 1) AS cap
  FROM passing
), lines AS (
  SELECT cell, step, v, least(-log2(best), cap) AS lo, least(CASE WHEN worst <= 0 THEN 1e9 ELSE -log2(worst) END, cap) AS hi FROM bounds
), jumps AS (
  SELECT *, lead(v) OVER w AS v2, lead(lo) OVER w AS lo2, lead(hi) OVER w AS hi2 FROM lines WINDOW w AS (PARTITION BY cell ORDER BY step)
), hazen AS (
  SELECT cell, count(*) FILTER ((hi < lo2 OR hi2 < lo) AND abs(v2 - v) > 0.1) AS steps, bool_and(v2 IS NULL OR v2 <= v + 1e-9) AS falling FROM jumps GROUP BY cell
)"""


def step_facts(rows: DataFrame) -> DataFrame:
    """``hazen`` of each row of :func:`operators.cells.facts`: its clamped curve with Wilson's intervals of the passing shares."""
    n = F.col("n").cast("double")
    cap = F.log2(n + F.lit(1.0))
    low = lambda p: F.least(E.bits(E.wilson(p / n, n)[1]), cap)  # noqa: E731  the larger share has fewer bits
    high = lambda p: F.least(E.bits(E.wilson(p / n, n)[0]), cap)
    value = F.transform(C.curve(), lambda x: F.least(x, cap))
    return rows.withColumn("hazen", E.hazen(value, F.transform("passing", low), F.transform("passing", high)))


@query(f"WITH {STEP_BOUNDS_SQL} SELECT cell, CAST(steps AS INT) AS steps, CAST(steps + 1 AS INT) AS plateaus, falling, steps > 0 AS fits FROM hazen")
def hazen_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each clamped curve, with Wilson's intervals."""
    return step_facts(facts(spark, sf_dir)).select("cell", "hazen.steps", "hazen.plateaus", "hazen.falling", "hazen.fits")


def by_model(sql: str) -> str:
    """SQL of the cells, split further by a model (users modulo 5), cell and model in one name."""
    return sql.replace("event_type AS cell, user_id AS par", "event_type || '/' || (user_id % 5) AS cell, user_id AS par")


def model_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("model", (F.col("par") % 5).cast("int"))
    return C.facts(C.graded(rows, ["cell", "model"]), ["cell", "model"])


@query(f"""
WITH {by_model(STEP_BOUNDS_SQL)}, m AS (SELECT CAST(string_split(cell, '/')[2] AS INT) AS model, avg(CAST(steps > 0 AS INT)) AS p, count(*)::DOUBLE AS n FROM hazen GROUP BY 1)
SELECT model, round(p, 6) AS fraction, round(greatest(0, (p + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1, (p + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM m
""")
def hazen_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each model's cells whose curve has a step, with its interval."""
    fits = step_facts(model_facts(spark, sf_dir)).groupBy("model").agg(F.avg(F.col("hazen.fits").cast("double")).alias("fraction"), F.count("*").cast("double").alias("n"))
    low, high = E.wilson(F.col("fraction"), F.col("n"))
    return rounded(fits.select("model", "fraction", low.alias("low"), high.alias("high")))


def resamples_sql(trials: str, n: int = RESAMPLES, seed: int = 42) -> str:
    """SQL of ``resamples`` (``cell, b, f, k, times``): class by class, the binomial quantile of a hashed uniform number."""
    return f"""{GRADED_SQL}, classes AS (
  SELECT cell, f, k, c, row_number() OVER (PARTITION BY cell ORDER BY f, k) - 1 AS i FROM (SELECT cell, f, {trials} AS k, count(*) AS c FROM graded GROUP BY ALL)
), shares AS (
  SELECT cell, b, CAST(-1 AS BIGINT) AS i, n AS left_n, n AS left_c, CAST(0 AS BIGINT) AS times
  FROM (SELECT cell, CAST(sum(c) AS BIGINT) AS n FROM classes GROUP BY cell), (SELECT unnest(range({n})) AS b)
  UNION ALL
  SELECT cell, b, i, left_n - t, left_c - c, t FROM (
    SELECT *, CASE WHEN c = left_c THEN left_n WHEN left_n = 0 THEN 0 ELSE least(high, low + CAST(list_reduce(
      list_prepend([0.0::DOUBLE, 0.0::DOUBLE], list_transform(range(low, high + 1), lambda j: [exp(lgamma(left_n + 1) - lgamma(j + 1) - lgamma(left_n - j + 1) + j * ln(p) + (left_n - j) * ln(1 - p)), 0.0::DOUBLE])),
      lambda x, y: [x[1] + y[1], x[2] + CASE WHEN x[1] + y[1] < u THEN 1 ELSE 0 END])[2] AS BIGINT)) END AS t
    FROM (
      SELECT *, CAST(greatest(0, floor(left_n * p - 12 * sqrt(left_n * p * (1 - p)) - 12)) AS BIGINT) AS low, CAST(least(left_n, ceil(left_n * p + 12 * sqrt(left_n * p * (1 - p)) + 12)) AS BIGINT) AS high FROM (
        SELECT s.cell, b, x.i, left_n, left_c, c, CASE WHEN c = left_c THEN 0.5::DOUBLE ELSE c::DOUBLE / left_c END AS p,
          (('0x' || substr(sha256('{seed}::' || s.cell || '::' || b || '::' || x.i), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u
        FROM shares s JOIN classes x ON s.cell = x.cell AND x.i = s.i + 1
      )
    )
  )
), resamples AS (SELECT s.cell, b, f, k, times FROM shares s JOIN classes x ON s.cell = x.cell AND s.i = x.i WHERE times > 0)"""


CI_SQL = f"""{resamples_sql("1")}, resampled_curve AS (
  SELECT cell, b, step, least(log2(sum(times) + 1), CASE WHEN coalesce(sum(times) FILTER (f >= step * CAST(0.05 AS DOUBLE)), 0) = 0 THEN 1e9 ELSE log2(sum(times) / sum(times) FILTER (f >= step * CAST(0.05 AS DOUBLE))) END) AS fi
  FROM resamples, (SELECT unnest(range(21)) AS step) GROUP BY ALL
), ci AS (SELECT cell, CAST(step AS INT) AS step, quantile_cont(fi, 0.025) AS low, quantile_cont(fi, 0.975) AS high FROM resampled_curve GROUP BY ALL)"""


@query(f"WITH RECURSIVE {CI_SQL} SELECT cell, step, round(low, 6) + 0.0::DOUBLE AS low, round(high, 6) + 0.0::DOUBLE AS high FROM ci")
def curve_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of the information curve over resampled paraphrases."""
    return rounded(B.curve_bounds(scored(spark, sf_dir), CELL, RESAMPLES))


@query(f"""
WITH RECURSIVE {resamples_sql("k")}, sums AS (
  SELECT cell, b, sum(times)::DOUBLE AS n, sum(times * k)::DOUBLE AS t, sum(times * k * f) AS h, sum(times * k * f * f) AS q, sum(times * k * k)::DOUBLE AS k2 FROM resamples GROUP BY ALL
),
squares AS (SELECT *, (q - h * h / t) / (n - 1) AS msb, (h - q) / (t - n) AS msw, (t - k2 / t) / (n - 1) AS k0 FROM sums),
rho AS (SELECT cell, CASE WHEN msb + (k0 - 1) * msw > 1e-12 THEN least(1, greatest(0, (msb - msw) / (msb + (k0 - 1) * msw))) END AS rho FROM squares)
SELECT cell, round(quantile_cont(rho, 0.025), 6) AS low, round(quantile_cont(rho, 0.975), 6) AS high, count(rho) AS defined FROM rho GROUP BY cell
""")
def intraclass_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of the intraclass correlation over resampled paraphrases."""
    return rounded(B.intraclass_bounds(scored(spark, sf_dir), CELL, RESAMPLES))


TYPES_SQL = "types AS (SELECT event_type AS cell, row_number() OVER (ORDER BY event_type) - 1 AS place FROM (SELECT DISTINCT event_type FROM events))"


def placed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the prompts' and responses' embeddings of the cells: the cell is the type whose place in order is ``vec_id % 5``."""
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("cell")).distinct()
    types = types.withColumn("place", F.row_number().over(Window.orderBy("cell")) - 1)  # a row per type
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("place"), F.col("label").alias("par"), "embedding")
    return rows.join(types, "place").drop("place")


def specificities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each cell and of its target, from how many users and clusters it has."""
    rows = samples(spark, sf_dir).groupBy("cell").agg(F.count_distinct("par").cast("int").alias("m0"), F.count_distinct("cluster").cast("int").alias("m_valid"))
    return rows.select("cell", "m0", "m_valid", F.lit(0).alias("spec_level"), (F.col("m0") % 3).alias("target_idx"))


@query(f"""
WITH {INPUT_SQL.replace("samples AS", "samples AS", 1)}, counts AS (SELECT cell, par, cluster, count(*) AS n, min(sample) AS first FROM samples GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY cell, par) AS p FROM counts), h AS (SELECT cell, par, sum(-p * log2(p)) AS h FROM shares GROUP BY cell, par),
a AS (SELECT cell, count(DISTINCT cluster) AS a_q FROM counts GROUP BY cell),
output AS (
  SELECT cell, avg(h) AS h_sem_mean, var_pop(h) AS h_sem_var, max(a_q) AS a_q, avg(greatest(0, log2(a_q) - h)) AS fi_out_mean, var_pop(greatest(0, log2(a_q) - h)) AS fi_out_var,
    avg(CASE WHEN a_q <= 1 THEN 0 ELSE h / log2(a_q) END) AS s_tau_mean FROM h JOIN a USING (cell) GROUP BY cell
), pars AS (SELECT DISTINCT cell, par FROM counts), pairs AS (SELECT p.cell, p.par AS a, q.par AS b FROM pars p JOIN pars q ON p.cell = q.cell AND p.par < q.par),
common AS (SELECT x.cell, x.par AS a, y.par AS b, sum(least(x.p, y.p)) AS s FROM shares x JOIN shares y ON x.cell = y.cell AND x.cluster = y.cluster AND x.par < y.par GROUP BY ALL),
agree AS (SELECT cell, avg(coalesce(s, 0)) AS consistency FROM pairs LEFT JOIN common USING (cell, a, b) GROUP BY cell),
top AS (SELECT cell, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cell, par ORDER BY n DESC, first) AS r FROM counts) WHERE r = 1),
vr AS (SELECT cell, 1 - max(n) / sum(n) AS variation_ratio FROM (SELECT cell, cluster, count(*) AS n FROM top GROUP BY ALL) GROUP BY cell),
{TYPES_SQL}, long AS (
  SELECT cell, label AS par, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings JOIN types ON place = vec_id % 5
), ess AS (SELECT cell, sum(v) AS ess_in FROM (SELECT cell, d, var_samp(x) AS v FROM long GROUP BY cell, d) GROUP BY cell),
c AS (SELECT *, avg(x) OVER (PARTITION BY cell, d) AS m, avg(x) OVER (PARTITION BY cell, par, d) AS mp FROM long),
tr AS (SELECT cell, d, avg((mp - m) * (mp - m)) AS a, avg((x - mp) * (x - mp)) AS e FROM c GROUP BY cell, d),
ru AS (SELECT cell, sum(e) / (sum(a) + sum(e) + 1e-12) AS rho_u FROM tr GROUP BY cell),
{MATRIX_SQL}, spec AS (SELECT cell, count(DISTINCT par)::INT AS m0, count(DISTINCT cluster)::INT AS m_valid FROM samples GROUP BY cell),
cut AS (SELECT cell, string_agg(format('{{:.4f}}', v + 0.0::DOUBLE), ',' ORDER BY step) AS curve FROM clamped GROUP BY cell)
SELECT cell, round(f_mean, 6) AS f_mean, round(aufi, 6) AS aufi, round(spread, 6) AS spread, round(rho_f, 6) AS rho_f, round(fi_premium, 6) AS fi_premium, n_paraphrases,
  round(n_samples_per_prompt, 6) AS n_samples_per_prompt, round(h_sem_mean, 6) AS h_sem_mean, round(h_sem_var, 6) AS h_sem_var, a_q, round(fi_out_mean, 6) AS fi_out_mean, round(fi_out_var, 6) AS fi_out_var,
  round(s_tau_mean, 6) AS s_tau_mean, round(consistency, 6) AS consistency, round(variation_ratio, 6) AS variation_ratio, round(ess_in, 4) AS ess_in, round(rho_u, 6) AS rho_u,
  round(posix_psi, 6) AS posix_psi, m0, m_valid, 0 AS spec_level, m0 % 3 AS target_idx, round(log2(m0 / m_valid), 6) AS fi_spec, 'none' AS encoder_label, curve
FROM input JOIN output USING (cell) JOIN agree USING (cell) JOIN vr USING (cell) JOIN ess USING (cell) JOIN ru USING (cell) JOIN psi USING (cell) JOIN spec USING (cell) JOIN cut USING (cell)
""")
def cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row of each cell; its intervals are :func:`curve_bootstrap`'s."""
    v = placed_vectors(spark, sf_dir)
    matrix, lengths = log_prob_matrix(spark, sf_dir)
    rows = C.metric_rows(samples(spark, sf_dir), CELL, prompts=v, responses=v, matrix=matrix, lengths=lengths, spec=specificities(spark, sf_dir), encoder="none")
    curve = F.array_join(F.transform("curve", lambda x: F.format_string("%.4f", x + F.lit(0.0))), ",")
    return rounded(rows.drop("ci_low", "ci_high").withColumn("curve", curve).withColumn("ess_in", F.round("ess_in", 4)))


@query(f"""
WITH s AS (SELECT vec_id % 5 AS cell, vec_id % 2 AS level, vec_id AS par, label / 10 AS f, embedding::DOUBLE[] AS e FROM embeddings),
b AS (SELECT cell, level, par AS best_par, e AS be FROM (SELECT *, row_number() OVER (PARTITION BY cell, level ORDER BY f DESC, length(par::VARCHAR), par::VARCHAR) AS r FROM s) WHERE r = 1),
o AS (SELECT cell, level, f, round(list_distance(e, be), 9) AS dist FROM s JOIN b USING (cell, level) WHERE par <> best_par),
r AS (
  SELECT cell, level, rank() OVER (PARTITION BY cell, level ORDER BY f) + (count(*) OVER (PARTITION BY cell, level, f) - 1) / 2 AS x,
    rank() OVER (PARTITION BY cell, level ORDER BY dist) + (count(*) OVER (PARTITION BY cell, level, dist) - 1) / 2 AS z FROM o
), rho AS (SELECT cell, level, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(z) > 0 AND count(*) >= 2 THEN corr(x, z) END AS rho FROM r GROUP BY cell, level)
SELECT level, round(avg(rho), 6) AS mean_rho, count(rho) AS n_cells FROM rho GROUP BY ROLLUP (level)
""")
def mean_distance_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over cells of the rank correlation of score and distance to the best paraphrase, by level and overall (null level)."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("cell"), (F.col("vec_id") % 2).alias("level"), F.col("vec_id").alias("par"), F.col("vec_id").cast("string").alias("text"), (F.col("label") / 10).alias("f"), "embedding")
    rho = C.distance_correlation(v, ["cell", "level"])
    return rounded(rho.rollup("level").agg(F.avg("rho").alias("mean_rho"), F.count("rho").alias("n_cells")))


@query("""
SELECT event_type AS cell, round(CASE WHEN count(*) = 0 THEN 0 ELSE sum(-p * log2(p)) / log2(10) END, 6) AS s_tau
FROM (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) // 10 AS c, count(*) AS n FROM events GROUP BY ALL))
GROUP BY event_type
""")
def choice_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the choices of a question with ten options, as a share of its greatest."""
    choices = samples(spark, sf_dir).groupBy("cell", "cluster").agg(F.count("*").alias("n"))
    return rounded(C.choice_entropy(choices, CELL, 10))


@query(f"WITH {MATRIX_SQL} SELECT cell, len(list(lp)) AS n_entries, round(sum(lp), 4) AS total FROM matrix GROUP BY cell HAVING count(*) = 100")
def log_prob_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-prob matrices that are whole: as many entries as prompts times answers."""
    matrix, lengths = log_prob_matrix(spark, sf_dir)
    whole = C.whole_matrices(matrix, CELL)
    return rounded(whole.groupBy("cell").agg(F.count("*").alias("n_entries"), F.sum("lp").alias("total")), 4)
