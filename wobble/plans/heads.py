"""Queries of probe heads: mass-mean and ridge scores out of fold, calibration error, control tasks, label joins and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import heads as H
from ..operators import probes as P
from ..operators.relational import auroc
from .registry import Registry, rounded, table

query = Registry()

FOLDS_SQL = "folds AS (SELECT g, CAST((row_number() OVER (ORDER BY sha256('42::' || g), g) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT vec_id // 7 AS g FROM embeddings))"
PROBE_SQL = f"""
{FOLDS_SQL}, rows AS (
  SELECT vec_id, vec_id // 7 AS g, fold, CAST(label >= 5 AS INT) AS y, embedding::DOUBLE[] AS e FROM embeddings JOIN folds ON g = vec_id // 7
), long AS (SELECT vec_id, fold, y, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM rows),
own AS (SELECT fold, d, count(*) AS n, sum(v) AS s, sum(v * v) AS q, sum(y) AS n1, sum(v * y) AS s1 FROM long GROUP BY ALL),
rest AS (SELECT fold, d, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s, sum(q) OVER w - q AS q, sum(n1) OVER w - n1 AS n1, sum(s1) OVER w - s1 AS s1 FROM own WINDOW w AS (PARTITION BY d)),
head AS (SELECT fold, d, s / n AS mean, sqrt(greatest(q / n - (s / n) * (s / n), 0)) + 1e-8 AS sd, s1 / n1 - (s - s1) / (n - n1) AS w FROM rest),
scores AS (SELECT vec_id, l.fold, y, sum((v - mean) / sd * w / sd) AS score FROM long l JOIN head h ON h.fold = l.fold AND h.d = l.d GROUP BY ALL)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as features, their label's half as the class, blocks of seven as questions."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 7).alias("g"), (F.col("label") >= 5).cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return H.folded(rows, "g", 5, 42)


@query(f"WITH {PROBE_SQL} SELECT vec_id, y, round(score, 4) AS score FROM scores")
def mass_mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.mass_mean(probes(spark, sf_dir), ["vec_id"]), 4)


@query(f"""
WITH {PROBE_SQL}, r AS (SELECT y, rank() OVER (ORDER BY round(score, 6)) + (count(*) OVER (PARTITION BY round(score, 6)) - 1) / 2 AS r FROM scores)
SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc, count(*) AS n FROM r
""")
def mass_mean_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = H.mass_mean(probes(spark, sf_dir), ["vec_id"]).withColumn("score", F.round("score", 6))
    return rounded(auroc(scored, "y", "score", []))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with quantity and discount as features, the price as the label, suppliers as questions, in five folds."""
    x = F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("g"), x.alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    return H.folded(rows, "g", 5, 42)


RIDGE_FOLDS = "folds AS (SELECT g, CAST((row_number() OVER (ORDER BY sha256('42::' || g), g) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT l_suppkey AS g FROM lineitem))"


@query(f"""
WITH {RIDGE_FOLDS}, rows AS (SELECT fold, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem JOIN folds ON g = l_suppkey),
train AS (SELECT f.fold AS test, r.* FROM rows r JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> r.fold),
m AS (SELECT test, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) + 1e-8 AS sa, stddev_pop(b) + 1e-8 AS sb, avg(y) AS my FROM train GROUP BY test),
g AS (
  SELECT test, sum(((a - ma) / sa) ** 2) + 100 AS aa, sum(((b - mb) / sb) ** 2) + 100 AS bb, sum((a - ma) / sa * (b - mb) / sb) AS ab, sum((a - ma) / sa * (y - my)) AS ay, sum((b - mb) / sb * (y - my)) AS by_
  FROM train JOIN m USING (test) GROUP BY test
)
SELECT test AS fold, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 4) AS w_quantity, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 4) AS w_discount, round(my, 4) AS intercept FROM g JOIN m USING (test)
""")
def ridge_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridge head of each of five folds over two standardised features."""
    held = F.array(F.struct(F.lit(0).alias("outer"), F.col("fold").alias("inner")))
    heads = P.ridge_heads(P.moments(priced(spark, sf_dir).withColumn("cells", held)), (100.0,)).where("inner >= 0")
    w = F.col("w")
    return rounded(heads.select(F.col("inner").alias("fold"), w[0].alias("w_quantity"), w[1].alias("w_discount"), F.col("b").alias("intercept")), 4)


NESTED_SQL = f"""
{RIDGE_FOLDS}, base AS (SELECT l_orderkey, l_linenumber, fold, g, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem JOIN folds ON g = l_suppkey),
inner_folds AS (
  SELECT o AS outer_, g, CAST((row_number() OVER (PARTITION BY o ORDER BY sha256('43::' || g), g) - 1) % 3 AS INT) AS inner_
  FROM folds, (SELECT DISTINCT fold AS o FROM folds) WHERE fold <> o
), cells AS (SELECT r.*, outer_, inner_ FROM base r JOIN inner_folds USING (g)),
train AS (
  SELECT c.outer_, i AS inner_, a, b, y FROM cells c, (SELECT unnest([0, 1, 2]) AS i) WHERE c.inner_ <> i
  UNION ALL SELECT outer_, -1, a, b, y FROM cells
), m AS (SELECT outer_, inner_, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) + 1e-8 AS sa, stddev_pop(b) + 1e-8 AS sb, avg(y) AS my FROM train GROUP BY ALL),
g AS (
  SELECT outer_, inner_, s, sum(((a - ma) / sa) ** 2) + s AS aa, sum(((b - mb) / sb) ** 2) + s AS bb, sum((a - ma) / sa * (b - mb) / sb) AS ab, sum((a - ma) / sa * (y - my)) AS ay, sum((b - mb) / sb * (y - my)) AS by_
  FROM train JOIN m USING (outer_, inner_), (SELECT unnest([{", ".join(map(repr, H.RIDGES))}])::DOUBLE AS s) GROUP BY outer_, inner_, s
), heads AS (
  SELECT outer_, inner_, s, ma, mb, sa, sb, my, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM g JOIN m USING (outer_, inner_)
)"""
NESTED_PICKS_SQL = f"""
{NESTED_SQL}, tried AS (SELECT c.outer_, c.inner_, s, y, round((a - ma) / sa * wa + (b - mb) / sb * wb + my, 9) AS score FROM cells c JOIN heads h ON c.outer_ = h.outer_ AND c.inner_ = h.inner_),
ranks AS (
  SELECT outer_, inner_, s, rank() OVER (PARTITION BY outer_, inner_, s ORDER BY y) + (count(*) OVER (PARTITION BY outer_, inner_, s, y) - 1) / 2 AS p,
    rank() OVER (PARTITION BY outer_, inner_, s ORDER BY score) + (count(*) OVER (PARTITION BY outer_, inner_, s, score) - 1) / 2 AS q FROM tried
), rho AS (SELECT outer_, inner_, s, corr(p, q) AS rho FROM ranks GROUP BY ALL),
worth AS (SELECT outer_, s, avg(rho) AS worth FROM rho GROUP BY ALL)"""


@query(f"""
WITH {NESTED_SQL} SELECT outer_ AS fold, inner_ AS held_out, s AS strength, round(wa, 4) AS w_quantity, round(wb, 4) AS w_discount, round(my, 4) AS intercept FROM heads
""")
def ridge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of all outer and inner folds and all strengths, from one scan."""
    rows = P.nested_cells(priced(spark, sf_dir), "g", 3, 43)
    heads, w = P.ridge_heads(P.moments(rows), H.RIDGES), F.col("w")
    return rounded(heads.select(F.col("outer").alias("fold"), F.col("inner").alias("held_out"), "strength", w[0].alias("w_quantity"), w[1].alias("w_discount"), F.col("b").alias("intercept")), 4)


@query(f"WITH {NESTED_PICKS_SQL} SELECT outer_ AS fold, round(max(worth), 4) AS worth FROM worth GROUP BY outer_")
def nested_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean rank correlation in the inner folds of each outer fold's best strength."""
    _, picked = P.nested(priced(spark, sf_dir), ["l_orderkey", "l_linenumber"], "g", False, H.RIDGES)
    return rounded(picked.select(F.col("outer").alias("fold"), "worth"), 4)


@query()
def nested_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's score by the logistic head of its fold, with the penalty that the inner folds chose."""
    scores, _ = P.nested(probes(spark, sf_dir), ["vec_id"], "g", True, H.PENALTIES)
    return rounded(scores.select("vec_id", "y", F.col("outer").alias("fold"), "strength", "score"), 4)


@query("""
WITH r AS (SELECT lang, quality AS y, least(1, n_chars / 2000) AS v FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
b AS (SELECT lang, CAST(floor(v * 10) AS INT) AS bin, count(*) AS n, avg(v) AS v, avg(y) AS y FROM r GROUP BY ALL)
SELECT lang, round(sum(CASE WHEN bin < 10 THEN abs(v - y) * n ELSE 0 END) / sum(n), 6) AS ece FROM b GROUP BY lang
""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's length as its predicted quality: the gap between both over ten bins."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null and n_chars is not null")
    return rounded(H.calibration_error(rows.withColumn("v", F.least(F.lit(1.0), F.col("n_chars") / 2000)), "v", "quality", ["lang"]))


TURNS_SQL = "t AS (SELECT conv_id, turn, CAST(length(coalesce(text, '')) % 2 AS INT) AS y FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 2).cast("int").alias("y"))


@query(f"""
WITH {TURNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS size FROM t),
g AS (SELECT conv_id, max(size) AS size FROM n GROUP BY conv_id),
a AS (SELECT conv_id AS dst, row_number() OVER (ORDER BY sha256('7::' || conv_id), conv_id) AS p FROM g),
b AS (SELECT conv_id AS src, size AS donor_size, row_number() OVER (ORDER BY sha256('8::' || conv_id), conv_id) AS p FROM g)
SELECT n.conv_id, n.turn, n.y, d.y AS permuted FROM n JOIN a ON dst = n.conv_id JOIN b USING (p) JOIN n d ON d.conv_id = src AND d.i = n.i % donor_size
""")
def permuted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with the label pattern of another."""
    return H.permuted_labels(turns(spark, sf_dir), "conv_id", ["turn"], "y", 7)


@query(f"""
WITH {TURNS_SQL}, f AS (SELECT conv_id, (row_number() OVER (ORDER BY sha256('7::' || conv_id), conv_id) - 1) % 2 = 1 AS flip FROM (SELECT DISTINCT conv_id FROM t))
SELECT conv_id, turn, y, CASE WHEN flip THEN 1 - y ELSE y END AS flipped FROM t JOIN f USING (conv_id)
""")
def flipped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.flipped_labels(turns(spark, sf_dir), "conv_id", "y", 7)


CELLS_SQL = """
cells AS (SELECT conv_id AS question_id, count(*) AS n, avg(length(coalesce(text, ''))) / 1000 AS h, list((length(coalesce(text, '')) % 11) / 10 ORDER BY turn) AS f FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id),
prompts AS (SELECT conv_id AS question_id, CAST(turn % 2 AS INT) AS spec_level, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS paraphrase_idx FROM conversations)"""


@query(f"""
WITH {CELLS_SQL} SELECT p.question_id, p.spec_level, paraphrase_idx, CAST(p.spec_level = 0 AS DOUBLE) AS vagueness, round(f[paraphrase_idx + 1], 6) AS reliability, round(h, 6) AS dispersion, round(h / n, 6) AS fragility
FROM prompts p LEFT JOIN cells c USING (question_id)
""")
def head_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompts with the labels of their conversation's cell; every third conversation has no cell."""
    return rounded(H.head_labels(*prompts_and_cells(spark, sf_dir), ["question_id"]))


def prompts_and_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations")
    size = F.length(F.coalesce("text", F.lit("")))
    graded = F.transform(F.array_sort(F.collect_list(F.struct("turn", (size % 11 / 10).alias("f")))), lambda p: p["f"])
    cells = rows.where("conv_id % 3 <> 0").groupBy(F.col("conv_id").alias("question_id")).agg(F.count("*").alias("n"), (F.avg(size) / 1000).alias("h_sem_mean"), graded.alias("f_graded_per_paraphrase"))
    cells = cells.withColumn("rho_f", F.col("h_sem_mean") / F.col("n"))
    index = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    prompts = rows.select(F.col("conv_id").alias("question_id"), (F.col("turn") % 2).cast("int").alias("spec_level"), index.cast("int").alias("paraphrase_idx"))
    return prompts, cells


@query(f"""
WITH {CELLS_SQL} SELECT p.question_id, paraphrase_idx, round(f[paraphrase_idx + 1], 6) AS graded, round(h, 6) AS entropy FROM prompts p LEFT JOIN cells c USING (question_id)
""")
def joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with one label each way: an array's entry by place, and a cell's number on all its prompts."""
    prompts, cells = prompts_and_cells(spark, sf_dir)
    graded = H.joined_label(prompts.drop("spec_level"), cells, ["question_id"], "f_graded_per_paraphrase")
    both = H.joined_label(graded, cells, ["question_id"], "h_sem_mean")
    return rounded(both.select("question_id", "paraphrase_idx", F.col("f_graded_per_paraphrase").alias("graded"), F.col("h_sem_mean").alias("entropy")))


@query(f"""
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) / 100 AS v, value / 100 AS r, (event_id % 10) / 10 AS d, (event_id % 7) / 7 AS f FROM events),
m AS (SELECT event_id,
  CASE WHEN v >= 0.65 THEN '{H.MESSAGES["vagueness"]}' WHEN v >= 0.45 THEN '{H.MESSAGES["possibly_vague"]}' END AS a,
  CASE WHEN r IS NOT NULL THEN 'Predicted answer reliability: ' || CASE WHEN r < 0.35 THEN 'LOW' WHEN r < 0.65 THEN 'MEDIUM' ELSE 'HIGH' END END AS b,
  CASE WHEN d >= 0.6 THEN '{H.MESSAGES["dispersion"]}' END AS c, CASE WHEN f >= 0.6 THEN '{H.MESSAGES["fragility"]}' END AS g, r FROM e)
SELECT event_id, concat_ws(' / ', a, b, c, g, CASE WHEN a IS NULL AND c IS NULL AND g IS NULL AND r >= 0.65 THEN '{H.MESSAGES["stable"]}' END) AS said FROM m
""")
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gauges say of each event's numbers, without the percentage."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    said = H.feedback(k / 100, F.col("value") / 100, e % 10 / 10, e % 7 / 7)
    plain = F.transform(said, lambda m: F.regexp_replace(m, r" \(≈-?[0-9]+%\)\.$", ""))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(plain, " / ").alias("said"))


CHECKED_SQL = """
r AS (
  SELECT doc_id % 3 AS model, unnest(['quality', 'toxic']) AS head, unnest([quality, toxic]) AS y, n_chars AS length,
    round(len(regexp_extract_all(text, '[a-z]')) / (length(text) + 1), 9) AS score FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND n_chars IS NOT NULL
), k AS (SELECT * FROM r WHERE y IS NOT NULL), p AS (
  SELECT model, head, y, rank() OVER (PARTITION BY model, head ORDER BY score) + (count(*) OVER (PARTITION BY model, head, score) - 1) / 2 AS a,
    rank() OVER (PARTITION BY model, head ORDER BY length) + (count(*) OVER (PARTITION BY model, head, length) - 1) / 2 AS b FROM k
), u AS (
  SELECT model, head, count(*) AS n, (sum(a) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auroc,
    (sum(b) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS l FROM p GROUP BY ALL HAVING sum(y) > 0 AND sum(y) < count(*)
)"""


@query(f"""
WITH {CHECKED_SQL} SELECT head, round(avg(auroc), 6) AS mean, round(min(auroc), 6) AS low, round(max(auroc), 6) AS high, round(avg(greatest(l, 1 - l)), 6) AS baseline,
  round(avg(auroc) - avg(greatest(l, 1 - l)), 6) AS margin FROM u GROUP BY head
""")
def verified_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of small letters as a score of two labels of a document, for three models, against the document's length alone."""
    share = F.round(F.regexp_count("text", F.lit("[a-z]")) / (F.char_length("text") + 1), 9)
    rows = table(spark, sf_dir, "documents").where("text is not null and n_chars is not null").join(table(spark, sf_dir, "labels"), "doc_id")
    heads = F.inline(F.array(*(F.struct(F.lit(h).alias("head"), F.col(h).alias("y")) for h in ("quality", "toxic"))))
    long = rows.select((F.col("doc_id") % 3).alias("model"), F.col("n_chars").alias("length"), share.alias("score"), heads)
    return rounded(H.margins(H.verified(long, ["model", "head"], "y", "score", "length").where("auroc is not null"), "head"))


@query(f"""
WITH {CELLS_SQL}, l AS (
  SELECT p.question_id || '/' || paraphrase_idx AS prompt, p.spec_level, CAST(p.spec_level = 0 AS DOUBLE) AS v, f[paraphrase_idx + 1]::DOUBLE AS r, h::DOUBLE AS d, (h / n)::DOUBLE AS g FROM prompts p LEFT JOIN cells c USING (question_id)
), s AS (SELECT *, row_number() OVER (PARTITION BY spec_level ORDER BY sha256('5::' || prompt), prompt) AS place FROM l WHERE r IS NOT NULL),
m AS (SELECT prompt, spec_level, CASE WHEN v >= 0.65 THEN '{H.MESSAGES["vagueness"]}' WHEN v >= 0.45 THEN '{H.MESSAGES["possibly_vague"]}' END AS a,
  'Predicted answer reliability: ' || CASE WHEN r < 0.35 THEN 'LOW' WHEN r < 0.65 THEN 'MEDIUM' ELSE 'HIGH' END AS b, CASE WHEN d >= 0.6 THEN '{H.MESSAGES["dispersion"]}' END AS c,
  CASE WHEN g >= 0.6 THEN '{H.MESSAGES["fragility"]}' END AS e, r FROM s WHERE place <= 20)
SELECT prompt, spec_level, concat_ws(' / ', a, b, c, e, CASE WHEN a IS NULL AND c IS NULL AND e IS NULL AND r >= 0.65 THEN '{H.MESSAGES["stable"]}' END) AS said FROM m
""")
def replayed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty prompts of each level with a known reliability, and what is said of their labels as gauges, without the percentage."""
    rows = H.head_labels(*prompts_and_cells(spark, sf_dir), ["question_id"])
    rows = rows.withColumn("prompt", F.concat_ws("/", F.col("question_id").cast("string"), F.col("paraphrase_idx").cast("string")))
    said = F.transform("said", lambda m: F.regexp_replace(m, r" \(≈-?[0-9]+%\)\.$", ""))
    return H.replayed(rows, "spec_level", "prompt", "reliability", 20, 5).select("prompt", "spec_level", F.array_join(said, " / ").alias("said"))
