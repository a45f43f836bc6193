"""Queries of the read side: merging, pivots, paired contrasts, audits, thresholds, sampling and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..streaming.windows import tumbling
from .metrics import judged
from .registry import Registry, rounded, table

query = Registry()

LEVELS_SQL = """
levels AS (
  SELECT l_partkey AS part, l_linestatus AS level, avg(l_quantity) AS quantity, avg(l_discount) AS discount, count(*) AS n_paraphrases
  FROM lineitem GROUP BY ALL
), pairs AS (
  SELECT part, max(quantity) FILTER (level = 'F') AS qf, max(quantity) FILTER (level = 'O') AS qo, max(discount) FILTER (level = 'F') AS df,
    max(discount) FILTER (level = 'O') AS d_o, max(n_paraphrases) FILTER (level = 'F') AS nf, max(n_paraphrases) FILTER (level = 'O') AS n_o
  FROM levels GROUP BY part
)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("level")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count("*").alias("n_paraphrases")
    )


@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1
""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return R.last_wins(rows, ["user_id"], ["event_id"])


@query("""
WITH a AS (SELECT doc_id, n_chars, lang FROM documents), b AS (SELECT doc_id, quality FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN a.n_chars END AS n_chars, quality FROM a FULL JOIN b USING (doc_id)
""")
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key from two files with different columns: the later file's row replaces the earlier's as a whole."""
    return R.merged([table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")], ["doc_id"])


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE (o_custkey, o_orderstatus) NOT IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice >= 100000)")
def pending_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and states without a large order: the cells that are not done."""
    orders = table(spark, sf_dir, "orders")
    key = ["o_custkey", "o_orderstatus"]
    return R.pending(orders.select(*key).distinct(), orders.where("o_totalprice >= 100000"), key)


@query("""
SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS l_quantity_F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS l_quantity_O,
  round(avg(l_discount) FILTER (l_linestatus = 'F'), 6) AS l_discount_F, round(avg(l_discount) FILTER (l_linestatus = 'O'), 6) AS l_discount_O
FROM lineitem GROUP BY l_returnflag
""")
def level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.by_level(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], ["l_quantity", "l_discount"]))


@query(f"WITH {LEVELS_SQL} SELECT part, round(qo - qf, 6) + 0.0::DOUBLE AS d_quantity, round(d_o - df, 6) + 0.0::DOUBLE AS d_discount FROM pairs WHERE nf = n_o")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.paired_deltas(levels(spark, sf_dir), ["part"], "level", "F", "O", ["quantity", "discount"])[0])


@query(f"WITH {LEVELS_SQL} SELECT CAST(count(*) FILTER (nf IS DISTINCT FROM n_o OR nf IS NULL) AS BIGINT) AS n_excluded, count(*) AS n_pairs FROM pairs")
def paired_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paired_deltas(levels(spark, sf_dir), ["part"], "level", "F", "O", ["quantity"])[1]


@query(f"""
WITH {LEVELS_SQL}, d AS (SELECT qo - qf AS q, d_o - df AS e FROM pairs WHERE nf = n_o), l AS (SELECT 'd_quantity' AS name, q AS x FROM d UNION ALL SELECT 'd_discount', e FROM d)
SELECT name, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg((x > 0)::INT), 6) AS positive FROM l GROUP BY name
""")
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = R.paired_deltas(levels(spark, sf_dir), ["part"], "level", "F", "O", ["quantity", "discount"])[0]
    return rounded(R.described(deltas, ["d_quantity", "d_discount"]))


@query("""
WITH c AS (SELECT l_returnflag, median(l_quantity) AS q, median(l_extendedprice) AS p, median(l_discount) AS d FROM lineitem GROUP BY ALL)
SELECT l_returnflag, CAST(l_quantity > q AS INT) AS l_quantity_high, CAST(l_extendedprice > p AS INT) AS l_extendedprice_high, CAST(l_discount > d AS INT) AS l_discount_high,
  count(*) AS n, min(l_orderkey) AS example FROM lineitem JOIN c USING (l_returnflag) GROUP BY ALL
""")
def median_octants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.octants(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"], 8, "l_orderkey")


@query("""
WITH l AS (SELECT 'value' AS name, value::DOUBLE AS x FROM events UNION ALL SELECT 'user_id', user_id::DOUBLE FROM events)
SELECT name, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS n_null, CAST(count(*) FILTER (isnan(x)) AS BIGINT) AS n_nan, CAST(count(*) FILTER (isinf(x)) AS BIGINT) AS n_inf, count(*) AS n FROM l GROUP BY name
""")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plausibility(table(spark, sf_dir, "events"), ["value", "user_id"], F.lit(True))


@query("""
SELECT event_type, event_id, value, CAST(r AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) - 1 AS r FROM events
) WHERE r < 5
""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return R.first_per(rows, ["event_type"], [F.desc("value"), F.asc("event_id")], 5, "place")


@query("""
WITH c AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY ALL),
q AS (SELECT c_mktsegment, 100 // count(*) OVER () + CAST(row_number() OVER (ORDER BY size DESC, c_mktsegment) <= 100 % count(*) OVER () AS INT) AS quota FROM c),
r AS (SELECT c_custkey, c_mktsegment, sha256('42::' || c_custkey) AS h, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42::' || c_custkey), c_custkey) AS r FROM customer)
SELECT c_custkey, c_mktsegment FROM r JOIN q USING (c_mktsegment) ORDER BY CASE WHEN r <= quota THEN 0 ELSE 1 END, h, c_custkey LIMIT 100
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 100 customers by equal shares of the segments."""
    return R.stratified(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 100, 42)


@query("""
SELECT event_type, threshold, count(*) FILTER (value >= threshold) AS n FROM events, (SELECT unnest([10.0, 25.0, 50.0]::DOUBLE[]) AS threshold) GROUP BY ALL
""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.threshold_counts(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), [10.0, 25.0, 50.0])


@query("""
WITH n AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT DISTINCT o_custkey FROM n WHERE n < 2)
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM s)
""")
def repaired_universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.repair_plan(orders, orders, 2, "o_custkey", "o_orderstatus")[0]


@query("""
SELECT conv_id, turn, role FROM (
  SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations
) WHERE t <= 600 OR r = 1
""")
def capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evidence_prefix(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 600).select("conv_id", "turn", "role")


AUROC_RANKS = "rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2"


@query(f"""
WITH r AS (SELECT lang, quality AS y, {AUROC_RANKS} AS r FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
m AS (SELECT lang, count(*) AS n, count(*) FILTER (y = 1) AS p, sum(r) FILTER (y = 1) AS s FROM r GROUP BY lang)
SELECT lang, round(CASE WHEN p * (n - p) > 0 THEN (s - p * (p + 1) / 2) / (p * (n - p)) END, 6) AS auroc, n FROM m
""")
def length_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.auroc(judged(spark, sf_dir), "quality", "n_chars", ["lang"]))


@query("""
WITH v AS (SELECT event_type, value AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
c AS (
  SELECT event_type, v, lead(v) OVER w AS up, sum(n) OVER w AS n1, sum(n * v) OVER w AS s1, sum(n * v * v) OVER w AS q1,
    sum(n) OVER z AS nt, sum(n * v) OVER z AS st, sum(n * v * v) OVER z AS qt
  FROM v WINDOW w AS (PARTITION BY event_type ORDER BY v), z AS (PARTITION BY event_type)
), k AS (
  SELECT event_type, (v + up) / 2 AS mid, round(q1 - s1 * s1 / n1 + (qt - q1) - (st - s1) * (st - s1) / (nt - n1), 6) AS cost FROM c WHERE up IS NOT NULL
) SELECT event_type, round(mid, 6) AS gamma FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY cost, mid) AS r FROM k) WHERE r = 1
""")
def variance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.otsu(table(spark, sf_dir, "events"), "value", ["event_type"]))


@query("SELECT c_nationkey, CAST((row_number() OVER (ORDER BY sha256('42::' || c_nationkey), c_nationkey) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT c_nationkey FROM customer)")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations dealt to folds."""
    return R.group_folds(table(spark, sf_dir, "customer"), "c_nationkey", 5, 42)


@query("""
SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS opened_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals: the batch form of the stream's aggregation. Time zones are left out: stamps count as UTC."""
    events = table(spark, sf_dir, "events").where("ts is not null")
    day = F.date_trunc("DAY", "ts")
    opened = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', opened)")
    return rounded(tumbling(events, day, ["event_type"], "value").select("event_type", opened.alias("opened_us"), "n", "total"), 4)
