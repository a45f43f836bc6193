"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, infill, lexical_search, mixing, order_minhash, quality_knn, quality_rules, repeats, sharding, warc
from .shared import union
from .token_ids import round_trip
from .tokens import count_tokens


OP1_SQL = """
SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
OP2_SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest, url,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m
"""
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
WORDED = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"
#: Runs of ``k`` words of each row ``r``: rows of one id are never joined.
RUNS = """
  SELECT {cols}, k, s FROM (
    SELECT {cols}, unnest([1, 2, 3, 4, 5]) AS k, unnest([x, x || ' ' || x2, x || ' ' || x2 || ' ' || x3,
      x || ' ' || x2 || ' ' || x3 || ' ' || x4, x || ' ' || x2 || ' ' || x3 || ' ' || x4 || ' ' || x5]) AS s
    FROM (
      SELECT {cols}, x, lead(x) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4, lead(x, 4) OVER o AS x5
      FROM (SELECT {cols}, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM {rows}) WINDOW o AS (PARTITION BY r ORDER BY p)
    )
  ) WHERE s IS NOT NULL
"""
OP5_SQL = rf"""
WITH i AS (SELECT row_number() OVER () AS r, item_id, {WORDED} AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDED} AS w FROM documents),
s AS (
  SELECT DISTINCT g.item_id, g.s FROM ({RUNS.format(cols="r, item_id", rows="i")}) g
  JOIN (SELECT r, least(len(w), 5) AS k FROM i) n ON g.r = n.r AND g.k = n.k
), h AS (SELECT DISTINCT r, doc_id, s FROM ({RUNS.format(cols="r, doc_id", rows="d")}) WHERE s IN (SELECT s FROM s)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
m AS (SELECT r, doc_id, s.item_id, count(*) AS n_shared FROM s JOIN h USING (s) GROUP BY r, doc_id, s.item_id)
SELECT doc_id, m.item_id, n_item, max(n_shared) AS n_shared, max(n_shared) / CAST(n_item AS DOUBLE) AS containment
FROM m JOIN n ON m.item_id IS NOT DISTINCT FROM n.item_id WHERE n_shared >= 0.8 * n_item GROUP BY doc_id, m.item_id, n_item
"""
OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM (
    SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g
    FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) WINDOW o AS (PARTITION BY r ORDER BY i)
  ) WHERE g IS NOT NULL
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9A-Za-z]|[^\x00-\x7F]'))) AS n_bare_words
  FROM d LEFT JOIN covered USING (r)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)
    + (CASE WHEN 5 * n_bare_words > n_words THEN 64 ELSE 0 END) AS failed
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM f
"""

ABLATION_SQL = f"""
WITH ledger AS ({OP3_SQL}), policies AS (
  SELECT unnest(['base', 'text', 'text']) AS policy, unnest([1, 1, 2]) AS version, unnest([3, 127, 31]) AS bits
), rules AS (
  SELECT unnest(['few_words', 'repeated_words', 'symbols', 'word_length', 'duplicate_lines', 'capitals', 'bare_words']) AS rule, unnest([1, 2, 4, 8, 16, 32, 64]) AS b
)
SELECT policy, version, rule, count(*) FILTER (failed & b <> 0) AS n_failed, count(*) FILTER (failed & bits = b) AS n_only,
  count(*) FILTER ((failed & bits & ~b) = 0) AS n_kept_without
FROM ledger, policies, rules WHERE bits & b <> 0 GROUP BY policy, version, rule
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
TERMED = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMED} AS w FROM documents),
c AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
i AS (SELECT DISTINCT item_id, unnest({TERMED}) AS t FROM benchmark),
p AS (
  SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t
), v AS (
  SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY t, n_docs
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(len(w) AS BIGINT) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN p USING (t) JOIN v USING (t) JOIN d USING (r), c GROUP BY item_id, r, doc_id
), k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
OP13_SQL = """
WITH d AS (
  SELECT coalesce(text, '') AS t, doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.round_trip(table(spark, sf_dir, "documents"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base, verdict = (quality_rules.applied(F.col("failed"), name, 1) for name in ("base", "text"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *measures, (~base).alias("base_failed"), (base & verdict).alias("kept"), "failed")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy and version removes, from the stored ledger."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    every = [(p, v) for p, versions in quality_rules.POLICIES.items() for v in versions]
    parts = [quality_rules.ablations(rows, p, v).select(F.lit(p).alias("policy"), F.lit(v).alias("version"), "*") for p, v in every]
    return union(parts)


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), smallest=False, folded=True)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.transformed(table(spark, sf_dir, "documents"))
    made, back = F.col("output"), infill.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(made, 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_warc_archives, op3_quality_rules, op4_repeated_strings, op5_decontamination, op6_token_ids, op7_quality_classifier, op8_near_duplicates, op9_token_counts, op10_mixture, op11_exact_duplicates, op12_lexical_search, op13_fill_in_middle, quality_rule_ablations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op2_warc_archives": OP2_SQL, "op3_quality_rules": OP3_SQL, "op5_decontamination": OP5_SQL, "op11_exact_duplicates": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_fill_in_middle": OP13_SQL, "quality_rule_ablations": ABLATION_SQL}
