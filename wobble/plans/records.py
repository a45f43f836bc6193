"""Queries of text cleaning, similarity, scoring, ladders and levels of specificity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import text as X
from ..operators import clustering, ladders, scoring
from ..operators.neighbours import near_pairs, spread_out
from ..sources.providers import overlap
from .registry import Registry, rounded, table

query = Registry()

#: Unicode's white space, which ``(?U)\s`` means in Java, for SQL engines whose ``\s`` is ASCII.
WHITE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TURNS_SQL = """turns AS (
  SELECT conv_id, turn, text AS hypothesis, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS premise FROM conversations
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("hypothesis"), before.alias("premise"))


@query(rf"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '{WHITE}+', ' ', 'g'))) AS text_sha256 FROM pages")
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.without_tags(F.col("html")), 256).alias("text_sha256"))


@query(rf"SELECT doc_id, CAST(len(list_filter(string_split_regex(trim(lower(text)), '{WHITE}+'), lambda w: w <> '')) AS INT) AS n_tokens FROM documents WHERE text IS NOT NULL")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"))


@query(r"""SELECT conv_id, turn, trim(trim(string_split(trim(text), chr(10))[1])) AS line FROM conversations""")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.one_line(F.col("text")).alias("line"))


@query("SELECT conv_id, turn, 'Question: ' || trim(text) || chr(10) || chr(10) || 'Answer:' AS content FROM conversations")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<struct<title: string, sentences: array<string>>>")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.qa_messages(F.col("text"), none)[1]["content"].alias("content"))


@query("""
SELECT a.page_id, CAST(levenshtein(a.url, b.url) AS INT) AS distance FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.url IS NOT NULL AND b.url IS NOT NULL
""")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address against that of the page with the next id."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    after = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    pairs = rows.join(after, "page_id").where("url is not null and other is not null")
    return pairs.select("page_id", F.levenshtein("url", "other").alias("distance"))


@query("""
WITH u AS (SELECT DISTINCT url, length(url) AS n, md5(url) AS k FROM pages WHERE url IS NOT NULL)
SELECT a.url AS a, b.url AS b, CAST(levenshtein(a.url, b.url) AS INT) AS distance FROM u a JOIN u b ON a.n < b.n OR (a.n = b.n AND a.k < b.k)
WHERE b.n - a.n <= 5 AND levenshtein(a.url, b.url) <= 5
""")
def near_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of page addresses that are five edits apart or fewer."""
    return near_pairs(table(spark, sf_dir, "pages"), [], "url", 5)


KEPT_SQL = """
k AS (
  SELECT {g}, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS kept FROM (SELECT DISTINCT {g} FROM u)
  UNION ALL
  SELECT {k}, u.pos, CASE WHEN len(list_filter(k.kept, lambda x: CASE WHEN abs(length(x) - length(u.t)) <= {edits} THEN levenshtein(x, u.t) <= {edits} ELSE false END)) > 0 THEN k.kept ELSE list_append(k.kept, u.t) END
  FROM k JOIN u ON {same} AND u.pos = k.pos + 1
)"""


@query(f"""
WITH RECURSIVE u AS (SELECT 0 AS g, url AS t, row_number() OVER (ORDER BY min(page_id), url) AS pos FROM pages WHERE trim(url) <> '' GROUP BY url),
{KEPT_SQL.format(g="g", k="k.g", same="u.g = k.g", edits=4)}
SELECT u.t AS url, list_contains(f.kept, u.t) AS kept FROM u JOIN (SELECT g, arg_max(kept, pos) AS kept FROM k GROUP BY g) f USING (g)
""")
def distant_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all page addresses, in order of their pages, those that are five edits or more from every one kept before."""
    return spread_out(table(spark, sf_dir, "pages"), [], "url", ["page_id"], 4, steps=4).select(F.col("text").alias("url"), "kept")


@query(f"""
WITH RECURSIVE u AS (
  SELECT coalesce(lang, '-') AS g, coalesce(source, '-') AS h, text AS t, row_number() OVER (PARTITION BY lang, source ORDER BY min(doc_id), text) AS pos FROM documents WHERE trim(text) <> '' GROUP BY lang, source, text
), {KEPT_SQL.format(g="g, h", k="k.g, k.h", same="u.g = k.g AND u.h = k.h", edits=4)},
f AS (SELECT g, h, arg_max(kept, pos) AS kept FROM k GROUP BY g, h)
SELECT g AS lang, h AS source, md5(u.t) AS digest, list_contains(f.kept, u.t) AS kept FROM u JOIN f USING (g, h)
""")
def distant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language and source, in order of their ids, the documents that are five edits or more from every one kept before."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("lang", "source")))
    return spread_out(rows, ["lang", "source"], "text", ["doc_id"], 4).select("lang", "source", F.md5("text").alias("digest"), "kept")


@query()
def token_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("premise is not null").select("conv_id", "turn", X.token_distance(F.col("premise"), F.col("hypothesis")).alias("distance"))


@query("""
WITH RECURSIVE u AS (SELECT page_id // 8 AS g, row_number() OVER (PARTITION BY page_id // 8 ORDER BY page_id) AS pos, url FROM pages WHERE url IS NOT NULL),
k AS (
  SELECT g, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS kept FROM (SELECT DISTINCT g FROM u)
  UNION ALL
  SELECT k.g, u.pos, CASE WHEN trim(u.url) = '' OR len(list_filter(k.kept, lambda x: levenshtein(x, u.url) < 16)) > 0 THEN k.kept ELSE list_append(k.kept, u.url) END
  FROM k JOIN u ON u.g = k.g AND u.pos = k.pos + 1
) SELECT g, unnest(kept) AS url FROM (SELECT g, arg_max(kept, pos) AS kept FROM k GROUP BY g)
""")
def greedy_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of eight candidates, as a paraphrase round has few; each keeps what is far from all kept before."""
    pages = table(spark, sf_dir, "pages").where("url is not null").groupBy(F.floor(F.col("page_id") / 8).alias("g"))
    lists = pages.agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda p: p["url"]).alias("urls"))
    return lists.select("g", F.explode(E.greedy_distinct(F.col("urls"), 16)).alias("url"))


@query(rf"""
WITH {TURNS_SQL}, w AS (
  SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(trim(lower(premise)), '{WHITE}+'), lambda w: w <> '')) AS a,
    list_distinct(list_filter(string_split_regex(trim(lower(hypothesis)), '{WHITE}+'), lambda w: w <> '')) AS b FROM turns WHERE premise IS NOT NULL AND hypothesis IS NOT NULL
) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM w
""")
def word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).where("premise is not null and hypothesis is not null")
    return rounded(rows.select("conv_id", "turn", E.jaccard(X.tokens(F.col("premise")), X.tokens(F.col("hypothesis"))).alias("jaccard")))


WORDS_SQL = r"list_distinct(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: w <> ''))"


@query(rf"""
WITH {TURNS_SQL}, w AS (
  SELECT conv_id, turn, {WORDS_SQL.format("premise")} AS p, {WORDS_SQL.format("hypothesis")} AS h FROM turns WHERE hypothesis IS NOT NULL
), s AS (SELECT conv_id, turn, CASE WHEN p IS NOT NULL AND len(h) > 0 THEN len(list_intersect(h, p)) / len(h) ELSE 0 END AS e, p IS NOT NULL AS given FROM w)
SELECT conv_id, turn, CAST(given AND e >= 0.7 AND (1 - e) / 2 < 0.5 AS INT) AS f, CAST(given AND e >= 0.5 AND (1 - e) / 2 < 0.5 AS INT) AS f_lenient FROM s
""")
def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before as its gold, by the stand-in for an entailment model."""
    rows = turns(spark, sf_dir).where("hypothesis is not null")
    nli = overlap(rows.where("premise is not null").select("premise", "hypothesis").distinct())
    golds = rows.select("conv_id", "turn", F.col("hypothesis").alias("answer"), F.array_compact(F.array("premise")).alias("golds"))
    return scoring.multi_gold(golds, nli, ["conv_id", "turn"])


@query(rf"""
WITH RECURSIVE t AS (SELECT conv_id, text AS answer, min(turn) AS o FROM conversations WHERE text IS NOT NULL GROUP BY ALL), w AS (SELECT *, {WORDS_SQL.format("answer")} AS w FROM t),
links AS (
  SELECT x.conv_id, x.o AS a, y.o AS b FROM w x JOIN w y ON x.conv_id = y.conv_id AND x.o <> y.o
  WHERE len(x.w) > 0 AND len(y.w) > 0 AND len(list_intersect(x.w, y.w)) / greatest(len(x.w), len(y.w)) >= 0.3
), reach AS (SELECT conv_id, o AS a, o AS b FROM t UNION SELECT r.conv_id, r.a, l.b FROM reach r JOIN links l ON l.conv_id = r.conv_id AND l.a = r.b),
root AS (SELECT conv_id, a AS o, min(b) AS root FROM reach GROUP BY ALL)
SELECT c.conv_id, c.turn, CAST(dense_rank() OVER (PARTITION BY c.conv_id ORDER BY root) - 1 AS INT) AS cluster
FROM conversations c JOIN t ON t.conv_id = c.conv_id AND t.answer = c.text JOIN root ON root.conv_id = t.conv_id AND root.o = t.o
""")
def answer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of mutual overlap among a conversation's distinct turns; only turns that share enough words are judged."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").alias("answer"))
    pairs = clustering.candidate_pairs(rows, ["conv_id"], X.word_set(F.col("answer")), 0.3)
    nli = overlap(pairs.select("premise", "hypothesis").distinct())
    links = clustering.entailed(pairs, nli, ["conv_id"], "prob", 0.3)
    return clustering.clusters(rows, links, ["conv_id"], ["turn"]).select("conv_id", "turn", "cluster")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of ten paragraphs each: neighbouring parts, those of size 25 or more gold."""
    part = F.struct("p_partkey", F.col("p_name").alias("title"), F.array("p_type").alias("sentences"), (F.col("p_size") >= 25).alias("is_gold"))
    rows = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 10).cast("string").alias("question_id"))
    drop = lambda p: F.struct(p["title"].alias("title"), p["sentences"].alias("sentences"), p["is_gold"].alias("is_gold"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(part)), drop).alias("paragraphs"))


@query("""
WITH p AS (
  SELECT (p_partkey // 10)::VARCHAR AS question_id, p_size >= 25 AS gold, p_partkey,
    row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS i FROM part
), o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY gold DESC, i) AS r FROM p)
SELECT question_id, CAST(level AS INT) AS level, coalesce(string_agg(i::VARCHAR, ',' ORDER BY r) FILTER (r <= level), '') AS indices,
  CAST(count(*) FILTER (gold AND r <= level) AS INT) AS gold_count
FROM o, (SELECT unnest([0, 2, 4, 6, 8, 10]) AS level) GROUP BY ALL
""")
def gold_first_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs = ladders.ladder(paragraphs(spark, sf_dir), "gold_first")
    return rungs.select("question_id", "level", F.array_join(F.transform("paragraph_indices", lambda i: i.cast("string")), ",").alias("indices"), "gold_count")


@query()
def context_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs = ladders.all_ladders(paragraphs(spark, sf_dir))
    return rungs.select("question_id", "ladder_type", "level", F.array_join(F.transform("paragraph_indices", lambda i: i.cast("string")), ",").alias("indices"), "gold_count")


@query("""
WITH q AS (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS k FROM lineitem GROUP BY l_orderkey),
c AS (SELECT n, k, count(*) AS n_questions FROM q GROUP BY n, k), l AS (SELECT *, unnest(range(n + 1)) AS level FROM c),
m AS (SELECT *, list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(level), lambda i: greatest(n - k - i, 0)::DOUBLE / (n - i))), lambda x, y: x * y) AS miss FROM l)
SELECT CAST(n AS INT) AS n, CAST(k AS INT) AS k, n_questions, CAST(level AS INT) AS level,
  CASE WHEN level = 0 OR k = 0 THEN CAST('inf' AS DOUBLE) ELSE round(-log2(CASE WHEN level > n - k THEN 1 ELSE 1 - miss END) + 0.0::DOUBLE, 6) END AS b_theo,
  CASE WHEN k = 0 THEN 0 ELSE level / n END AS coverage FROM m
""")
def bit_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions, their lines as paragraphs and returned ones as gold: the bits and the coverage of each level, for each make of a question."""
    gold = F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("int").alias("k")
    questions = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), gold)
    rows = ladders.bit_table(questions.groupBy("n", "k").agg(F.count("*").alias("n_questions")))
    return rows.withColumn("b_theo", F.when(F.col("b_theo") == E.INF, F.col("b_theo")).otherwise(F.round("b_theo", 6) + F.lit(0.0)))


@query("""
WITH m AS (SELECT r_name AS id, r_regionkey AS k, count(*) AS m0 FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
t AS (SELECT *, list_reduce(list_transform(string_split(sha256(id || '::42'), ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT)), lambda a, d: (a * 16 + d) % m0) % m0 AS t FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT t.id AS question_id, CAST(l AS INT) AS spec_level, CASE WHEN l = 0 THEN 'which nation of ' || t.id ELSE 'the nation ' || n_name END AS question_text,
  CAST(CASE WHEN l = 0 THEN m0 ELSE 1 END AS INT) AS m_valid, CAST(m0 AS INT) AS m0, CAST(t AS INT) AS target_idx,
  n_nationkey % 2 = 0 AND (SELECT count(*) FROM nation m WHERE m.n_regionkey = k AND m.n_nationkey % 2 = 0) > 1 AS target_collision,
  round(CASE WHEN l = 0 THEN 0 ELSE log2(m0) END, 6) AS fi_spec
FROM t JOIN n ON n_regionkey = k AND i = t, (SELECT unnest([0, 1]) AS l)
""")
def specificity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as ambiguous questions, their nations as the readings; nations with even keys have an answer in common."""
    reading = F.struct("n_nationkey", F.concat(F.lit("the nation "), "n_name").alias("disambiguated_question"), F.array_compact(F.array("n_name", F.when(F.col("n_nationkey") % 2 == 0, "Even"))).alias("answers"))
    plain = lambda r: F.struct(r["disambiguated_question"].alias("disambiguated_question"), r["answers"].alias("answers"))
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(reading)), plain).alias("interpretations"))
    evidence = F.array().cast("array<struct<title: string, snippet: string>>")
    questions = table(spark, sf_dir, "region").join(nations, "r_regionkey").select(
        F.col("r_name").alias("id"), F.concat(F.lit("which nation of "), "r_name").alias("question"), "interpretations", evidence.alias("evidence")
    )
    rows = ladders.spec_levels(questions)
    return rounded(rows.select("question_id", "spec_level", "question_text", "m_valid", "m0", "target_idx", "target_collision", "fi_spec"))
