"""Parsers of question records: each source layout becomes one of two unified tables by projection alone.

``questions``: ``id, dataset, question, answer, question_type, level, paragraphs, supporting_facts, question_decomposition,
n_hops``. ``ambiguous``: ``id, question, interpretations, evidence``. Schemas are explicit, nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

PAIRED = (
    "id string, question string, answer string, type string, level string, context struct<title: array<string>, sentences: array<array<string>>>, "
    "supporting_facts struct<title: array<string>, sent_id: array<int>>"
)
DECOMPOSED = (
    "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx: int, title: string, paragraph_text: string, "
    "text: string, is_supporting: boolean>>, question_decomposition array<struct<id: int, question: string, answer: string, paragraph_support_idx: int>>"
)
COLUMNAR = (
    "id string, question string, annotations struct<type: array<string>, answer: array<array<string>>, qaPairs: array<struct<question: array<string>, "
    "answer: array<array<string>>>>>, used_queries struct<query: array<string>, results: array<struct<title: array<string>, snippet: array<string>>>>"
)
ROWWISE = (
    "id string, question string, annotations array<struct<type: string, answer: array<string>, qaPairs: array<struct<question: string, answer: array<string>>>>>, "
    "used_queries array<struct<query: string, results: array<struct<title: string, snippet: string>>>>"
)
SPLITS = {"validation": "dev", "valid": "dev", "dev": "dev"}


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists in its file system; an error if none does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def local_names(folder: str, split: str) -> list[str]:
    """Where a decomposed set may lie below a folder."""
    name = SPLITS.get(split, split)
    return [f"{folder}/{stem}_v1.0_{name}.jsonl" for stem in ("musique_ans", "musique_full")] + [f"{folder}/musique_{name}.jsonl"]


def some(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def regold(paragraphs: Column, facts: Column) -> Column:
    """Gold by title where the facts name another number of titles than there are gold paragraphs; else as given."""
    named = F.array_distinct(F.transform(facts, lambda f: f["title"]))
    gold = F.size(F.filter(paragraphs, lambda p: p["is_gold"]))
    by_title = F.transform(paragraphs, lambda p: F.struct(p["title"].alias("title"), p["sentences"].alias("sentences"), F.array_contains(named, p["title"]).alias("is_gold")))
    return F.when((F.size(facts) > 0) & (gold != F.size(named)), by_title).otherwise(paragraphs)


def paired(raw: DataFrame, dataset: str, with_level: bool = True) -> DataFrame:
    """Records whose context is a pair of lists."""
    c, f = F.col("context"), F.col("supporting_facts")
    same = F.assert_true((F.size(c["title"]) == F.size(c["sentences"])) & (F.size(f["title"]) == F.size(f["sent_id"])), F.lit("lists of one record differ in length"))
    paragraphs = F.transform(
        F.arrays_zip(c["title"].alias("title"), c["sentences"].alias("sentences")),
        lambda p: F.struct(p["title"].alias("title"), p["sentences"].alias("sentences"), F.array_contains(f["title"], p["title"]).alias("is_gold")),
    )
    facts = F.arrays_zip(f["title"].alias("title"), f["sent_id"].alias("sent_id"))
    none = F.array().cast("array<struct<hop_idx: int, sub_question: string, sub_answer: string, supporting_paragraph_idx: int>>")
    return raw.where(same.isNull()).select(
        "id", F.lit(dataset).alias("dataset"), "question", "answer", F.col("type").alias("question_type"), (F.col("level") if with_level else F.lit(None).cast("string")).alias("level"),
        regold(paragraphs, facts).alias("paragraphs"), facts.alias("supporting_facts"), none.alias("question_decomposition"), F.lit(None).cast("int").alias("n_hops"),
    )


def decomposed(raw: DataFrame, dataset: str = "musique") -> DataFrame:
    """Records with a chain of sub-questions; paragraphs are ordered by ``idx`` if the first has one."""
    p = F.col("paragraphs")
    before = lambda a, b: F.coalesce(a["idx"], F.lit(0)) - F.coalesce(b["idx"], F.lit(0))
    ordered = F.when(F.get(p, 0)["idx"].isNotNull(), F.array_sort(p, before)).otherwise(p)
    body = lambda q: F.coalesce(F.nullif(q["paragraph_text"], F.lit("")), F.nullif(q["text"], F.lit("")), F.lit(""))
    paragraphs = F.transform(ordered, lambda q: F.struct(q["title"].alias("title"), F.array(body(q)).alias("sentences"), F.coalesce(q["is_supporting"], F.lit(False)).alias("is_gold")))
    hops = F.transform("question_decomposition", lambda h, i: F.struct(i.alias("hop_idx"), h["question"].alias("sub_question"), h["answer"].alias("sub_answer"), h["paragraph_support_idx"].alias("supporting_paragraph_idx")))
    n = F.size("question_decomposition")
    facts = F.array().cast("array<struct<title: string, sent_id: int>>")
    return raw.select(
        "id", F.lit(dataset).alias("dataset"), "question", "answer", hop_label(n).alias("question_type"), F.lit(None).cast("string").alias("level"),
        paragraphs.alias("paragraphs"), facts.alias("supporting_facts"), hops.alias("question_decomposition"), n.alias("n_hops"),
    )


def hop_label(n: Column) -> Column:
    return F.concat(F.greatest(F.lit(2), F.least(F.lit(4), n)).cast("string"), F.lit("hop"))


def clean_answers(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")


def _rowwise(raw: DataFrame) -> DataFrame:
    """The columnar layout as the row-wise one; shorter lists set the length."""
    a = F.col("annotations")
    pairs = lambda q: F.when(q.isNotNull(), F.filter(F.zip_with(q["question"], q["answer"], lambda x, y: F.struct(x.alias("question"), y.alias("answer"))), lambda p: p["question"].isNotNull() & p["answer"].isNotNull()))
    each = F.transform(
        F.arrays_zip(a["type"].alias("type"), a["answer"].alias("answer"), a["qaPairs"].alias("pairs")),
        lambda x: F.struct(x["type"].alias("type"), x["answer"].alias("answer"), pairs(x["pairs"]).alias("qaPairs")),
    )
    results = F.transform(
        F.col("used_queries")["results"],
        lambda r: F.struct(F.lit(None).cast("string").alias("query"), F.filter(F.zip_with(r["title"], r["snippet"], lambda t, s: F.struct(t.alias("title"), s.alias("snippet"))), lambda p: p["title"].isNotNull() & p["snippet"].isNotNull()).alias("results")),
    )
    return raw.select("id", "question", each.alias("annotations"), results.alias("used_queries"))


def ambiguous(raw: DataFrame, columnar: bool = False) -> DataFrame:
    """Ambiguous questions with their readings and evidence; records without an id, a question or a reading are left out.

    The first annotation with several usable readings counts, else the first with one answer. A reading is dropped if an
    earlier one asks the same, case and white space aside; evidence if an earlier snippet is the same.
    """
    rows = _rowwise(raw) if columnar else raw
    usable = lambda a: F.filter(
        F.transform(F.coalesce(a["qaPairs"], F.array().cast("array<struct<question: string, answer: array<string>>>")), lambda p: F.struct(F.trim(p["question"]).alias("disambiguated_question"), clean_answers(p["answer"]).alias("answers"))),
        lambda p: (F.coalesce(p["disambiguated_question"], F.lit("")) != "") & (F.size(p["answers"]) > 0),
    )
    key = lambda q: X.squeezed(F.lower(q))
    empty = F.array().cast("array<struct<disambiguated_question: string, answers: array<string>>>")
    distinct = lambda ps: F.aggregate(ps, empty, lambda kept, p: F.when(F.exists(kept, lambda k: key(k["disambiguated_question"]) == key(p["disambiguated_question"])), kept).otherwise(F.concat(kept, F.array(p))))
    many = F.filter(F.transform(F.filter("annotations", lambda a: a["type"] == "multipleQAs"), usable), lambda ps: F.size(ps) > 0)
    single = F.filter(F.transform(F.filter("annotations", lambda a: a["type"] == "singleAnswer"), lambda a: clean_answers(a["answer"])), lambda x: F.size(x) > 0)
    alone = F.array(F.struct(F.trim("question").alias("disambiguated_question"), F.get(single, 0).alias("answers")))
    interpretations = F.when(F.size(many) > 0, distinct(F.get(many, 0))).when(F.size(single) > 0, alone)
    snippets = F.flatten(F.transform(F.coalesce("used_queries", F.array().cast(rows.schema["used_queries"].dataType)), lambda u: u["results"]))
    parsed = rows.select(F.trim("id").alias("id"), F.trim("question").alias("question"), interpretations.alias("interpretations"), snippets.alias("_s"))
    parsed = parsed.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("question", F.lit("")) != "") & F.col("interpretations").isNotNull())
    # entities need Python, so snippets are cleaned as rows
    flat = parsed.select("id", F.posexplode("_s").alias("pos", "e")).select("id", "pos", X.snippet(F.col("e.title")).alias("title"), X.snippet(F.col("e.snippet")).alias("snippet"))
    first = flat.where("snippet <> ''").groupBy("id", "snippet").agg(F.min(F.struct("pos", "title")).alias("f"))
    evidence = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f.pos", "f.title", "snippet"))), lambda e: F.struct(e["title"].alias("title"), e["snippet"].alias("snippet"))).alias("evidence"))
    out = parsed.drop("_s").join(evidence, "id", "left")
    return out.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<title: string, snippet: string>>")))


def accepted(questions: DataFrame, least: int = 2, anchors: bool = False) -> DataFrame:
    m0 = F.size("interpretations")
    return questions.where((m0 >= least) | (F.lit(anchors) & (m0 == 1)))


def by_id(parts: list[DataFrame]) -> DataFrame:
    """All questions, of equal ids the one from the last part."""
    from ..operators.relational import merged

    return merged(parts, ["id"])


def manifest(questions: DataFrame) -> DataFrame:
    """Records by dataset, level, type and hops."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<none>")).alias(c)
    return questions.groupBy("dataset", name("level"), name("question_type"), name("n_hops")).agg(F.count("*").alias("n"))
