import pytest

from tests.compare import differences
from wobble.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, sf, name):
    assert differences(llm.queries()[name](spark, sf), sf, SQL[name]) == []


@pytest.mark.parametrize("name", ["op1_sharding", "op3_quality_rules", "op5_decontamination"])
def test_edge_rows_equal_sql(spark, edge, tmp_path, name):
    """Null and repeated ids too; other texts share an id with a row that holds an item, or half of one."""
    texts = [r.text for r in edge.where("doc_id in (16, 31)").orderBy("doc_id").select("text").collect()]
    half = texts[0].split()
    more = [(4, texts[0]), (4, "another text of that id"), (None, texts[0]), (None, "one more without an id"), (900, " ".join(half[:60])), (900, " ".join(half[60:])), (901, "Who wrote; HAMLET?"), (902, "who wrote")]
    docs = edge.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    items = [(1, texts[0]), (2, " ".join(texts[1].split()[10:60])), (3, None), (4, ""), (5, "who wrote Hamlet"), (None, " ".join(half[5:40])), (6, " ".join(half[:30])), (6, "xyz xyz xyz xyz xyz")]
    spark.createDataFrame(items, "item_id long, text string").toPandas().astype({"item_id": "Int64"}).to_parquet(tmp_path / "benchmark.parquet")
    out = llm.queries()[name](spark, str(tmp_path))
    assert differences(out, str(tmp_path), SQL[name]) == []
    if name == "op5_decontamination":
        assert {(901, 5), (4, 1), (None, 1), (16, None)} <= {(r.doc_id, r.item_id) for r in out.collect()}


@pytest.mark.parametrize("name", ["op1_sharding", "op3_quality_rules", "op5_decontamination"])
def test_empty_tables_equal_sql(spark, nothing, tmp_path, name):
    nothing.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64", "text": "string"}).to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "some words that are an item")], "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    assert llm.queries()[name](spark, str(tmp_path)).count() == 0


def test_pages_at_the_edge(spark, tmp_path):
    long = "<p>" + "é" * 600
    html = [None, "", "short", "short", long, long, long, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "a\r\n\r\nWARC/1.0\r\n" * 100]
    rows = [(i, f"http://a.example/{i % 7}" if i else None, h) for i, h in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    assert differences(llm.queries()["op2_warc_archives"](spark, str(tmp_path)), str(tmp_path), SQL["op2_warc_archives"]) == []
