"""Fill-in-the-middle against plain Python over every unit."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wobble.llm import infill


def by_hand(key, text, unit, seed=1, rate=90, spm=20):
    text = text or ""
    units = re.findall({"code point": r"(?s).", "word": r"\s*\S+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in infill.MARKERS) or h3 % 100 >= rate:
        return key, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def made(df):
    out = df.withColumn("back", infill.restored(F.col("output"), F.col("form")))
    return sorted((tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()), key=repr)


@pytest.fixture(scope="module")
def rows(edge_rows):
    rng = random.Random(3)
    alphabet = "ab \n\tÜ語😀<>PSM"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 31, 32, 33, 63, 64, 65, 1023, 1024, 1025, 2048, 5000]))) for _ in range(150)]
    texts += ["a<P>b", "<S>", "x<M>", "<", "><P", "<P<S", "\r\n\r\n", " \u0085x", "😀" * 3000, " " * 1500, "word", "\n" * 70]
    same = [(5, texts[3]), (5, texts[3]), (None, texts[4]), (None, texts[4])]
    return [*((r[0], r[1]) for r in edge_rows), *((10_000 + i, t) for i, t in enumerate(texts)), *same]


@pytest.mark.parametrize("unit", ["code point", "word", "line"])
def test_equals_by_hand(spark, rows, unit):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    unit_rows = rows
    if unit == "word":  # the two engines differ in which rare characters are white space
        unit_rows = [r for r in rows if not r[1] or "\u0085" not in r[1]]
        docs = docs.where("text is null or not contains(text, '\u0085')")
    assert made(infill.transformed(docs, unit=unit)) == sorted((by_hand(*r, unit) for r in unit_rows), key=repr)


def test_rates_and_seed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for seed, rate, spm in ((7, 100, 100), (8, 0, 0), (9, 100, 0)):
        assert made(infill.transformed(docs, seed=seed, rate=rate, spm=spm)) == sorted((by_hand(*r, "code point", seed, rate, spm) for r in rows), key=repr)


def test_edges_and_plan(spark, edge, edge_rows, nothing, capsys):
    out = infill.transformed(edge)
    assert made(out) == sorted((by_hand(r[0], r[1], "code point") for r in edge_rows), key=repr)
    assert infill.transformed(nothing).count() == 0
    long = "x" * 3_000_000 + "😀" * 1_000_000
    assert made(infill.transformed(spark.createDataFrame([(1, long)], "doc_id long, text string"))) == [by_hand(1, long, "code point")]
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan
