"""The tiered index against a scan in plain Python, with tiers so small that items fall through to all of them."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from wobble.llm import decontamination, lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for d, c in held:
            m = 10 + 90 * c.total() * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def made(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    """Common words, rare ones, copies of one text, items that are passages and items of common words alone."""
    rng = random.Random(5)
    common = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(400):
        own = [rng.choice(common) for _ in range(rng.randint(5, 60))] + words(rng, rng.randint(0, 8)) + [f"r{rng.randint(0, 60)}"]
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, "Copies, OF one-text: w1 w2 w3 zebra") for i in range(30)] + [(3, "w1 zebra"), (None, "w1 zebra"), (3, "w1 zebra"), (2000, None), (2001, ""), (2002, "  - "), (2003, "é É w1" * 3)]
    rows += [(3000, "w4 " * 50_000 + "zebra")]
    items = [(i, rows[7 * i][1]) for i in range(12)] + [(50, "w1 w2 w3 w4 w5"), (51, "zebra"), (52, "W1"), (53, None), (54, ""), (55, "unheard of"), (56, "one text zebra"), (56, "r7"), (None, "É r3"), (None, "r4 w2"), (57, "w1 " * 40 + "r1 r2 r3")]
    return rows, items


@pytest.mark.parametrize("tiers", [(1024, 32768), (4, 40), (1, 2)])
def test_equals_a_scan(spark, corpus, tiers, monkeypatch):
    rows, items = corpus
    monkeypatch.setattr(lexical_search, "TIERS", tiers)
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 10):
        assert made(lexical_search.search(docs, asked, k)) == by_hand(rows, items, k)


def test_tables_that_are_not_small(spark, corpus, monkeypatch):
    """Nothing but an item block's terms is broadcast, the vocabulary is joined, items are searched in many blocks, products are decimals."""
    rows, items = corpus
    monkeypatch.setattr(lexical_search, "TIERS", (4, 40))
    monkeypatch.setattr(lexical_search, "BROADCAST_BYTES", 5000)
    monkeypatch.setattr(lexical_search, "VOCABULARY_BYTES", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert made(lexical_search.search(docs, asked)) == by_hand(rows, items, 10)


def test_whole_index_serves_other_items(spark, corpus, monkeypatch):
    rows, items = corpus
    monkeypatch.setattr(lexical_search, "TIERS", (8, 64))
    at = lexical_search.index(spark.createDataFrame(rows, "doc_id long, text string"))
    some = spark.createDataFrame(items, "item_id long, text string")
    for part in (some.where("item_id < 6"), some.where("item_id >= 6 or item_id is null")):
        assert made(lexical_search.searched(at, part)) == by_hand(rows, [tuple(r) for r in part.collect()], 10)
    tiers = {r.tier: r.n for r in at.postings.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert tiers.keys() == {0, 1, 2} and sum(tiers.values()) == at.counts.count()
    assert at.postings.where("tier = 0").groupBy("term").count().where("count > 400").count() == 0  # common words are not read whole


def test_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(words(random.Random(1), 5000)) + " \u0085é É\t\x00A1b2 " * 30 + "x" * 5000
    want = Counter(t.encode() for t in terms(text))
    for piece in (1, 100, 1000, 1 << 20):
        monkeypatch.setattr(lexical_search, "PIECE", piece)
        assert lexical_search.term_counts(text.encode()) == want
    assert lexical_search.term_counts(b"") == Counter() == lexical_search.term_counts(b" -- ")


def test_impact_beyond_64_bits(spark):
    row = spark.createDataFrame([(7, 10_000_000)], "tf long, n long")
    docs, total = 10**11, 10**14
    m = 10 + 90 * 10_000_000 * docs // total
    assert row.select(lexical_search.impact(docs, total, 10_000_000)).first()[0] == 10**9 * 7 // (7000 + 8 * m)


def test_edges(spark, edge, edge_rows, nothing):
    items = edge.select(F.col("doc_id").alias("item_id"), "text", "score", "n")
    rows = [(r[0], r[1]) for r in edge_rows]
    assert made(lexical_search.search(edge, items)) == by_hand(rows, rows, 10)
    none = nothing.select(F.col("doc_id").alias("item_id"), "text")
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(edge, none).count() == 0
