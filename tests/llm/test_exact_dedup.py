"""Exact duplicates against plain Python, also with a hash so weak that different texts share it."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_brute import bag
from wobble.llm import decontamination, exact_dedup, shared

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(rows, smallest, fold):
    groups = defaultdict(list)
    for r in rows:
        groups[folded(r[1]) if fold else r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        some = [i for i in ids if i is not None]
        stays = (min if smallest else max)(some) if some else None
        left = True
        for i in ids:
            kept = left and i == stays
            left = left and not kept
            out.append((i, stays, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def rows(edge_rows):
    texts = ["Straße", "STRAßE", "STRASSE", "ÉTÉ", "été", "Été", "", None, "same", "SAME", "same", "same ", "a" * 200_000, "A" * 200_000]
    return [*((r[0], r[1]) for r in edge_rows), *((1000 + i, t) for i, t in enumerate(texts)), (1008, "same"), (None, "same"), (None, "only without an id"), (None, "ONLY without an id")]



@pytest.mark.parametrize("smallest", [True, False])
@pytest.mark.parametrize("fold", [True, False])
def test_equals_by_hand(spark, rows, smallest, fold):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert made(exact_dedup.exact_duplicates(docs, smallest=smallest, folded=fold)) == by_hand(rows, smallest, fold)


@pytest.mark.parametrize("bits", [0, 3])
def test_hash_collisions(spark, rows, bits, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    digest = lambda t: F.pmod(F.crc32(t), F.lit(1 << bits)).cast("string").cast("binary")
    want = by_hand(rows, True, True)
    assert made(exact_dedup.exact_duplicates(docs, folded=True, digest=digest)) == want
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)  # no table is broadcast
    monkeypatch.setattr(shared, "HEAVY", 4)  # and many keys are heavy
    assert made(exact_dedup.exact_duplicates(docs, folded=True, digest=digest)) == want


def test_rows_that_stay(spark, edge, edge_rows, nothing):
    left = exact_dedup.deduplicated(edge)
    assert left.columns == edge.columns
    first = {}
    for r in edge_rows:
        key = r[1] or ""
        first[key] = min(first.get(key, r[0]), r[0], key=lambda i: (i is None, i))
    assert bag(left, "doc_id") == bag(spark.createDataFrame([(i,) for i in first.values()], "doc_id long"), "doc_id")
    assert made(exact_dedup.exact_duplicates(edge)) == by_hand(edge_rows, True, False)  # columns of any name are ignored
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    assert exact_dedup.deduplicated(nothing).columns == nothing.columns


def test_main_path_has_no_python(spark, edge, capsys):
    exact_dedup.exact_duplicates(edge).explain()
    assert not any(word in capsys.readouterr().out for word in ("Python", "Arrow", "Pandas"))
