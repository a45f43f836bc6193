"""Tables that are too large to broadcast, keys that hold most rows, and shards that end early: the same rows as without."""

import random
import time

import pytest

from tests.llm.conftest import words
from tests.llm.test_brute import bag, mixture_rows
from wobble.llm import decontamination, mixing, order_minhash, shared, sharding, token_ids
from wobble.llm.queries import tokenizer_path


def test_a_plan_that_is_not_small(spark, edge, monkeypatch):
    docs = mixture_rows(spark, edge)
    columns = ("doc_id", "size", "taken", "n_shards", "first_shard")
    want = bag(mixing.taken(docs, shards=7), *columns)
    texts = bag(mixing.mixture(docs, shards=7), "doc_id", "text")
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    assert bag(mixing.taken(docs, shards=7), *columns) == want
    assert bag(mixing.mixture(docs, shards=7), "doc_id", "text") == texts


@pytest.mark.parametrize("most", [(1, 1 << 28), (5, 1 << 28), (1000, 50)])
def test_token_shards_end_early(spark, edge, tmp_path, most):
    path = tokenizer_path("byte_bpe_50k.json")
    columns = ("doc_id", "start", "n_tokens", "ids_crc32", "ids")
    rows = edge.coalesce(1)
    token_ids.write_corpus(rows, path, f"file://{tmp_path}/whole")
    made = token_ids.write_corpus(rows, path, f"file://{tmp_path}/parts", most=most)
    assert bag(token_ids.read_corpus(spark, f"file://{tmp_path}/parts"), *columns) == bag(token_ids.read_corpus(spark, f"file://{tmp_path}/whole"), *columns)
    starts = [s["start"] for s in made["shards"]]
    assert starts == sorted(starts) and sum(s["n_docs"] for s in made["shards"]) == edge.count()


def test_runs_of_many_shards_are_packed_in_time(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    shards = [{"file": f"data/x/{i:06d}", "bytes": 1000 + i % 7} for i in range(50_000)]
    began = time.perf_counter()
    runs = store.full_runs({"shards": shards})
    assert time.perf_counter() - began < 5
    assert sum(map(len, runs)) == 50_000 and all(sum(s["bytes"] for s in r) <= store.target for r in runs)


def template_rows(spark, n=300):
    """Fillings of one template, some of them alike, so that its buckets and a leader hold most rows."""
    rng = random.Random(17)
    frame, rows = words(rng, 160), []
    for i in range(n):
        text = frame.copy()
        text[20:45] = words(rng, 25)
        if i % 3 == 1:  # near the row before
            text = rows[-1][1].split()
            text[100] = f"odd{i}"
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_hot_buckets(spark, monkeypatch):
    docs = template_rows(spark)
    want = bag(order_minhash.near_duplicates(docs), "doc_id", "class_id", "class_size")
    monkeypatch.setattr(shared, "HEAVY", 3)  # any key with a few rows is heavy
    assert bag(order_minhash.near_duplicates(docs), "doc_id", "class_id", "class_size") == want


def test_recall_of_planted_pairs(spark):
    """Texts that agree in 0.80 to 0.85 of their shingles in order: the share of such pairs that are found."""
    rng = random.Random(23)
    rows, pairs = [], []
    for i in range(1000):
        w = words(rng, 204)  # 200 shingles
        other = w.copy()
        for at in rng.sample(range(10, 190, 10), 7):  # a word changed alone takes five shingles away
            other[at] = "changed" + str(rng.random())[2:8]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        pairs.append((2 * i, 2 * i + 1))
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 990
