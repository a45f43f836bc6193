"""The shard store: tiers, commits, conflicts, versions, and what vacuum may remove."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_brute import bag
from wobble.llm import sharding
from wobble.llm.sharding import Conflict, ShardStore


@pytest.fixture
def store(spark, tmp_path):
    return ShardStore(spark, f"file://{tmp_path}/store", target=64 << 10, floor=1 << 10, fan=4)


def rows(spark, a, b, parts=1):
    return spark.range(a, b, numPartitions=parts).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))


def test_tiers(store):
    assert [store.tier(n) for n in (0, 1023, 1024, 4095, 4096, 16 << 10)] == [0, 0, 0, 0, 1, 2]
    shard = lambda i, n: {"file": f"data/x/{i}", "bytes": n, "of": 9}
    small, large = [shard(i, 1500 + i) for i in range(5)], [shard(9 + i, 5000) for i in range(3)]
    # three shards of a tier are not full; those of half the target or more never merge
    assert store.full_runs({"shards": large}) == []
    assert store.full_runs({"shards": [shard(i, 40 << 10) for i in range(8)]}) == []
    assert store.full_runs({"shards": small + large}) == [small]
    # packed by size up to the target
    runs = store.full_runs({"shards": [shard(i, 20 << 10) for i in range(7)]})
    assert [len(r) for r in runs] == [3, 3]


def test_compaction_keeps_rows_and_merges(spark, store):
    for k in range(9):
        store.append(rows(spark, k * 100, k * 100 + 100, 2))
    before = store.manifest()
    assert len(before["shards"]) == 18
    store.compact()
    after = store.manifest()
    assert len(after["shards"]) < 6 and all(s["bytes"] <= store.target for s in after["shards"])
    assert store.full_runs(after) == []
    assert bag(store.read(), "id") == Counter((i,) for i in range(900))
    # the version before still reads until it is removed
    assert bag(store.read(before["version"]), "id") == bag(store.read(), "id")
    assert store.vacuum() == 18
    assert bag(store.read(), "id") == Counter((i,) for i in range(900))
    with pytest.raises(Exception):
        ShardStore(spark, store.path).read(before["version"])
    store.vacuum(claim_s=-1)
    assert store.versions() == [after["version"]]


def test_two_writers_with_a_vacuum_between(spark, store):
    """One has written but not committed when the other commits, compacts and removes."""
    store.append(rows(spark, 0, 100))
    one, other = ShardStore(spark, store.path, store.target, store.floor, store.fan), ShardStore(spark, store.path, store.target, store.floor, store.fan)
    seen, added = one.manifest(), one._write(rows(spark, 100, 200, 3))
    for k in range(4):
        other.append(rows(spark, 1000 + k, 1001 + k))
    other.compact()
    other.vacuum()
    with pytest.raises(Conflict):
        one.commit(seen, set(), added, None)
    one._retried(lambda m: one.commit(m, set(), added, None), 3)
    one._release(added)
    other.vacuum()
    assert bag(store.read(), "id") == Counter((i,) for i in [*range(200), *range(1000, 1004)])


def test_abandoned_files_go_when_their_claim_is_old(spark, store):
    store.append(rows(spark, 0, 10))
    store._write(rows(spark, 10, 20))  # and the job dies
    assert store.vacuum() == 0
    assert store.vacuum(claim_s=-1) == 1
    assert bag(store.read(), "id") == Counter((i,) for i in range(10))


def test_two_compactions(spark, store):
    for k in range(4):
        store.append(rows(spark, k * 10, k * 10 + 10))
    m = store.manifest()
    read = {s["file"] for s in m["shards"]}
    store.compact()
    with pytest.raises(ValueError):
        store._swap(store.manifest(), read, [])


def test_parts_of_a_manifest(spark, store, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 4)
    for k in range(5):
        store.append(rows(spark, k * 10, k * 10 + 10, 2))
    m = store.manifest()
    assert len(m["parts"]) > 1 and sum(p["n"] for p in m["parts"]) == len(m["shards"]) == 10
    first = store._part(m["parts"][0]["name"])
    after = store.commit(m, {first[0]["file"]}, [], None)
    assert {s["file"] for s in m["shards"]} - {s["file"] for s in after["shards"]} == {first[0]["file"]}
    assert store.read().count() == 45


def test_empty_arrivals_add_no_shard(spark, store, nothing):
    store.append(nothing)
    assert store.manifest()["shards"] == [] and store.read().columns == nothing.columns and store.read().count() == 0
    store.append(nothing)
    assert store.manifest()["version"] == 2 and store.manifest()["shards"] == []
    with pytest.raises(ValueError):
        ShardStore(spark, store.path + "-none").read()


def test_rows_are_kept_as_they_are(spark, store, edge):
    store.append(edge)
    store.append(edge.limit(0))
    store.compact()
    assert bag(store.read(), *edge.columns) == bag(edge, *edge.columns)


def test_sharding_of_nothing(nothing):
    assert sharding.round_trip(nothing).count() == 0


def test_nothing_is_left_behind(spark, store, tmp_path):
    """Neither by an arrival without rows nor by a commit that another one came before."""
    store.append(rows(spark, 0, 10))
    names = lambda: sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*") if not f.name.endswith(".crc"))
    before = names()
    assert store._write(rows(spark, 0, 0)) == [] and names() == before
    seen, added = store.manifest(), store._write(rows(spark, 10, 20))
    store.append(rows(spark, 20, 30))
    before = names()
    with pytest.raises(Conflict):
        store.commit(seen, set(), added, None)
    assert names() == before


def test_columns_with_the_names_of_the_store(spark, store):
    odd = spark.range(20).select(*(F.col("id").alias(c) for c in ("file", "bytes", "version", "parts", "shards", "schema", "n")))
    store.append(odd)
    store.append(odd)
    store.compact()
    assert bag(store.read(), "file", "bytes", "n") == Counter({(i, i, i): 2 for i in range(20)})
