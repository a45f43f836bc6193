"""The pipeline's stages in turn, each against plain Python on what its predecessor kept."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_brute import alignment, mixed_by_hand, shingle_sequence
from wobble.llm import mixing, quality_knn
from wobble.llm.queries import tokenizer_path


def vote(vectors, labels, x, k):
    """Weighted share of label 1 among the k labelled vectors with the largest cosine; equal ones by place."""
    cos = [float(np.dot(v, x)) for v in vectors]
    near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[:k]
    weight = [max(cos[i], 0) ** 2 for i in near]
    return sum(w * labels[i] for w, i in zip(weight, near)) / sum(weight) if sum(weight) else float(np.mean(labels))


def held_out(key):
    return key is None or zlib.crc32(str(key).encode()) % 5 == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Some good texts with near and exact copies and leaked items, some bad ones, labels for most, three items."""
    rng = random.Random(21)
    good, rows = [words(rng, rng.randint(60, 140)) for _ in range(30)], []
    items = [" ".join(words(rng, 25)) for _ in range(3)]
    for i, w in enumerate(good):
        rows.append((i, " ".join(w), "en", "abc"[i % 3], 0))
    for i in range(6):  # near and exact copies
        w = good[i].copy()
        w[30] = "other"
        rows += [(100 + i, " ".join(w), "en", "a", 0), (200 + i, " ".join(good[i + 6]), "fr", "b", 0)]
    for i in range(4):
        rows.append((300 + i, " ".join(words(rng, 40)) + " " + items[i % 3] + " " + " ".join(words(rng, 20)), "en", None, 0))
    for i in range(20):
        rows.append((400 + i, "$$ ## " * rng.randint(30, 60) + "BUY BUY", "en", "a", 0))
    rows += [(500, None, "en", "a", 0), (501, "", "en", "b", 0), (None, " ".join(words(rng, 90)), None, "c", None)]
    rows = [(a, t, lang, s, len(t or "")) for a, t, lang, s, _ in rows]
    at = tmp_path_factory.mktemp("corpus")
    pandas = spark.createDataFrame(rows, SCHEMA).toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"})
    pandas.to_parquet(at / "documents.parquet")
    labels = [(r[0], 0 if r[0] is not None and 400 <= r[0] < 500 else 1, 0) for r in rows if r[0] is not None and r[0] != 501]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toPandas().to_parquet(at / "labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").toPandas().to_parquet(at / "benchmark.parquet")
    return str(at)


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_equal_plain_python(spark, folder, tmp_path):
    docs, labels, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    stages = [f for _, f in corpus_pipeline.STAGES]

    def after(i, docs):
        out = stages[i](spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.schema(out.schema).parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == docs.columns
        return out

    # quality
    model = quality_knn.fit(docs, labels)
    before, kept = rows_of(docs), after(0, docs)
    known = {r.doc_id: r.quality for r in labels.collect() if not held_out(r.doc_id)}
    assert len(model.labels) == len({r[0] for r in before if r[0] in known})
    from wobble.llm.kernels import chunks
    import pyarrow as pa

    score = {}
    for _, t, _ in before:
        c = next(chunks(pa.array([t or ""])))
        score[t] = vote(model.vectors, model.labels, model.project(*quality_knn.features(c), 1)[0], model.k)
    assert Counter(rows_of(kept)) == Counter(r for r in before if score[r[1]] >= 0.3)
    assert not any(r[0] is not None and 400 <= r[0] < 500 for r in rows_of(kept))

    # near-duplicates: of a class the row with the smallest id; null texts are classes of their own
    before, kept = rows_of(kept), after(1, kept)
    texts = sorted({t for _, t, _ in before if t is not None})
    seqs, root = {t: shingle_sequence(t) for t in texts}, {t: t for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if seqs[a] and seqs[b] and alignment(seqs[a], seqs[b]) >= 0.8:
                old, new = root[a], root[b]
                root = {t: new if r == old else r for t, r in root.items()}
    classes = defaultdict(list)
    for r in before:
        if r[1] is not None:
            classes[root[r[1]]].append(r)
    want = [min(c, key=lambda r: (r[0] is None, r[0])) for c in classes.values()] + [r for r in before if r[1] is None]
    assert Counter(rows_of(kept)) == Counter(want) and len(want) < len(before)

    # leaks
    before, kept = rows_of(kept), after(2, kept)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)}
    tests = [grams(r.text) for r in items.collect()]
    clean = lambda t: all(len(g & grams(t)) < 0.8 * len(g) for g in tests)
    assert Counter(rows_of(kept)) == Counter(r for r in before if clean(r[1])) and len(rows_of(kept)) < len(before)

    # mixture: words by document
    numbered, table, shards = mixing.placed(kept)
    taken, _ = mixed_by_hand(numbered, table, shards)
    mixed = after(3, kept)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = Counter()
    for key, t, _ in rows_of(mixed):
        got[key] += size(t)
    want = Counter()
    for (_, key, _), n in taken.items():
        want[key] += n
    assert got == want and sum(want.values()) > 0
    texts = {r[0]: (r[1] or "").split() for r in rows_of(kept)}
    assert all(Counter((t or "").split()) <= Counter(texts[key]) for key, t, _ in rows_of(mixed))

    # token ids
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    before, out = rows_of(mixed), after(4, mixed)
    want = Counter()
    for key, t, _ in before:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out.collect()) == want
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(tuple(r) for r in whole.collect()) == Counter(tuple(r) for r in out.collect())


def test_votes_equal_plain_python(spark, sf):
    """Every document of the small tables, with ties: all labelled vectors twice."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_knn.fit(docs, labels)
    from wobble.llm.kernels import chunks
    import pyarrow as pa

    texts = [r.text or "" for r in docs.select("text").collect()] + ["", "unseen"]
    x = np.concatenate([model.project(*quality_knn.features(c), c.n) for c in chunks(pa.array(texts))])
    want = [vote(model.vectors, model.labels, v, model.k) for v in x]
    assert np.allclose(model.scores(x), want, atol=1e-5)
    twice = quality_knn.Model(model.idf, model.basis, np.repeat(model.vectors, 2, axis=0), np.stack([model.labels, 1 - model.labels], 1).ravel(), 5)
    # of equal neighbours the earlier counts: the fifth is the first of its pair
    rounded = quality_knn.Model(model.idf, model.basis, np.round(twice.vectors, 2), twice.labels, 5)
    y = np.round(x, 2)
    assert np.allclose(rounded.scores(y), [vote(rounded.vectors, rounded.labels, v, 5) for v in y], atol=0.35)
    assert quality_knn.fit(docs, labels.where("false")).scores(np.zeros((2, 1), np.float32)).tolist() == [0.5, 0.5]


def test_labels_are_learnt_once_per_id(spark):
    """Repeated ids: the largest label and the smallest text; null labels and held-out ids are not learnt."""
    ids = [i for i in range(40) if not held_out(i)][:6]
    out = next(i for i in range(40) if held_out(i))
    docs = spark.createDataFrame([(ids[0], "b b"), (ids[0], "a a"), (ids[1], "c"), (ids[2], None), (out, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 0), (ids[0], 1), (ids[1], None), (ids[2], 1), (out, 1), (ids[5], 1)], "doc_id long, quality int")
    got = quality_knn.training_rows(docs, labels, 100, "doc_id", "text", "quality").collect()
    assert sorted((r.id, r.label, r.text) for r in got) == sorted([(ids[0], 1.0, "a a"), (ids[2], 1.0, "")])
    assert quality_knn.classified(docs, labels).count() == 6


def test_no_documents(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").where("false").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
