"""Operators that SQL cannot express, against plain Python over every row."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from wobble.llm import decontamination, kernels, mixing, order_minhash, quality_knn, quality_rules, repeats, shared, sharding, token_ids, tokens
from wobble.llm.elias_fano import EliasFano
from wobble.llm.queries import tokenizer_path


def bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def cut_by_hand(rows):
    starts, datas = defaultdict(int), [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in datas:
        for i in range(len(b) - 199):
            starts[b[i : i + 200]] += 1
    want = Counter()
    for key, b in datas:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 199):
            if starts[b[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        want[key, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return want


CUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeated_strings(edge, edge_rows, nothing, monkeypatch):
    want = cut_by_hand(edge_rows)
    assert bag(repeats.cut(edge), *CUT) == want
    monkeypatch.setattr(kernels, "CHUNK", 1000)  # texts are walked in pieces
    monkeypatch.setattr(repeats, "overlapping", functools.partial(repeats.overlapping, limit=1000))
    assert bag(repeats.cut(edge), *CUT) == want
    assert repeats.cut(nothing).count() == 0


@pytest.mark.parametrize("hot", [1, 20])
def test_hot_phrases(spark, monkeypatch, hot):
    """Phrases of 40 to 230 bytes in many documents, so that groups are split by the bytes around their gram, down to single windows."""
    rng, rows = random.Random(9), []
    phrases = [" ".join(words(rng, 80))[:n] for n in (40, 100, 150, 190, 199, 200, 230)]
    for i in range(120):
        text = " ".join(words(rng, 25)) + phrases[i % 7] + " ".join(words(rng, 25))
        rows.append((i, text + (phrases[(i + 2) % 7] if i % 5 == 0 else "")))
    rows += [(200, "ab" * 400), (201, "ab" * 300 + "c"), (202, phrases[6]), (None, phrases[6]), (3, rows[3][1]), (3, "x" + rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.covered(repeats.keyed(docs, "doc_id", "text"), hot=hot, shard=1 << 12)
    monkeypatch.setattr(repeats, "covered", lambda _: out)
    assert bag(repeats.cut(docs), *CUT) == cut_by_hand(rows)


def test_the_sorter_is_needed(spark, edge, edge_rows, monkeypatch):
    """Without what the suffix sorter finds, ranges that differing runs share are not removed."""
    monkeypatch.setattr(repeats, "_differing_ranges", lambda rows, *_: rows.select(*repeats.RUN, repeats.F.lit(0).cast("long").alias("from"), repeats.F.lit(0).cast("long").alias("to")).limit(0))
    assert bag(repeats.cut(edge), *CUT) != cut_by_hand(edge_rows)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAVY", 5)
    left = shared.stored(spark.createDataFrame([(1, i) for i in range(60)] + [(k, k) for k in range(2, 30)], "k long, v long"), "left")
    right = spark.createDataFrame([(k, -k) for k in range(0, 30, 3)] + [(1, -1)], "k long, w long")
    for how in ("inner", "left"):
        assert bag(shared.matched(left, right, ["k"], how), "k", "v", "w") == bag(left.join(right, ["k"], how), "k", "v", "w")


def test_scratch_leaves_what_is_kept(spark, tmp_path):
    from pathlib import Path

    with shared.scratch(spark) as keep:
        gone, inner = shared.stored(spark.range(3), "gone"), shared.stored_by(spark.range(3), "id", "named")
        kept = keep(shared.stored(gone.join(inner, "id"), "kept"))
    assert kept.count() == 3
    assert [Path(x.shared_path.removeprefix("file://")).exists() for x in (gone, inner, kept)] == [False, False, True]
    assert not any(t.name.startswith("named") for t in spark.catalog.listTables())


def test_token_ids(edge, edge_rows, nothing):
    import tokenizers

    path = tokenizer_path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    want = Counter()
    for key, text, *_ in edge_rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want[key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    rows = token_ids.round_trip(edge, path)
    assert bag(rows, "doc_id", "n_tokens", "ids_crc32") == want
    got = sorted((r.start, r.n_tokens) for r in rows.select("start", "n_tokens").collect())
    assert [s for s, _ in got] == np.cumsum([0, *(n for _, n in got[:-1])]).tolist()
    assert token_ids.round_trip(nothing, path).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(edge, edge_rows, nothing, name):
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        import tokenizers

        tok = tokenizers.Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    want = Counter()
    for key, text, *_ in edge_rows:
        n = count(text or "")
        want[key, len((text or "").encode()), n, n > 4096] += 1
    assert bag(tokens.count_tokens(edge, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert tokens.count_tokens(nothing, path).count() == 0


PARTS = ["a", "b", " ", "\n", "'", "s", ".", "*", "|", "<|endoftext|>", "<s>", "</s>", "é", "語", "1", "\u00a0", "\t", "  ", "Word", "re,", "ß$", "\u200b", "\u2581", "😀", "'re", "the"]


def strings(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize(("part", "remembered"), [(1 << 16, 48 << 20), (3, 1000)])
def test_encoder_equals_library(monkeypatch, part, remembered):
    """Also with parts so small that texts are cut, and a memory that is always full."""
    monkeypatch.setattr(token_ids, "PART", part)
    coder, texts = token_ids.Encoder(tokenizer_path("byte_bpe_50k.json"), remembered), strings(1, 8000)
    for i in range(0, len(texts), 1000):
        ids, n = coder.encode(pa.array(texts[i : i + 1000]), 0)
        want = [[*x.ids, 0] for x in coder.model.encode_batch(texts[i : i + 1000], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert coder.encode(pa.array([], pa.string()), 0)[0].tolist() == []


def test_boundaries_are_read_by_select():
    rng = np.random.default_rng(2)
    for values in ([], [7], [0, 0, 0], np.cumsum(rng.integers(0, 3, 9000)), np.sort(rng.integers(-(10**12), 10**12, 20_001)), [5] * 5000 + [10**11]):
        values = np.array(values, np.int64)
        coded = EliasFano.frombytes(EliasFano.encode(values).tobytes())
        picks = range(0, len(values), max(1, len(values) // 300))
        assert [coded.select(i) for i in picks] == [int(values[i]) for i in picks]
        for a, b in ((0, len(values)), (len(values) // 3, len(values) // 2), (max(0, len(values) - 5), len(values))):
            assert coded.window(a, b).tolist() == values[a:b].tolist()
        for v in (-1, 0, 5, 4000, 10**11):
            assert coded.upto(v) == int(np.searchsorted(values, v, "right"))
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))


def test_reader_needs_select(spark, edge, monkeypatch, tmp_path):
    """The reader finds documents through the select structure alone: with a false one it fails or reads other ids."""
    path = tokenizer_path("byte_bpe_50k.json")
    out = f"file://{tmp_path}/ids"
    token_ids.write_corpus(edge, path, out)
    right = bag(token_ids.read_corpus(spark, out), "doc_id", "start", "n_tokens", "ids_crc32")
    for file in tmp_path.glob("ids/*.ends"):
        coded = EliasFano.frombytes(file.read_bytes())
        coded.samples = coded.samples + 1
        file.write_bytes(coded.tobytes())
    try:
        assert bag(token_ids.read_corpus(spark, out), "doc_id", "start", "n_tokens", "ids_crc32") != right
    except Exception as e:  # noqa: BLE001
        assert "Error" in str(e)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counter_equals_library(monkeypatch, name):
    path, texts = tokenizer_path(name), strings(2, 8000) + ["\u2581 \u2581", "a" * 3000, "a  b " * 3000]
    counter = tokens.counter(path)
    if name.endswith(".model"):
        rng = random.Random(4)
        texts += ["".join(rng.choice(["a", " ", "\u2581", "word", "the"]) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
        want = [len(x) for x in counter.model.encode(texts)]
    else:
        want = [len(x.ids) for x in counter.model.encode_batch(texts, add_special_tokens=False)]
    for part in (1 << 16, 3):
        monkeypatch.setattr(tokens, "PART", part)
        monkeypatch.setattr(token_ids, "PART", part)
        assert counter.lengths(pa.array(texts)).tolist() == want


def test_long_texts_are_counted_in_parts():
    """A text of 20 MB is cut into small parts, double spaces or not, and a worker stays small."""
    counter = tokens.counter(tokenizer_path("piece_bpe_32k.model"))
    text = " some  words and more \u2581 " * 800_000
    parts, at = counter.cut(pa.array([text]))
    assert len(text) > 19_000_000 and len(parts) > 3_000_000 and max(map(len, parts.to_pylist())) < 20
    assert counter.lengths(pa.array([text[: len(text) // 800]])).tolist() == [len(counter.model.encode(text[: len(text) // 800]))]


def shingle_sequence(text):
    import re

    w = [x.decode("latin1") for x in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    seen = Counter()
    out = []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def alignment(a, b):
    row = np.zeros(len(b) + 1, int)
    for x in a:
        same = np.array([x == y for y in b])
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(same, row[:-1] + 1, 0)))
    return row[-1] / max(len(a), len(b))


def test_near_duplicates(edge, edge_rows, nothing):
    """All pairs of small texts by full alignment, then components; ids of a class name it by the smallest."""
    small = [r for r in edge_rows if r[1] is None or len(r[1]) < 5000]
    rows = edge.where("text is null or length(text) < 5000")
    distinct = sorted({r[1] for r in small if r[1] is not None})
    seqs = {t: shingle_sequence(t) for t in distinct}
    root = {t: t for t in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if seqs[a] and seqs[b] and alignment(seqs[a], seqs[b]) >= 0.8:
                old, new = root[a], root[b]
                root = {t: new if r == old else r for t, r in root.items()}
    groups = defaultdict(list)
    for r in small:
        if r[1] is not None:
            groups[root[r[1]]].append(r[0])
    want = Counter()
    for r in small:
        g = groups[root[r[1]]] if r[1] is not None else [r[0]]
        ids = [x for x in g if x is not None]
        want[r[0], min(ids) if ids else None, len(g)] += 1
    assert bag(order_minhash.near_duplicates(rows), "doc_id", "class_id", "class_size") == want
    assert order_minhash.near_duplicates(nothing).count() == 0
    kept = order_minhash.deduplicated(edge)
    assert kept.columns == edge.columns
    assert order_minhash.deduplicated(nothing).count() == 0


def test_near_duplicates_of_one_passage(spark):
    """Many unlike groups whose texts share most of their shingles with all others, so that they crowd the same buckets."""
    rng = random.Random(3)
    passage, texts = words(rng, 79), []
    for _ in range(60):
        own = words(rng, 25)
        texts += [" ".join(passage + own), " ".join(passage + own[:11] + words(rng, 14))]
    seqs = [shingle_sequence(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(set(seqs[i]) & set(seqs[j])) >= 80 and alignment(seqs[i], seqs[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    assert len(set(root)) == 60
    want = Counter((i, root.index(r)) for i, r in enumerate(root))
    got = bag(order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "class_id")
    assert got == want


def test_rows_without_an_id_are_told_apart(spark):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(words(rng, 80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, c), (9, d), (9, e), (9, e), (None, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(order_minhash.deduplicated(docs), "doc_id", "text") == Counter([(None, a), (None, b), (7, c), (9, d), (9, e), (None, None), (4, None)])
    one = docs.where("doc_id is not null").unionByName(spark.createDataFrame([(None, c)], "doc_id long, text string"))
    assert bag(order_minhash.deduplicated(one), "doc_id", "text") == Counter([(7, c), (9, d), (9, e), (4, None)])
    items = spark.createDataFrame([(1, a), (2, d)], "item_id long, text string")
    assert bag(decontamination.clean(docs, items), "doc_id", "text") == Counter(r for r in rows if r[1] not in (a, d))


def test_quality_classifier(spark, sf, edge, nothing):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_knn.classified(docs, labels)
    judged = out.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in judged]) >= 0.8
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    cols = ("doc_id", "held_out", "score", "predicted")
    assert bag(quality_knn.classified(docs, flipped), *cols) == bag(out, *cols)
    scored = quality_knn.classified(edge, labels)
    assert scored.count() == edge.count()
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_knn.classified(nothing, labels).count() == 0
    kept = quality_knn.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert bag(kept, "doc_id") == bag(out.where("predicted = 1"), "doc_id")


def mixed_by_hand(numbered, table, shards):
    """Words taken of each copy by (h, id, copy), and of each shard by source, dealing every block of every pass in turn."""
    plans, taken, loads = {r.plan.source: r.plan for r in table.collect()}, Counter(), Counter()
    streams = defaultdict(list)
    for r in numbered.collect():
        for k in range(r.copies):
            streams[r.source].append((r.first + k * r.size, r.size, (r.h, r.own.id, k)))
    for source, docs in streams.items():
        p, owner = plans[source], []
        for first, size, key in sorted(docs, key=lambda d: (d[0], d[1])):
            assert first == len(owner) or not size  # documents follow each other without a gap
            owner += [key] * size
        assert len(owner) == p.source_size
        order = sorted(range(p.blocks), key=lambda b: (p.factor * b + p.shift) % p.blocks)
        dealt = [b for b in order * 3][: p.ends[-1]]
        for at, b in enumerate(dealt):
            shard = next(i for i, end in enumerate(p.ends) if at < end)
            loads[source, shard] += 1
            for key in owner[b * p.block_words : (b + 1) * p.block_words]:
                taken[key] += 1
    return taken, loads


def mixture_rows(spark, edge):
    """Two sources of a few thousand words beside the edge rows, so that there are several shards and blocks of many words."""
    rng = random.Random(11)
    more = [(1000 + i, " ".join(words(rng, rng.randint(0, 400))), ["big", "other"][i % 4 == 0]) for i in range(150)]
    return edge.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)


def test_mixture(spark, edge, nothing):
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = mixture_rows(spark, edge)
    rows = mixing.taken(docs, shards=7)
    got = rows.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, size(r.text)) for r in docs.select("doc_id", "text").collect())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = defaultdict(int)
    for r in got:
        by[r.source_size, r.target] += r.taken
    # a source's words come near its target: within a block or two
    assert all(abs(n - t) <= 2 * -(-s // mixing.BLOCKS) for (s, t), n in by.items())
    again = mixing.taken(docs.repartition(5), shards=7).select("doc_id", "taken", "n_shards", "first_shard")
    assert bag(again, *again.columns) == bag(rows, *again.columns)
    assert mixing.taken(nothing).count() == 0
    mixed = mixing.mixture(docs, shards=7)
    assert mixed.columns == docs.columns
    assert sum(size(r.text) for r in mixed.select("text").collect()) == sum(r.taken for r in got)
    assert mixing.mixture(nothing).count() == 0


def test_mixture_by_hand(spark, edge, monkeypatch):
    """Against every block dealt one by one; shards' loads are the tree's, and what the tree does not deal is not taken."""
    monkeypatch.setattr(mixing, "BLOCKS", 97)  # blocks of many words
    docs = mixture_rows(spark, edge)
    numbered, table, shards = mixing.placed(docs, shards=7)
    taken, loads = mixed_by_hand(numbered, table, shards)
    rows = mixing.taken(docs, shards=7).select("doc_id", "taken")
    want = Counter((r.own.id, taken[r.h, r.own.id, k]) for r in numbered.collect() for k in range(r.copies))
    assert bag(rows, "doc_id", "taken") == want
    plans = [r.plan for r in table.collect()]
    dealt = mixing.split_tree([p.ends[-1] for p in plans], 7, mixing.SEED)
    order = sorted(range(len(plans)), key=lambda i: (plans[i].source is None, plans[i].source or ""))
    assert [[loads[plans[i].source, s] for i in order] for s in range(7)] == mixing.split_tree([plans[i].ends[-1] for i in order], 7, mixing.SEED).tolist()
    assert dealt.sum() == sum(loads.values())
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, seed: np.zeros((shards, len(quotas)), np.int64))
    assert mixing.taken(docs, shards=7).where("taken > 0").count() == 0


def test_splitting_tree():
    quotas = [0, 1, 500, 70_000]
    dealt = mixing.split_tree(quotas, 13, 5)
    assert dealt.sum(0).tolist() == quotas and np.ptp(dealt.sum(1)) <= 13
    assert (dealt == mixing.split_tree(quotas, 13, 5)).all()
    # a source's share of a shard is its share of all, as drawn without replacement
    assert abs(dealt[:, 3] / dealt.sum(1) - 70_000 / 70_501).max() < 0.01


def test_targets_are_shared_anew():
    assert mixing.targets([10, 1000, 1000], (3, 1, 2)) == pytest.approx([20, 2995 / 3, 2 * 2995 / 3])


def test_rule_ablations(edge):
    rows = quality_rules.ledger(edge)
    masks = [r.failed for r in rows.select("failed").collect()]
    all_bits = quality_rules.bits("text", 1)
    for r in quality_rules.ablations(rows, "text", 1).collect():
        b = 1 << next(x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(m & b > 0 for m in masks), sum(m & all_bits == b for m in masks), sum(m & all_bits & ~b == 0 for m in masks))


def test_decontamination_keeps_columns(spark, edge, nothing):
    items = edge.where("doc_id = 16").selectExpr("1L as item_id", "text")
    left = decontamination.clean(edge, items)
    assert left.columns == edge.columns
    assert {r.doc_id for r in edge.select("doc_id").collect()} - {r.doc_id for r in left.select("doc_id").collect()} == {16, 19, 22}
    assert decontamination.clean(nothing, items).count() == 0
    assert decontamination.clean(edge, items.where("false")).count() == edge.count()


def test_sharding_of_nothing(nothing):
    assert sharding.round_trip(nothing).count() == 0
