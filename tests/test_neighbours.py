"""Near pairs and ordered removal against loops over all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wobble.functions import text as X
from wobble.operators import neighbours, universes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, text, n, alphabet):
    text = list(text)
    for _ in range(n):
        at = rng.randint(0, len(text))
        kind = rng.randint(0, 2)
        if kind == 0:
            text.insert(at, rng.choice(alphabet))
        elif text and kind == 1:
            del text[min(at, len(text) - 1)]
        elif text:
            text[min(at, len(text) - 1)] = rng.choice(alphabet)
    return text


@pytest.fixture(scope="module")
def texts():
    """Addresses with one prefix, short texts, moved and changed ones, non-ASCII ones, in two groups and one without a name."""
    rng = random.Random(31)
    rows = []
    for g in ("a", "b", None):
        base = ["https://www.site.example/" + "".join(rng.choice("abcde/") for _ in range(rng.randint(0, 40))) for _ in range(25)]
        base += ["", "x", "xy", "xyz", "😀😀", "é" * 9, "é" * 8 + "e"]
        for t in base:
            rows += [(g, t), *((g, "".join(edited(rng, t, rng.randint(1, 7), "ab/😀"))) for _ in range(3))]
    rows += [("a", None), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("edits", [0, 1, 4, 5])
def test_near_pairs_equal_a_loop(spark, texts, edits):
    docs = spark.createDataFrame(texts, "g string, t string").repartition(5)
    got = {(r.g, *sorted((r.a, r.b))): r.distance for r in neighbours.near_pairs(docs, ["g"], "t", edits).collect()}
    groups = defaultdict(set)
    for g, t in texts:
        if t is not None:
            groups[g].add(t)
    want = {}
    for g, own in groups.items():
        own = sorted(own)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if abs(len(a) - len(b)) <= edits and (d := distance(a, b)) <= edits:
                    want[g, a, b] = d
    assert got == want


def test_near_pairs_of_words(spark):
    rng = random.Random(6)
    base = [[rng.choice("the a of to in it is he".split()) for _ in range(rng.randint(0, 14))] for _ in range(40)]
    rows = [" ".join(t) for b in base for t in (b, *(edited(rng, b, rng.randint(1, 4), ["so", "no"]) for _ in range(2)))]
    got = {tuple(sorted((r.a, r.b))): r.distance for r in neighbours.near_pairs(spark.createDataFrame([(t,) for t in rows], "t string"), [], "t", 2, words=True).collect()}
    own = sorted(set(rows))
    want = {(a, b): d for i, a in enumerate(own) for b in own[i + 1 :] if (d := distance(a.split(), b.split())) <= 2}
    assert got == want


def sequential(rows, edits):
    """Kept texts of each group, one after another."""
    first = {}
    for g, t, at in rows:
        if t is not None and t.strip():
            first[g, t] = min(first.get((g, t), at), at)
    kept = defaultdict(list)
    for (g, t), _ in sorted(first.items(), key=lambda x: (x[1], x[0][1])):
        if all(distance(t, k) > edits for k in kept[g]):
            kept[g].append(t)
    return {(g, t): t in kept[g] for g, t in first}


def test_removal_equals_the_sequential_loop(spark, texts):
    rng = random.Random(2)
    # a chain in which each text is near the next alone, so that rounds follow each other
    chain = ["a" * i + "b" * (40 - i) for i in range(0, 40, 3)]
    rows = [(g, t, rng.randint(0, 10_000)) for g, t in texts] + [("chain", t, i) for i, t in enumerate(chain)] + [("one", "alone", 1), ("one", "  ", 0)]
    docs = spark.createDataFrame(rows, "g string, t string, at int").repartition(4)
    got = {(r.g, r.text): r.kept for r in neighbours.spread_out(docs, ["g"], "t", ["at"], 4).collect()}
    assert got == sequential(rows, 4)


def by_arrays(rows, edits):
    """Place and reason of each candidate: a question's candidates one after another."""
    out, by = [], defaultdict(list)
    for r in rows:
        by[r["question_id"]].append(r)
    for q, own in by.items():
        kept = []
        for r in sorted(own, key=lambda r: (-min(r["nli_fwd"], r["nli_bwd"]), -(r["jaccard"] or 0), r["pos"])):
            near = [distance(k, r["text"]) for k in kept]
            if r["text"].strip() and all(d >= edits for d in near):
                out.append((q, r["pos"], len(kept), None))
                kept.append(r["text"])
            else:
                out.append((q, r["pos"], None, r))
        # what is not kept is held against all that are
        for i, (qq, pos, place, r) in enumerate(out):
            if qq == q and r is not None:
                least = min((distance(k, r["text"]) for k in kept), default=None)
                out[i] = (q, pos, None, "exact_duplicate" if least == 0 else "edit_distance_close")
    return sorted(out, key=repr)


@pytest.mark.parametrize("measure", [F.levenshtein, lambda a, b: F.levenshtein(a, b) + 0])
def test_candidates_of_a_question(spark, texts, measure):
    rng = random.Random(9)
    rows = [dict(question_id=g or "none", text=t or "", nli_fwd=rng.choice([0.9, 0.95, 1.0]), nli_bwd=0.97, jaccard=rng.choice([None, 0.5]), pos=i) for i, (g, t) in enumerate(texts)]
    schema = "question_id string, text string, nli_fwd double, nli_bwd double, jaccard double, pos int"
    survivors = spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("role", F.lit("x")).withColumn("sample_idx", F.col("pos"))
    got = universes.distinct_texts(survivors, 5, measure)
    assert sorted(((r.question_id, r.pos, r.place, r.reason) for r in got.collect()), key=repr) == by_arrays(rows, 5)


def test_word_distance_of_long_texts_is_worked_out_once(spark):
    a = " ".join(f"w{i}" for i in range(1500))
    b = a.replace("w7 ", "").replace("w900 ", "other ")
    row = spark.createDataFrame([(a, b), (a, None), ("", "x y")], "a string, b string").select(X.token_distance(F.col("a"), F.col("b")))
    assert [r[0] for r in row.collect()] == [2, None, 2]


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5, 1.0])
def test_overlapping_sets_equal_a_loop(spark, share):
    rng = random.Random(14)
    common, rows = [f"c{i}" for i in range(6)], []
    for g in ("a", "b", None):
        for i in range(60):
            own = set(rng.sample(common, rng.randint(0, 5))) | {f"r{rng.randint(0, 80)}" for _ in range(rng.randint(0, 6))}
            rows.append(((g,), f"k{i}", sorted(own)))
    sets = spark.createDataFrame(rows, "g struct<g: string>, k string, s array<string>").repartition(5)
    got = {(r.g.g, r.a, r.b) for r in neighbours.overlapping(sets, share).collect()}
    want = set()
    for i, (g, a, s) in enumerate(rows):
        for h, b, t in rows:
            if g == h and a < b and len(set(s) & set(t)) >= max(1, share * max(len(s), len(t)) - 1e-9) and s and t:
                want.add((g[0], a, b))
    assert got == want


@pytest.mark.parametrize("edits", [0, 1, 5])
def test_distances_of_a_batch_equal_a_loop(spark, edits):
    import pandas as pd

    rng = random.Random(1)
    pairs = [(a, "".join(edited(rng, a, rng.randint(0, 7), "ab/😀\0"))) for a in ("".join(rng.choice("ab/😀\0") for _ in range(rng.randint(0, 40))) for _ in range(300))]
    pairs = [(a, b) for a, b in pairs if 0 <= len(b) - len(a) <= edits] + [("", "")]
    got = neighbours._distances(edits).func(*(pd.Series(side) for side in zip(*pairs, strict=True)))
    assert [d if d <= edits else None for d in got] == [d if (d := distance(a, b)) <= edits else None for a, b in pairs]


def test_dense_texts_in_steps(spark):
    """Addresses of one host, all near each other: pairs between two flags, and removal in steps as one after another."""
    rng = random.Random(8)
    rows = [(i, f"http://a.example/en/{rng.randint(100, 99999)}" + "/long" * (30 if i % 9 == 0 else 0)) for i in range(48)]
    docs = spark.createDataFrame(rows, "i int, t string")
    order = [t for _, t in rows]
    kept = []
    for t in dict.fromkeys(order):
        if all(distance(k, t) > 4 for k in kept if abs(len(k) - len(t)) <= 4):
            kept.append(t)
    assert {r.text for r in neighbours.spread_out(docs, [], "t", ["i"], 4, steps=2).where("kept").collect()} == set(kept)
    flagged = docs.groupBy("t").agg((F.min("i") < 12).alias("early"))
    early = {r.t: r.early for r in flagged.collect()}
    got = {tuple(sorted((r.a, r.b))) for r in neighbours.near_pairs(flagged, [], "t", 4, between="early").collect()}
    own = sorted(early)
    assert got == {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if early[a] != early[b] and abs(len(a) - len(b)) <= 4 and distance(a, b) <= 4}
