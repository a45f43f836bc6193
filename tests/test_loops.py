"""What SQL cannot state: rounds of universes, fitted heads, sinks, providers, components and ladders, against plain Python."""

import json
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wobble.functions import expr as E
from wobble.functions import text as X
from wobble.operators import audits, cells, clustering, heads, ladders, universes
from wobble.sources import providers, records, sinks


def bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# universes


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]


def rewording(question, role, sample):
    """A deterministic generator: some words left out, some repeated, now and then the question itself."""
    w = question.split()
    k = (len(role) * 3 + sample * 5) % (len(w) + 3)
    if k == len(w):
        return question.upper() if sample % 2 else question
    if k > len(w):
        return " ".join(w[: len(w) // 2])
    return " ".join(w[:k] + w[k + 1 :] + (["really"] if sample % 2 else []))


def entail(p, h):
    a, b = set(p.lower().split()), set(h.lower().split())
    return len(a & b) / len(b) if b else 0.0


def admits(text):
    return len(text) % 7 != 0


def universe_by_hand(questions, target, samples, most, strict, relaxed, apart):
    """The same rounds for one question at a time."""
    out, state = Counter(), {}
    for qid, q in questions:
        raw, kept, gone, attempts = [], [], [], 0

        def judged(c, threshold, identity):
            t = c["text"]
            fwd, bwd = entail(q, t), entail(t, q)
            if identity and t.strip().lower() == q.strip().lower():
                return "exact_duplicate", fwd, bwd
            if min(fwd, bwd) < threshold:
                return ("nli_one_direction" if max(fwd, bwd) >= threshold else "nli_low"), fwd, bwd
            return (None if admits(t) else "constraint_mismatch"), fwd, bwd

        def thinned(pool):
            pool = sorted(pool, key=lambda c: (-min(c["fwd"], c["bwd"]), c["pos"]))
            keep, drop = [], []
            for c in pool:
                near = [edits(k["text"], c["text"]) for k in keep]
                if not c["text"].strip() or any(d < apart for d in near):
                    drop.append(c)
                else:
                    keep.append(c)
            for c in drop:
                least = min((edits(k["text"], c["text"]) for k in keep), default=9)
                gone.append((c, "exact_duplicate" if least == 0 else "edit_distance_close"))
            return keep

        full = False
        for first in range(0, most, samples):
            attempts += 1
            new = [dict(role=r, sample=s, pos=s * len(X.PERSONAS) + i, text=rewording(q, r, s)) for i, r in enumerate(X.PERSONAS) for s in range(first, first + samples)]
            raw += new
            for c in new:
                reason, c["fwd"], c["bwd"] = judged(c, strict, True)
                if reason:
                    gone.append((c, reason))
                else:
                    kept.append(c)
            kept = thinned(kept)
            if len(kept) >= target:
                full = True
                break
        threshold = strict
        if not full:
            threshold, gone, kept = relaxed, [(c, r) for c, r in gone if r in universes.LASTING], []
            for c in raw:
                reason, *_ = judged(c, relaxed, False)
                if reason:
                    gone.append((c, reason))
                else:
                    kept.append(c)
            kept = thinned(kept)
        for i, c in enumerate(kept[:target]):
            out[qid, "accepted", i, c["role"], c["sample"], c["text"], None] += 1
        for c, r in gone:
            out[qid, "rejected", None, c["role"], c["sample"], c["text"], r] += 1
        state[qid] = (attempts, threshold, not full and len(kept) < target)
    return out, state


def test_universes_equal_rounds_by_hand(spark):
    rng = random.Random(4)
    questions = [(f"q{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 9)))) for i in range(7)]
    rows = spark.createDataFrame(questions, "question_id string, question string")
    generate = lambda r: r.withColumn("text", F.pandas_udf(lambda q, role, s: pd.Series([rewording(*x) for x in zip(q, role, s)]), "string")("question", "role", "sample_idx")).drop("messages", "persona")
    nli = lambda p: p.select("premise", "hypothesis", F.pandas_udf(lambda a, b: pd.Series([entail(*x) for x in zip(a, b)]), "double")("premise", "hypothesis").alias("entail"))
    votes = lambda c: universes.admitted(c.select("question_id", "text", (F.length("text") % 7 != 0).alias("vote")))
    built, state = universes.build(rows, generate, nli, votes, target=5, samples=1, most=3, strict=0.95, relaxed=0.7, edits=4)
    want, want_state = universe_by_hand(questions, 5, 1, 3, 0.95, 0.7, 4)
    assert bag(built, "question_id", "outcome", "paraphrase_idx", "role", "sample_idx", "text", "reason") == want
    assert {r.question_id: (r.attempts, r.threshold, r.dropped) for r in state.collect()} == want_state
    assert {x[1] for x in want} == {"accepted", "rejected"} and len({s[2] for s in want_state.values()}) == 2
    whole = universes.singletons(rows, built)
    assert bag(whole.where("outcome <> 'rejected'"), "question_id").keys() == {(q,) for q, _ in questions}


def test_flattened_sets(spark):
    sets = spark.createDataFrame([("q", [(0, "a")], [("b", "nli_low")]), ("r", [], [])], "question_id string, accepted array<struct<paraphrase_idx: int, text: string>>, rejected array<struct<text: string, reason: string>>")
    assert bag(universes.flattened(sets), "question_id", "outcome", "paraphrase_idx", "text", "reason") == Counter([("q", "accepted", 0, "a", None), ("q", "rejected", None, "b", "nli_low")])


def test_unknown_persona_is_an_error(spark):
    rows = spark.createDataFrame([("neutral",), ("pirate",)], "role string")
    assert rows.where("role = 'neutral'").select(universes.persona(F.col("role"))).first()[0] == X.PERSONAS["neutral"]
    with pytest.raises(Exception, match="unknown role pirate"):
        rows.select(universes.persona(F.col("role"))).collect()


# heads


def probe_rows(spark, n=240, dims=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)) * [1, 2, 5, 1] + [0, 1, 0, 3]
    y = x @ [1.0, -0.5, 0.1, 0.0] + rng.standard_normal(n)
    q = [f"q{i // 4}" for i in range(n)]
    rows = [(i, q[i], x[i].tolist(), float(y[i]), int(y[i] > 0), len(q[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "i int, q string, x array<double>, v double, b int, len int")


def test_ridge_and_logistic_heads_equal_numpy(spark):
    x, y, rows = probe_rows(spark)
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    head = heads.fitted(rows.withColumnRenamed("v", "y"), False, 30.0)
    w = np.linalg.solve(z.T @ z + 30 * np.eye(4), z.T @ (y - y.mean()))
    assert np.allclose(head.model.coefficients.toArray(), w, atol=1e-6) and abs(head.model.intercept - y.mean()) < 1e-6
    head = heads.fitted(rows.withColumnRenamed("b", "y"), True, 0.05)
    t, a = (y > 0).astype(float), np.zeros(5)
    zz = np.c_[z, np.ones(len(z))]
    for _ in range(60):  # Newton steps of the same objective
        p = 1 / (1 + np.exp(-zz @ a))
        reg = np.array([1, 1, 1, 1, 0]) / 0.05
        a -= np.linalg.solve((zz * (p * (1 - p))[:, None]).T @ zz + np.diag(reg), zz.T @ (p - t) + reg * a)
    assert np.allclose([*head.model.coefficients.toArray(), head.model.intercept], a, atol=1e-3)


def test_a_head_is_checked_calibrated_saved_and_loaded(spark, tmp_path):
    x, y, rows = probe_rows(spark)
    head = heads.train("vagueness", rows.withColumnRenamed("v", "y"), ["i"], "q", binary=True, strength=0.1, n_splits=2, length="len")
    assert head.cut is not None and 0.75 < head.checks["quality"] <= 1 and abs(head.checks["permuted"] - 0.5) < 0.25
    assert 0 <= head.checks["ece"] < 0.3 and head.checks["n"] == 240 and head.checks["questions"] == 60 and head.checks["length"] >= 0.5
    got = heads.gauges(rows, [head]).orderBy("i").select("vagueness").toPandas().vagueness.to_numpy()
    assert got.min() >= 0 and got.max() <= 1
    raw = head.scored(rows).orderBy("i").select("score").toPandas().score.to_numpy()
    assert (np.diff(got[np.argsort(raw, kind="stable")]) >= -1e-12).all()
    heads.save([head], spark, str(tmp_path / "m"))
    again = heads.load(spark, str(tmp_path / "m"))
    assert np.allclose(heads.gauges(rows, again).orderBy("i").select("vagueness").toPandas().vagueness, got)
    line = heads.train("reliability", rows.withColumnRenamed("v", "y"), ["i"], "q", binary=False, strength=10.0, n_splits=2)
    assert line.checks["quality"] > 0.6


def test_nested_strengths(spark):
    _, _, rows = probe_rows(spark, 120)
    split = heads.folded(rows.withColumnRenamed("v", "y"), "q", 2, 1).select("i", "q", "x", "y", "fold")
    score, picked = heads.nested(split, ["i"], "q", False, (1.0, 1e5), inner=2)
    assert score > 0.5 and set(picked) == {0, 1}


def test_folds_keep_groups_whole(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 23).alias("g"))
    folds = heads.group_folds(rows, "g", 4, 5)
    assert sorted(Counter(r.fold for r in folds.collect()).values()) == [5, 6, 6, 6]


# sinks, memo and providers


def test_appending_sinks(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, at int, v string"
    assert sinks.newest(spark, path, schema, ["k"], ["at"]).count() == 0
    sinks.append(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema), path)
    sinks.append(spark.createDataFrame([("a", 2, "z")], schema), path)
    assert bag(sinks.newest(spark, path, schema, ["k"], ["at"]), "k", "v") == Counter([("a", "z"), ("b", "y")])
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.parquet").write_bytes(b"torn")
    assert sinks.newest(spark, str(bad), schema, ["k"], ["at"]).count() == 0
    with pytest.raises(Exception):
        sinks.newest(spark, str(bad), schema, ["k"], ["at"], strict=True)
    sinks.append(spark.createDataFrame([("a", 3, "p")], schema), str(tmp_path / "by"), ["k"])
    assert (tmp_path / "by" / "k=a").is_dir()
    for v in ("one", "two"):
        sinks.replace(spark.createDataFrame([("a", 1, v)], schema), str(tmp_path / "whole"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "whole")).collect()] == ["two"]


def test_logs_of_records(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "q string, level int, f double"
    sinks.log(spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2)], schema), path, 1)
    sinks.log(spark.createDataFrame([("a", 1, 0.9)], schema), path, 2)
    (tmp_path / "log" / "run=000000001" / "torn.json").write_text('{"q": "b", "lev')
    got = sinks.logged(spark, path, schema + ", run int", ["q", "level"])
    assert bag(got, "q", "level", "f") == Counter([("a", 0, 0.1), ("a", 1, 0.9)])


def test_half_precision(spark):
    rng = np.random.default_rng(1)
    v = [rng.standard_normal(8).astype(np.float32).tolist(), [0.0] * 8, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v array<float>").withColumn("b", sinks.half("v"))
    got = {r.i: (r.b, r.w) for r in rows.withColumn("w", sinks.whole("b", F.lit(8))).collect()}
    for i, x in enumerate(v[:2]):
        assert bytes(got[i][0]) == np.asarray(x, "<f2").tobytes() and np.allclose(got[i][1], np.asarray(x, "f2").astype("f4"))
    assert got[2] == (None, None)
    with pytest.raises(Exception, match="8 numbers where 7"):
        rows.where("i = 0").select(sinks.whole("b", F.lit(7))).collect()


def test_dump_problems(spark):
    good = np.zeros(4, "<f2").tobytes()
    odd = np.array([0, np.inf, 0, np.nan], "<f2").tobytes()
    row = lambda q, p, layer, vec=good, **kw: {"question_id": q, "spec_level": 0, "model_key": "m", "paraphrase_idx": p, "position": "tbg", "layer_idx": layer, "dim": 4, "dtype": "float16", "vec": vec} | kw
    schema = "question_id string, spec_level int, model_key string, paraphrase_idx int, position string, layer_idx int, dim int, dtype string, vec binary"
    found = lambda rows: bag(sinks.dump_problems(spark.createDataFrame(rows, schema)), "problem", "n")
    assert found([row("a", 0, 1), row("a", 1, 1), row("b", 0, 1)]) == Counter()
    assert found([row("a", 0, 1, odd), row("a", 1, 1, good[:6]), row("b", 1, 2, position="x")]) == Counter([("not_finite", 1), ("length", 1), ("position", 1), ("gaps", 1), ("layer_sets", 2)])
    assert found([row("a", 0, 1), row("a", 1, 1, good + good, dim=8, dtype="float32")]) == Counter([("dtype", 1), ("mixed_dims", 2)])


def test_memo_and_patience(spark, tmp_path):
    memo = providers.Memo(spark, str(tmp_path / "memo"))
    rows = spark.createDataFrame([(h, "p", "m", "x", json.dumps({"a": h})) for h in "abc"], "request_hash string, provider string, model_id string, purpose string, request_json string")
    assert memo.size() == 0
    assert memo.complete(rows.limit(2), providers.echo).where("cached").count() == 2
    assert memo.missing(rows).count() == 1 and memo.answered(rows).where("not cached").count() == 1
    memo.put(rows.limit(1).withColumn("response_json", F.lit("newer")))
    assert memo.size() == 2 and memo.rows().where("response_json = 'newer'").count() == 1
    calls = []

    def shaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("502 Bad Gateway")
        return batch

    waits = []
    assert providers.patient(shaky, sleep=waits.append)("x") == "x" and waits == [1.0, 2.0]
    for text, again in (("Internal Server Error", True), ("try again", False), ("connection refused", False), ("rate limit", False), ("Service Unavailable", True)):
        assert providers.retryable(RuntimeError(text)) == again
    assert providers.retryable(TimeoutError()) and providers.retryable(ConnectionError())
    now, slept = [0.0], []
    bucket = providers.Bucket(2, 2, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        bucket.take()
    assert sum(slept) == pytest.approx(1.0)


def test_scoring_providers(spark):
    pairs = spark.createDataFrame([("p", "one two"), ("p", "one two"), ("q", "x")], "prompt string, continuation string")
    score = lambda b: b.continuation.map(lambda t: [-1.0] * len(t.split()))
    assert bag(providers.continuations(pairs, score).select("prompt", F.size("token_logprobs").alias("n")), "prompt", "n") == Counter([("p", 2), ("q", 1)])
    with pytest.raises(ValueError):
        providers.continuations(pairs, score, able=False)
    texts = spark.createDataFrame([("ab",), ("ab",), ("abcd",)], "text string")
    encode = lambda b: b.text.map(lambda t: [float(len(t)), 0.0, 3.0])
    got = {r.text: r.embedding for r in providers.embedded(texts, encode, 3).collect()}
    assert np.allclose(got["abcd"], [0.8, 0, 0.6]) and len(got) == 2
    with pytest.raises(Exception, match="3 numbers where 4"):
        providers.embedded(texts, encode, 4).collect()
    nli = spark.createDataFrame([("g", "yes", 0.9, 0.0, 0.1)], "premise string, hypothesis string, entail double, contradict double, neutral double")
    samples = spark.createDataFrame([("c", 0, 0, "yes", ["g"]), ("c", 0, 1, "no", ["g"])], "cell string, par int, sample int, answer string, golds array<string>")
    para = spark.createDataFrame([("c", 0, "ab")], "cell string, par int, text string")
    row = providers.reconstructed(samples, para, nli, providers.embedded(texts, encode, 3), ["cell"]).first()
    assert (row.par, row.f) == (0, 0.5)


# clusters, ladders and golden values


def test_components_by_hand(spark):
    rng = random.Random(8)
    rows, links = [], []
    for c in range(12):
        names = [f"{c}-{i}" for i in range(rng.randint(1, 9))]
        rows += [(c, i, rng.choice(names)) for i in range(20)]
        links += [(c, *sorted(rng.sample(names, 2))) for _ in range(rng.randint(0, 6)) if len(names) > 1]
    samples = spark.createDataFrame(rows, "cell int, sample int, answer string")
    here = {(c, a) for c, _, a in rows}
    links = [(c, a, b) for c, a, b in links if (c, a) in here and (c, b) in here]
    out = clustering.clusters(samples, spark.createDataFrame(links, "cell int, a string, b string"), ["cell"], ["sample"])
    want = Counter()
    for c in range(12):
        root = {a: a for k, a in here if k == c}
        for k, a, b in links:
            if k == c:
                x, y = root[a], root[b]
                root = {n: (x if r == y else r) for n, r in root.items()}
        names = {}
        for k, i, a in sorted(r for r in rows if r[0] == c):
            want[c, i, names.setdefault(root[a], len(names))] += 1
    assert bag(out, "cell", "sample", "cluster") == want


def test_random_ladders_by_hand(spark):
    import hashlib

    para = [("t%d" % i, ["s"], i % 3 == 0) for i in range(10)]
    rows = spark.createDataFrame([(f"q{k}", para) for k in range(5)], "question_id string, paragraphs array<struct<title: string, sentences: array<string>, is_gold: boolean>>")
    got = {(r.question_id, r.ladder_type, r.level): r for r in ladders.all_ladders(rows).collect()}
    assert len(got) == 5 * 3 * 6
    for k in range(5):
        seed = 42 + (int.from_bytes(hashlib.sha256(f"q{k}".encode()).digest()[:4], "big") & 0x7FFFFFFF)
        order = list(range(10))
        random.Random(seed).shuffle(order)
        for level in (0, 2, 4, 6, 8, 10):
            r = got[f"q{k}", "random", level]
            assert r.paragraph_indices == order[:level] and r.gold_count == sum(i % 3 == 0 for i in order[:level])
            assert got[f"q{k}", "distractor_first", level].paragraph_indices == ([1, 2, 4, 5, 7, 8, 0, 3, 6, 9])[:level]


def test_token_distances(spark):
    rng = random.Random(2)
    pairs = [(" ".join(rng.choice("a b c Dd e".split()) for _ in range(rng.randint(0, 9))), " ".join(rng.choice("a b c dd f".split()) for _ in range(rng.randint(0, 9)))) for _ in range(60)] + [("the cat sat", "the dog sat"), ("", "hello world")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.d for r in rows.select("i", X.token_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert [got[i] for i in range(len(pairs))] == [edits(a.lower().split(), b.lower().split()) for a, b in pairs]


def test_answers_in_responses(spark):
    cases = {
        None: "", "": "", " \n \n": "", "Answer:": "", "**Final Answer:**": "", "Paris": "Paris",
        "Step.\nAnswer: Paris": "Paris", "**Answer**: Paris.": "Paris", "FINAL  ANSWER - \"Paris\"": "Paris", "> answer \u2014 *Paris*": "Paris",
        "Answer: Rome\nno\nAnswer: Paris": "Paris", "Answer:\r\n\r\n Paris\r\nend": "Paris", "Answer:\nfinal answer\nParis": "Paris",
        "I cannot tell.\n\nAnswer:": "I cannot tell", "So the final answer would be Paris. Or not": "Paris", "The answer is Rome.\nthe answer was: Paris": "Paris",
        "Answer: Rome\nAnswer:\n(Paris)": "Paris", "one\u2028two": "two", "Answer: \xa0\nParis": "Paris", "x" * 100_000 + "\nlast\n": "last", "the answer is\n": "the answer is",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    got = {r.i: r.a for r in rows.select("i", X.answer(F.col("text")).alias("a")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_replies_of_judges(spark):
    verdicts = {
        None: None, "": None, "maybe": None, " YES\n": True, "no": False, "true": True, "1": None, '"yes"': None, '{"valid": true}': True, '{"valid": " FALSE "}': False,
        '{"valid": 1}': None, '{"valid": null}': None, "{}": None, "[true]": None, '```json\n{"valid": false}\n```': False, '```{"valid": true}```': True,
        'Sure {"valid": false} thanks': False, '{"valid": true} thanks': None, 'a {"valid": true} b {"valid": true}': None, "```\nyes\n```": True, '{"valid": true}, 1': None,
    }
    lists = {
        None: [], "": [], "none": [], '{"answers": ["a", "b c"]}': ["a", "b c"], 'So {"answers": ["a", null, 42, 0.5, 100.0, true, ["b"], {"c": 1}]}.': ["a", "42", "0.5", "100.0", "True"], '{"answers": "a"}': [],
        '{"answers": [], "Answers": ["a"]}': ["a"], '{"answers": "x", "Answers": ["a"]}': [], '{"answers": null}': [], '["a"]': [], '{"answers": ["a"]': [], '```json\n{"Answers": ["\u00e9"]}```': ["\u00e9"],
    }
    rows = spark.createDataFrame([(i, *pair) for i, pair in enumerate(zip(list(verdicts), [*lists, *[None] * len(verdicts)]))], "i int, said string, listed string")
    got = rows.select("i", X.verdict(F.col("said")).alias("v"), X.listed_answers(F.col("listed")).alias("l")).orderBy("i").collect()
    assert [r.v for r in got] == list(verdicts.values()) and [r.l for r in got][: len(lists)] == list(lists.values())


def test_golden_values(spark):
    row = lambda *cols: spark.range(1).select(*cols).first()
    arr = lambda x: F.array(*(F.lit(float(v)) for v in x))
    a, b, c = row(E.rho_f(arr([0.1, 0.3, 0.9, 0.6, 0.2]), 10), E.rho_f(arr([0.5] * 10), 10), E.rho_f(arr([0] * 10), 10))
    assert a == pytest.approx(0.3375262054507337) and b == 0 and math.isnan(c)
    assert row(E.fi_premium(arr([0.1, 0.2, 0.3])), E.fi_premium(arr([0.6, 0.7, 0.5, 0.9])), E.fi_at(arr([1] + [0] * 29), 0.5)) == pytest.approx((0, math.log2(5), math.log2(30)))
    assert row(E.fi_spec(F.lit(4), F.lit(4)), E.fi_spec(F.lit(4), F.lit(1)), E.fi_spec(F.lit(0), F.lit(1)), E.b_emp(F.lit(8.0), F.lit(4.0))) == (0, 2, 0, 1)
    assert row(E.entropy(arr([2, 2])), E.entropy(arr([1, 1, 1])), E.entropy(arr([]).cast("array<double>"))) == pytest.approx((1, math.log2(3), 0))
    h = row(E.hazen(arr([3, 3, 1, 1]), arr([2.9, 2.9, 0.9, 0.9]), arr([3.1, 3.1, 1.1, 1.1])).alias("h")).h
    assert (h.plateaus, h.steps, h.locations, h.falling, h.fits) == (2, 1, [1], True, True)
    h = row(E.hazen(arr([3, 1, 3]), arr([0, 0, 2.9]), arr([4, 4, 3.1])).alias("h")).h
    assert (h.steps, h.falling, h.fits) == (0, False, False)
    counts = spark.createDataFrame([("c", 0, 0, 2, 0), ("c", 0, 1, 2, 1), ("c", 1, 0, 4, 0)], "cell string, par int, cluster int, n int, first int")
    out = cells.output_metrics(counts, ["cell"]).first()
    assert (out.h_sem_mean, out.fi_out_mean, out.a_q) == (0.5, 0.5, 2) and cells.consistency(counts, ["cell"]).first().consistency == 0.5
    assert heads_feedback(row, 0.7, 0.9, 0.1, 0.7) == [heads.MESSAGES["vagueness"], "Predicted answer reliability: HIGH (≈90%).", heads.MESSAGES["fragility"]]
    assert heads_feedback(row, 0.1, 0.9, 0.1, 0.1)[-1] == heads.MESSAGES["stable"] and heads_feedback(row, 0.5, None, None, None) == [heads.MESSAGES["possibly_vague"]]


def test_distances_of_distributions(spark):
    rows = [("c", 0, 0, 3), ("c", 0, 1, 1), ("c", 1, 1, 2), ("c", 1, 7, 2), ("d", 0, 4, 5), (None, 0, 0, 1)]
    counts = spark.createDataFrame(rows, "cell string, par int, cluster int, n long")
    shares = {(r.cell, r.par): r.shares for r in cells.proportions(counts, ["cell"], [1, 0, 9]).collect()}
    assert shares == {("c", 0): [0.25, 0.75, 0.0], ("c", 1): [0.5, 0.0, 0.0], ("d", 0): [0.0, 0.0, 0.0], (None, 0): [0.0, 1.0, 0.0]}
    far = {(r.cell, r.par): r.distance for r in cells.pool_distances(counts.where("cell is not null"), ["cell"]).collect()}
    assert far == {("c", 0): 0.375, ("c", 1): 0.375, ("d", 0): 0.0}
    arr = lambda *x: F.array(*map(F.lit, x))
    one = spark.range(1)
    assert tuple(one.select(E.total_variation(arr(0.5, 0.5), arr(0.5, 0.5)), E.total_variation(arr(1.0, 0.0), arr(0.0, 1.0)), E.total_variation(arr(0.5, 0.5), F.lit(None).cast("array<double>"))).first()) == (0.0, 1.0, None)
    with pytest.raises(Exception, match="distributions over 2 and 1"):
        one.select(E.total_variation(arr(0.5, 0.5), arr(1.0))).collect()


def heads_feedback(row, *gauges):
    return row(heads.feedback(*(F.lit(g).cast("double") for g in gauges)).alias("f")).f


def test_cells_without_clusters_have_no_entropy(spark):
    samples = spark.createDataFrame([("c", p, s, int(s > p), None) for p in range(3) for s in range(4)], "cell string, par int, sample int, y int, cluster int")
    r = cells.metric_rows(samples, ["cell"], bootstrap=20).first()
    assert (r.h_sem_mean, r.a_q, r.consistency, r.variation_ratio, r.ess_in, r.posix_psi) == (0.0, 1, 1.0, None, None, None)
    assert len(r.ci_low) == len(r.ci_high) == len(r.curve) == 21 and all(a <= b for a, b in zip(r.ci_low, r.ci_high))


def test_wide_rows_of_questions(spark):
    f = audits.filled_mean(F.lit(0.01), F.lit(10), F.lit(None).cast("double"))
    g = audits.filled_mean(F.lit(3.4), F.lit(10), F.lit(None).cast("double"))
    h = audits.filled_mean(F.lit(1.0), F.lit(10), F.lit(None).cast("double"))
    assert tuple(spark.range(1).select(f, g, h).first()) == (1.0, 0.0, 0.5)
    rows = spark.createDataFrame([(4, 0.5, None), (4, 0.5, 1.5)], "m0 int, h double, s double")
    assert [r[0] for r in rows.select(audits.fixed_information(F.col("s"), F.col("m0"), F.col("h"))).collect()] == [1.5, 1.5]
    with pytest.raises(ValueError, match="missing"):
        audits.gate(rows, "m0", 0, 1, {"absent": ">"}, {})
    assert [r.m0 for r in audits.explored(rows.withColumn("q", F.lit("a")), "q", "a", "h").collect()] == [4, 4]


def test_joined_labels(spark):
    prompts = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "question_id string, paraphrase_idx int")
    metrics = spark.createDataFrame([("a", [0.1, 0.2], 7.0)], "question_id string, f array<double>, h double")
    assert bag(heads.joined_label(prompts, metrics, ["question_id"], "f"), "question_id", "paraphrase_idx", "f") == Counter([("a", 0, 0.1), ("a", 1, 0.2), ("b", 0, None)])
    assert bag(heads.joined_label(prompts, metrics, ["question_id"], "h"), "question_id", "h") == Counter({("a", 7.0): 2, ("b", None): 1})


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "musique_dev.jsonl").write_text('{"id": "1", "question": "q"}\n\n{"id": "2", "question": "r"}\n')
    names = records.local_names(str(tmp_path), "validation")
    assert records.first_existing(spark, names) == names[-1]
    assert records.read_lines(spark, names[-1], records.DECOMPOSED).count() == 2
    with pytest.raises(FileNotFoundError):
        records.first_existing(spark, names[:-1])
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n{"id"\n')
    with pytest.raises(Exception):
        records.read_lines(spark, str(tmp_path / "bad.jsonl"), records.DECOMPOSED).collect()
    raw = spark.createDataFrame([("1", "q", "a", "t", None, (["x"], [["s"], ["t"]]), (["x"], [0]))], records.PAIRED)
    with pytest.raises(Exception, match="differ in length"):
        records.paired(raw, "d").collect()


def test_groups_of_copies_are_regold(spark):
    rows = [("1", "q", "a", "t", None, (["x", "x", "y"], [["s"], ["u"], ["v"]]), (["x", "x"], [0, 1]))]
    out = records.paired(spark.createDataFrame(rows, records.PAIRED), "d").first()
    assert [p.is_gold for p in out.paragraphs] == [True, True, False]

