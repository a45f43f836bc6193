"""What survives a lost driver, a failed batch or a crash between two moves; and a rate that tasks share."""

import random
import re
import time
from collections import Counter
from hashlib import sha256
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_loops import WORDS, bag, entail, rewording
from wobble.operators import universes
from wobble.operators.lineage import Ledger
from wobble.sources import providers, sinks

REQUEST = "request_hash string, provider string, model_id string, purpose string, request_json string"


def requests(spark, names):
    return spark.createDataFrame([(sha256(n.encode()).hexdigest(), "p", "m", "x", n) for n in names], REQUEST)


def test_answers_that_were_paid_for_are_kept(spark, tmp_path):
    """The last batch fails: what was answered before stays, and the next call asks for the rest alone."""
    log, path = tmp_path / "calls", str(tmp_path / "memo")
    log.mkdir()
    memo = providers.Memo(spark, path)
    names = [f"r{i}" for i in range(40)] + ["poison"]

    def provider(batch, bad="poison"):
        if (batch.request_json == bad).any():
            raise ValueError("no answer")
        for n in batch.request_json:
            (log / f"{n}-{time.time_ns()}").touch()
        return batch.request_json + "!"

    rows = requests(spark, names).coalesce(1)
    with pytest.raises(Exception, match="no answer"):
        memo.complete(rows, provider, batch=4)
    asked = {f.name.split("-")[0] for f in log.iterdir()}
    assert memo.size() == len(asked) == len(list(log.iterdir())) and 0 < len(asked) < 40
    assert bag(memo.missing(rows), "request_json").keys() == {(n,) for n in names} - {(n,) for n in asked}
    got = memo.complete(rows, lambda b: provider(b, None), batch=4)
    assert Counter(f.name.split("-")[0] for f in log.iterdir()) == Counter(names)  # nothing was asked for twice
    assert {r.request_json: r.response_json for r in got.collect()} == {n: n + "!" for n in names} and got.where("not cached").isEmpty()
    assert not [f for f in Path(path).rglob("_*.parquet")]


def test_only_the_buckets_asked_for_are_read(spark, tmp_path, capsys):
    memo = providers.Memo(spark, str(tmp_path / "memo"), digits=2)
    memo.complete(requests(spark, [f"r{i}" for i in range(300)]), providers.echo)
    one = requests(spark, ["r7"])
    capsys.readouterr()
    memo.answered(one).explain("formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (= |IN \()b" + one.first().request_hash[:2], capsys.readouterr().out)
    assert memo.answered(one).first().response_json == "r7"
    assert memo.answered(requests(spark, ["unknown"])).first().cached is False
    memo.put(one.withColumn("response_json", F.lit("later")))
    assert memo.answered(one).first().response_json == "later" and memo.size() == 300


def test_tasks_share_a_rate(spark, tmp_path):
    log, rate = tmp_path / "at", 160.0
    log.mkdir()

    def stamped(batch):
        for n in batch.request_json:
            (log / f"{time.time():.6f}-{n}").touch()
        return batch.request_json

    memo = providers.Memo(spark, str(tmp_path / "memo"))
    rows = requests(spark, [f"r{i}" for i in range(2400)])
    assert memo.complete(rows, stamped, rate=rate, tasks=4).where("cached").count() == 2400
    at = sorted(float(f.name.split("-")[0]) for f in log.iterdir())
    assert len(at) == 2400
    # a window's requests go out at its start: between the first and the last window's start are all but the last one's
    starts = [t for t, s in zip(at, [0.0, *at]) if t - s > 0.25]
    last = sum(t >= starts[-1] for t in at)
    assert 0.9 * rate <= (len(at) - last) / (starts[-1] - at[0]) <= 1.1 * rate


class Lost(Exception):
    pass


def test_a_universe_goes_on_after_a_lost_driver(spark, tmp_path):
    rng = random.Random(4)
    questions = [(f"q{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 9)))) for i in range(7)]
    rows = spark.createDataFrame(questions, "question_id string, question string")
    asked, dies = [], [None]

    def generate(r):
        asked.extend((x.question_id, x.role, x.sample_idx) for x in r.collect())
        return r.withColumn("text", F.pandas_udf(lambda q, role, s: pd.Series([rewording(*x) for x in zip(q, role, s)]), "string")("question", "role", "sample_idx")).drop("messages", "persona")

    def nli(p):
        if len(asked) and dies[0] is not None and asked[-1][2] == dies[0]:
            raise Lost
        return p.select("premise", "hypothesis", F.pandas_udf(lambda a, b: pd.Series([entail(*x) for x in zip(a, b)]), "double")("premise", "hypothesis").alias("entail"))

    votes = lambda c: universes.admitted(c.select("question_id", "text", (F.length("text") % 7 != 0).alias("vote")))
    build = lambda at: universes.build(rows, generate, nli, votes, target=5, samples=1, most=3, strict=0.95, relaxed=0.7, edits=4, ledger=at)
    columns = ("question_id", "outcome", "paraphrase_idx", "role", "sample_idx", "text", "reason")
    whole, state = build(str(tmp_path / "whole"))
    want, want_state, once = bag(whole, *columns), bag(state, *state.columns), Counter(asked)
    asked.clear()
    for round_ in (0, 1, 2):  # the driver is lost in each round, once its candidates are written
        dies[0] = round_
        with pytest.raises(Lost):
            build(str(tmp_path / "lost"))
    dies[0] = None
    again, state = build(str(tmp_path / "lost"))
    assert bag(again, *columns) == want and bag(state, *state.columns) == want_state
    assert Counter(asked) == once and max(once.values()) == 1  # no request was made twice


def test_a_half_written_step_is_written_anew(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"))
    (tmp_path / "book" / "a").mkdir(parents=True)
    (tmp_path / "book" / "a" / "part-0.parquet").write_bytes(b"torn")
    assert book.step("a", lambda: spark.range(3)).count() == 3
    assert book.step("a", lambda: spark.range(5)).count() == 3 and book.steps(["a"]).count() == 3


# replaced tables


def table_of(spark, path):
    return [r.v for r in spark.read.parquet(path).collect()]


@pytest.mark.parametrize("at", ["before", "between", "after"])
def test_a_replaced_table_survives_a_crash(spark, tmp_path, at):
    """A crash leaves the table in one of three states; a later call whose rows fail loses nothing."""
    path = tmp_path / "t"
    one = lambda v: spark.createDataFrame([(v,)], "v string")
    sinks.replace(one("old"), str(path))
    if at == "between":
        path.rename(tmp_path / "t.old")
    if at == "after":  # the new one is in place, the old one not yet removed
        one("older").write.parquet(str(tmp_path / "t.old"))
    (tmp_path / "t.new").mkdir()
    (tmp_path / "t.new" / "part").write_bytes(b"half")
    with pytest.raises(Exception, match="bad row"):
        sinks.replace(one("x").select(F.when(F.col("v") == "x", F.raise_error(F.lit("bad row"))).cast("string").alias("v")), str(path))
    assert table_of(spark, str(path)) == ["old"]
    sinks.replace(spark.read.parquet(str(path)).select(F.concat("v", F.lit("+new")).alias("v")), str(path))  # rows may read the table itself
    assert table_of(spark, str(path)) == ["old+new"] and sorted(f.name for f in tmp_path.iterdir()) == ["t"]


def test_a_lost_task_is_no_empty_table(spark, tmp_path):
    path = str(tmp_path / "n")
    sinks.append(spark.createDataFrame([("a", 1)], "k string, v int"), path)
    with pytest.raises(Exception):
        sinks.newest(spark, path, "k int, v int", ["k"], ["v"]).count()  # another type than the table's is an error, not an empty table
    sinks.recover(spark, str(tmp_path / "absent"))
    assert sinks.newest(spark, str(tmp_path / "absent"), "k string, v int", ["k"], ["v"]).count() == 0
