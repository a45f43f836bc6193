"""Model outputs behind a memo: a provider is a function of a batch of requests, called only for what the memo lacks.

Requests have ``request_hash, provider, model_id, purpose, request_json``; the memo adds ``response_json, created_at``.
Providers run in Arrow batches on executors. Offline, :func:`echo` and :func:`overlap` are deterministic stand-ins.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import BarrierTaskContext, TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_set
from ..operators.relational import last_wins

MEMO = "request_hash string, provider string, model_id string, purpose string, request_json string, response_json string, created_at timestamp"
# Parts of error messages after which a call is worth another try.
TRANSIENT = (
    "server connection error", "connection error", "bad gateway", "service unavailable", "gateway timeout", "temporarily unavailable",
    "overloaded", "internal server error", "502", "503", "504", "timeout",
)
FIELDS = [c.split()[0] for c in MEMO.split(", ")]
Provider = Callable[[pd.DataFrame], pd.Series]


def bucket(digits: int) -> Column:
    """A request's bucket: the first digits of its hash, behind a letter that keeps them text."""
    return F.concat(F.lit("b"), F.substring("request_hash", 1, digits))


class Keeper:
    """Writes batches of answers as files below a memo's path, from a task; ``job`` names the call that asks."""

    def __init__(self, path: str, job: str, digits: int):
        self.store, self.base = fs.FileSystem.from_uri(path)
        self.digits = digits
        context = TaskContext.get()
        self.name, self.again = f"{job}-{context.partitionId()}-", context.attemptNumber() > 0

    def unknown(self, frame: pd.DataFrame) -> pd.DataFrame:
        """The requests that an attempt before this one, of the same task, has not kept."""
        if not self.again or not len(frame):
            return frame
        buckets = {f"b{h[: self.digits]}" for h in frame.request_hash}
        files = [f.path for b in buckets for f in self.store.get_file_info(fs.FileSelector(f"{self.base}/bucket={b}", allow_not_found=True)) if f.base_name.startswith(self.name)]
        kept = {h for f in files for h in pq.read_table(f, filesystem=self.store, columns=["request_hash"], partitioning=None)["request_hash"].to_pylist()}
        return frame[~frame.request_hash.isin(kept)]

    def add(self, answers: pd.DataFrame) -> None:
        """Each bucket's answers as a file, which has its name only once it is whole."""
        answers = answers.assign(created_at=pd.Timestamp.now(tz="UTC"))[FIELDS]
        for b, own in answers.groupby("b" + answers.request_hash.str[: self.digits]):
            at = f"{self.base}/bucket={b}"
            self.store.create_dir(at, recursive=True)
            name = f"{self.name}{uuid.uuid4().hex}.parquet"
            pq.write_table(pa.Table.from_pandas(own, SCHEMA, preserve_index=False), f"{at}/_{name}", filesystem=self.store)
            self.store.move(f"{at}/_{name}", f"{at}/{name}")


SCHEMA = pa.schema([(c, pa.timestamp("us", "UTC") if c == "created_at" else pa.string()) for c in FIELDS])


def retryable(error: Exception) -> bool:
    return isinstance(error, TimeoutError | ConnectionError) or any(p in str(error).lower() for p in TRANSIENT)


def patient(provider: Provider, tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """The provider, tried again after transient errors with growing pauses."""

    def call(batch: pd.DataFrame) -> pd.Series:
        for attempt in range(tries):
            try:
                return provider(batch)
            except Exception as e:
                if attempt == tries - 1 or not retryable(e):
                    raise
                sleep(wait * 2**attempt)
        raise ValueError("tries must be positive")

    return call


class Bucket:
    """A token bucket: at most ``rate`` calls a second on average and ``capacity`` at once, for one task."""

    def __init__(self, rate: float, capacity: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.capacity, self.clock, self.sleep = rate, capacity, clock, sleep
        self.tokens, self.at = capacity, clock()

    def take(self, n: float = 1.0) -> None:
        while True:
            now = self.clock()
            self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now
            if self.tokens >= n:
                self.tokens -= n
                return
            self.sleep((n - self.tokens) / self.rate)


def leased(frames: Iterator[pd.DataFrame], ask: Callable[[pd.DataFrame], pd.DataFrame], rate: float, window: float = 1.0) -> Iterator[pd.DataFrame]:
    """What ``ask`` makes of a task's requests, with at most ``rate`` requests a second among all tasks of a barrier stage.

    Time goes in windows (Spark's barriers take up to a second). At each, tasks tell each other whether they have requests
    left, and those that have share what the time since the last one allows; what a share leaves of a whole request is
    carried on. A window lasts until the slowest task's calls are back, and time beyond four windows is not made up for.
    """
    context, credit, before = BarrierTaskContext.get(), 0.0, None
    source = (f for f in frames if len(f))
    rest = next(source, None)
    while True:
        active = sum(map(int, context.allGather("0" if rest is None else "1")))
        now = time.monotonic()
        if not active:
            return
        passed, before = window if before is None else min(now - before, 4 * window), now
        credit = 0.0 if rest is None else credit + rate * passed / active
        while rest is not None and credit >= 1:
            n = min(int(credit), len(rest))
            yield ask(rest.iloc[:n])
            credit, rest = credit - n, rest.iloc[n:] if n < len(rest) else next(source, None)
        time.sleep(max(0.0, window / 2 - (time.monotonic() - now)))


class Memo:
    """The memo at ``path``: files are only added; of rows with one hash the latest counts.

    Answers lie in buckets by the first ``digits`` of their hashes, so a call reads only the buckets that its requests fall in; a
    memo keeps the number of digits that it began with.
    A batch of answers is a file that is there as soon as the provider has given them: a job that fails later, or a lost
    task, loses the batch that it was asking for and no other.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 1):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    def _read(self, requests: DataFrame | None = None) -> DataFrame:
        try:
            found = self.spark.read.schema(f"{MEMO}, bucket string").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], f"{MEMO}, bucket string")
        if requests is not None:
            wanted = requests.select("request_hash").distinct()
            buckets = [r.b for r in wanted.select(bucket(self.digits).alias("b")).distinct().collect()]  # 16 per digit at most
            found = found.where(F.col("bucket").isin(buckets)).join(wanted, "request_hash", "left_semi")
        return last_wins(found.drop("bucket"), ["request_hash"], ["created_at", "response_json"])

    def rows(self) -> DataFrame:
        return self._read()

    def size(self) -> int:
        return self.rows().count()

    def put(self, rows: DataFrame) -> None:
        rows.withColumn("created_at", F.current_timestamp()).select(*FIELDS, bucket(self.digits).alias("bucket")).write.mode("append").partitionBy("bucket").parquet(self.path)

    def missing(self, requests: DataFrame) -> DataFrame:
        return requests.join(self._read(requests).select("request_hash"), "request_hash", "left_anti").dropDuplicates(["request_hash"])

    def answered(self, requests: DataFrame) -> DataFrame:
        """Requests with their responses; ``cached`` says whether there is one."""
        known = self._read(requests).select("request_hash", "response_json")
        return requests.join(known, "request_hash", "left").withColumn("cached", F.col("response_json").isNotNull())

    def complete(self, requests: DataFrame, provider: Provider, batch: int = 256, rate: float | None = None, tasks: int = 4) -> DataFrame:
        """Asks the provider for what is missing, ``batch`` requests at a time, keeps each batch, and returns all requests answered.

        With a ``rate``, ``tasks`` tasks that run side by side share so many requests a second.
        """
        path, digits, job = self.path, self.digits, uuid.uuid4().hex
        names = [c for c in FIELDS if c not in ("created_at", "response_json")]

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keeper = Keeper(path, job, digits)

            def ask(b: pd.DataFrame) -> pd.DataFrame:
                keeper.add(b.assign(response_json=list(provider(b))))
                return pd.DataFrame({"n": [len(b)]})

            parts = (b.iloc[i : i + batch] for f in frames for b in [keeper.unknown(f)] for i in range(0, len(b), batch))
            yield from leased(parts, ask, rate) if rate else map(ask, parts)

        missing = self.missing(requests).select(*names)
        # a task's requests are of few buckets, so that its batches are few files
        missing = missing.repartition(tasks) if rate else missing.repartition(bucket(digits)).sortWithinPartitions("request_hash")
        missing.mapInPandas(work, "n long", barrier=bool(rate)).agg(F.sum("n")).collect()
        return self.answered(requests)

    def for_purpose(self, purpose: str, schema: str) -> DataFrame:
        """Parsed responses of one purpose; those that do not parse are left out."""
        parsed = self.rows().where(F.col("purpose") == purpose).select("request_hash", F.from_json("response_json", schema).alias("r"))
        return parsed.where(F.col("r").isNotNull() & F.coalesce(*[F.col(f"r.{n}").cast("string") for n in parsed.schema["r"].dataType.names]).isNotNull()).select("request_hash", "r.*")


def continuations(pairs: DataFrame, score: Provider, able: bool = True) -> DataFrame:
    """``prompt, continuation`` with ``token_logprobs`` (an array) by a provider that echoes prompts; one that cannot is an error.

    Unlike answers, scores are asked for once: a failure is the caller's to see.
    """
    if not able:
        raise ValueError("this provider does not score given texts")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(token_logprobs=score(b))

    return pairs.select("prompt", "continuation").distinct().mapInPandas(work, "prompt string, continuation string, token_logprobs array<double>")


def embedded(texts: DataFrame, encode: Provider, dims: int, normal: bool = True) -> DataFrame:
    """``text, embedding`` of each different text by a provider, of length 1 if ``normal``; another number of dimensions is an error."""
    import numpy as np

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(list(encode(b))).astype(np.float32) if len(b) else np.zeros((0, dims), np.float32)
            if x.shape[1] != dims:
                raise ValueError(f"embeddings of {x.shape[1]} numbers where {dims} were expected")
            if normal:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield b.assign(embedding=list(x))

    return texts.select("text").distinct().mapInPandas(work, "text string, embedding array<float>")


def reconstructed(samples: DataFrame, paraphrases: DataFrame, nli: DataFrame, embeddings: DataFrame, cell: list[str]) -> DataFrame:
    """A cell's paraphrases with the score and the vector that memos hold: ``cell, par, text, f, embedding``.

    ``samples`` have ``cell, par, sample, answer, golds``; ``paraphrases`` have ``cell, par, text``.
    """
    from ..operators.scoring import multi_gold

    f = multi_gold(samples, nli, [*cell, "par", "sample"]).groupBy(*cell, "par").agg(F.avg(F.col("f").cast("double")).alias("f"))
    return paraphrases.join(f, [*cell, "par"]).join(embeddings, "text").select(*cell, "par", "text", "f", "embedding")


def echo(batch: pd.DataFrame) -> pd.Series:
    """Answers each request with itself."""
    return batch.request_json


def overlap(pairs: DataFrame) -> DataFrame:
    """A stand-in for an entailment model over ``premise, hypothesis``: shared words of the hypothesis, in the JVM."""
    h, p = word_set(F.col("hypothesis")), word_set(F.col("premise"))
    share = F.when(F.size(h) > 0, F.size(F.array_intersect(h, p)) / F.size(h)).otherwise(0.0)
    return pairs.select("premise", "hypothesis", share.alias("entail"), ((1 - share) / 2).alias("contradict"), ((1 - share) / 2).alias("neutral"))


def token_logprob_tail(logprobs: str, n: str) -> Column:
    """Sum of the last ``n`` log-probabilities; 0 for none."""
    k = F.least(F.col(n), F.size(logprobs))
    return F.when(k <= 0, 0.0).otherwise(F.aggregate(F.slice(logprobs, -k, k), F.lit(0.0), lambda a, x: a + x))
