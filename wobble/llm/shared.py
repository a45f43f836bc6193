"""Shared storage that the driver and all executors see, cut lineage through it, and joins that hot keys do not stop."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The session's own setting is used. Only where it is unset and the master is local (tests) does a
    folder of this machine take its place; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wobble-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.get().append((path, None))
    return path


#: Folders, and names in the catalog, that were written since the innermost :func:`scratch` began.
_written: ContextVar[list[tuple[str, str | None]]] = ContextVar("written", default=[])  # noqa: B039


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is stored inside is removed at the end, but for tables given to the function that this yields.

    A result that is read later must rest on such tables alone; they stay until the scratch around it ends, or for good.
    """
    outer, mine = _written.get(), []
    token = _written.set(mine)
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.shared_path)
        return df

    try:
        yield keep
    finally:
        _written.reset(token)
        for path, entry in mine:
            if path in kept:
                outer.append((path, entry))
            else:
                remove(spark, path, entry)


def remove(spark: SparkSession, path: str, entry: str | None = None) -> None:
    """Deletes a folder, and its name in the catalog."""
    if entry:
        spark.sql(f"DROP TABLE IF EXISTS {entry}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: work done once, safe from lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As :func:`stored`, in buckets of ``key``: joins by it read the table where it lies and shuffle only the other side.

    There are as many buckets as shuffle partitions, as a shuffle of the table would make. The files are in the shared
    folder; the table's entry in the session's catalog is a name for them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    entry = path.rsplit("/", 1)[1].replace("-", "_")
    _written.get()[-1] = (path, entry)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(entry)
    out = spark.table(entry)
    out.shared_path = path
    return out


#: A key is heavy with one row in so many, so there are no more heavy keys than that; and in how many parts one's rows are dealt.
HEAVY, SALTS = 1000, 64


def heavy_keys(left: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the keys, ``HEAVY`` at most, that hold more than one in ``HEAVY`` rows of a stored table."""
    counts = left.groupBy(F.xxhash64(*keys).alias("h")).agg(F.count("*").alias("n"))
    least = max(left.count() // HEAVY, HEAVY) + 1
    return [r.h for r in counts.where(F.col("n") >= least).select("h").collect()]


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", heavy: list[int] | None = None) -> DataFrame:
    """``left`` (stored) joined with ``right`` (a row per key at most), with no key's rows in one task.

    The heavy keys are found by counting, if they are not given. Their rows are dealt to ``SALTS`` parts, and their rows of
    ``right``, a thousand at most, go to all of those.
    """
    heavy = heavy_keys(left, keys) if heavy is None else heavy
    if not heavy:
        return left.join(right, keys, how)
    own = F.xxhash64(*keys).isin(heavy)
    part = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.lit(SALTS)).cast("int")
    parts = F.when(own, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = left.withColumn("_salt", F.when(own, part).otherwise(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(parts)), [*keys, "_salt"], how).drop("_salt")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def text_of(column: str = "text") -> Column:
    """The column as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a partition's batches; memory that it leaves unused goes back to the system, as workers are used again."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


#: Bytes of an Arrow batch that goes to a Python worker, at most (a longer row goes alone).
BATCH = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; its session's bound on Arrow batches is lowered to ``BATCH`` for good: texts vary too much for a bound on rows."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        conf.set(key, str(BATCH))
    return df
