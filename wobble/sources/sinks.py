"""Sinks that only append: tables by partition, logs of records, sheets for raters, and vectors in half precision.

Nothing is read to be written again. What replaces an older row is a later one, found when the table is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import last_wins, seeded


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Adds rows to a table; columns that say in what order are the caller's."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


#: Signs of a table that is not there, or whose files are torn; any other error is raised.
ABSENT = ("[PATH_NOT_FOUND]", "[UNABLE_TO_INFER_SCHEMA]", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


def newest(spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], strict: bool = False) -> DataFrame:
    """The last row of each key. A table that is not there, or not to be read, is empty, unless ``strict``; a failed task is an error."""
    try:
        rows = spark.read.schema(schema).parquet(path)
        rows.limit(1).collect()
    except (PySparkException, Py4JJavaError) as e:
        known = any(sign in str(e) for sign in ABSENT)
        if strict or not known:
            raise
        rows = spark.createDataFrame([], schema)
    return last_wins(rows, key, order)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path's class."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def recover(spark: SparkSession, path: str) -> None:
    """Puts a table back that a crash left beside its place, so that what was there before is there again."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)) and fs.exists(at(f"{path}.old")) and not fs.rename(at(f"{path}.old"), at(path)):
        raise OSError(f"could not move {path}.old to {path}")


def replace(rows: DataFrame, path: str) -> None:
    """Writes a whole table beside the old one and moves it into place.

    The old table is removed only once the new one is in its place. If the driver is lost, or the new one cannot be
    written, the old one is at ``path``, or, between the two moves, at ``path.old``, from where :func:`recover` (which the
    next call begins with) takes it back. For that moment a reader finds no table: it should recover and read again.
    """
    spark = rows.sparkSession
    recover(spark, path)
    fs, at = _files(spark, path)
    fresh, old = f"{path}.new", f"{path}.old"
    fs.delete(at(fresh), True)
    rows.write.parquet(fresh)
    if fs.exists(at(path)):
        fs.delete(at(old), True)  # an older one still: the table is in its place
        if not fs.rename(at(path), at(old)):
            raise OSError(f"could not move {path} to {old}")
    if not fs.rename(at(fresh), at(path)):
        recover(spark, path)
        raise OSError(f"could not move {fresh} to {path}")
    fs.delete(at(old), True)


def log(rows: DataFrame, path: str, number: int) -> None:
    """Records of one run as JSON lines; the same run again replaces its own."""
    rows.write.mode("overwrite").json(f"{path}/run={number:09d}")


def logged(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """The last record of each key over all runs; lines that are torn are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return last_wins(rows.where(" and ".join(f"{k} is not null" for k in key)), key, ["run"])


def rater_sheet(rows: DataFrame, key: str, least: int, n: int, seed: int) -> DataFrame:
    """Rows of ``n`` keys that have ``least`` rows or more, in a seeded order of keys, with two blank columns for raters."""
    enough = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    picked = enough.orderBy(seeded(seed, key), key).limit(n)
    return rows.join(F.broadcast(picked), key).select("*", F.lit("").alias("rater_a"), F.lit("").alias("rater_b"))  # n rows


def sample_manifest(sample: DataFrame, dataset: str, strata: list[str]) -> tuple[DataFrame, DataFrame]:
    """A sample's ids by dataset and stratum, and how many each stratum has."""
    rows = sample.select(F.lit(dataset).alias("dataset"), "id", *strata)
    return rows, rows.groupBy("dataset", *strata).agg(F.count("*").alias("n"))


@F.pandas_udf(T.BinaryType())
def half(vector: pd.Series) -> pd.Series:
    """Numbers as little-endian 16-bit floats, end to end."""
    return vector.map(lambda v: np.asarray(v, "<f2").tobytes(), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def whole(data: pd.Series, dim: pd.Series) -> pd.Series:
    """The numbers of :func:`half`; another number of them than ``dim`` is an error."""

    def one(b: bytes | None, d: int) -> np.ndarray | None:
        if b is None:
            return None
        v = np.frombuffer(b, "<f2") if len(b) % 2 == 0 else np.zeros(0)
        if len(v) != d:
            raise ValueError(f"a vector of {len(v)} numbers where {d} were expected")
        return v.astype(np.float32)

    return pd.Series([one(b, d) for b, d in zip(data, dim, strict=True)], dtype=object)


def dump_problems(dump: DataFrame, position: str = "tbg") -> DataFrame:
    """``model_key, problem, n`` of a dump of hidden states (``question_id, spec_level, model_key, paraphrase_idx, position, layer_idx, dim, dtype, vec``).

    Checked are its constants, the length of each vector, one dimension and one set of layers per model, paraphrases
    numbered from 0 without a gap in each cell and layer, and finite numbers in every vector of the right length.
    """
    sized = F.octet_length("vec") == F.col("dim") * 2
    # the exponent bits of a 16-bit float are all set in infinities and NaNs
    words = F.sequence(F.lit(0), F.greatest(F.col("dim") - 1, F.lit(0)))
    high = lambda i: F.conv(F.hex(F.substring("vec", i * 2 + 2, F.lit(1))), 16, 10).cast("int")
    odd = F.exists(words, lambda i: high(i).bitwiseAND(F.lit(0x7C)) == 0x7C)
    flag = lambda name, c: F.struct(F.lit(name).alias("problem"), F.coalesce(c, F.lit(True)).alias("bad"))
    rows = F.array(flag("dtype", F.col("dtype") != "float16"), flag("position", F.col("position") != position), flag("length", ~sized), flag("not_finite", F.when(sized, odd).otherwise(False)))
    one = dump.select("model_key", F.inline(rows)).where("bad").groupBy("model_key", "problem").agg(F.count("*").alias("n"))
    dims = dump.groupBy("model_key").agg(F.count_distinct("dim").alias("n")).where("n > 1").select("model_key", F.lit("mixed_dims").alias("problem"), "n")
    cells = dump.groupBy("model_key", "question_id", "spec_level").agg(F.array_sort(F.collect_set("layer_idx")).alias("layers"))
    sets = cells.groupBy("model_key").agg(F.count_distinct("layers").alias("n")).where("n > 1").select("model_key", F.lit("layer_sets").alias("problem"), "n")
    i = F.col("paraphrase_idx")
    runs = dump.groupBy("model_key", "question_id", "spec_level", "layer_idx").agg((F.min(i) == 0).alias("a"), (F.max(i) + 1 == F.count("*")).alias("b"), (F.count_distinct(i) == F.count("*")).alias("c"))
    gaps = runs.where("not (a and b and c)").groupBy("model_key").agg(F.count("*").alias("n")).select("model_key", F.lit("gaps").alias("problem"), "n")
    return one.unionByName(dims).unionByName(sets).unionByName(gaps)


def layer_features(dump: DataFrame, key: list[str], layers: list[float], vector: str = "x") -> DataFrame:
    """``key, features``: the vectors of all wanted layers of a prompt, end to end in order; a prompt that lacks one is left out."""
    wanted = F.round("layer_frac", 4)
    some = dump.where(wanted.isin([round(f, 4) for f in layers])).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(wanted.alias("f"), F.col(vector).alias("v")))).alias("l"))
    return some.where(F.size(F.array_distinct("l.f")) == len(layers)).where(F.size("l") == len(layers)).select(*key, F.flatten("l.v").alias("features"))


def unit(vector: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(vector, lambda x: x / F.when(length > 0, length))).otherwise(F.transform(vector, lambda x: x.cast("double")))


def masked_mean(states: Column, mask: Column) -> Column:
    """The mean of the token vectors (an array of arrays) whose mask is 1; zeros if none is."""
    n = F.greatest(F.aggregate(mask, F.lit(0), lambda a, m: a + m), F.lit(1))
    weighted = F.zip_with(states, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    zero = F.transform(F.get(states, 0), lambda _: F.lit(0.0))
    total = F.aggregate(weighted, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)
