"""Tables written to the folder that all executors share, where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a folder of this machine only for a local session that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wobble-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Ledger:
    """Tables of a long job below one folder, each written once: a job that is started again with the folder goes on where it was.

    A step counts as done once Spark's committer has marked its folder; what a lost driver left half written is written anew.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or shared_path(spark, "ledger")).rstrip("/")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at, self._fs = at, at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{name}/_SUCCESS"))

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name``; ``make`` is called only if it is not there."""
        if not self.done(name):
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def steps(self, names: list[str]) -> DataFrame:
        """The rows of several tables of one schema, as one scan."""
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/{names[0]}").schema).parquet(*(f"{self.path}/{n}" for n in names))


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` gave and that nothing reads any more."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
