"""Size-tiered compaction of immutable shards under a versioned manifest (op 1).

A store is a folder of Parquet files, none of which ever changes, and of manifests ``_manifest/NNNNNNNNNN.json``.
Readers see the files that the newest manifest names. :meth:`ShardStore.append` writes an arrival as small shards
and commits a manifest with them added. :meth:`ShardStore.compact` merges runs of similar size: shards fall in
tiers by size (tier ``t`` holds sizes from ``floor * fan ** t``), and the shards of a tier that has ``fan`` of
them or more are packed, in order of size, into runs of up to the target size, each rewritten as one file by one
task with no shuffle. That is repeated until no tier is full.

A manifest names the files of ``_manifest/part-*.json``, up to ``PART`` shards each; a commit writes a part for what it
adds and rewrites only the parts that lose a shard, so its cost does not grow with the store. It ends with a rename
that fails if the version exists, so of two writers one wins and the other tries again on top. That needs a store whose
rename refuses an existing target (HDFS does, atomically); elsewhere let one writer at a time commit. A writer claims
its folder in ``_claims`` before it writes and gives the claim up after its commit; :meth:`ShardStore.vacuum` removes
only files that no manifest names and that nobody claims, or whose claim is older than ``CLAIM_S`` (a job that died).
What the driver holds is a row per shard, never of a document.

Defined results: rows are kept as they are, with nulls, repeats and all columns of whatever name; an empty
arrival adds no shard (only the schema is kept); an empty store reads as an empty table of its schema.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_dir, text_of

TARGET, FLOOR, FAN = 128 << 20, 1 << 20, 4
#: Runs that one job merges, and shards that a part of a manifest names.
RUNS, PART = 256, 4096
#: Seconds after which a claim no longer holds files back from :meth:`ShardStore.vacuum`.
CLAIM_S = 7 * 24 * 3600


class Conflict(Exception):
    """Another writer committed that version first."""


class ShardStore:
    """The store at ``path``; ``target`` and ``floor`` are bytes."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, floor: int = FLOOR, fan: int = FAN):
        self.spark, self.path, self.target, self.floor, self.fan = spark, path.rstrip("/"), target, floor, fan
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(conf)
        for name in ("_manifest", "_claims"):
            self.fs.mkdirs(self._path(f"{self.path}/{name}"))
        self._parts: dict[str, list[dict]] = {}

    # manifests

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/_manifest")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest by default, with its ``shards``; version 0 is the empty store."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return {"version": 0, "schema": None, "parts": [], "shards": []}
        m = self._json(self._name(version))
        return m | {"shards": [s for p in m["parts"] for s in self._part(p["name"])]}

    def _part(self, name: str) -> list[dict]:
        if name not in self._parts:  # a part never changes
            self._parts[name] = self._json(f"{self.path}/_manifest/{name}")
        return self._parts[name]

    def _json(self, path: str):
        stream = self.fs.open(self._path(path))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _put(self, path: str, value) -> None:
        out = self.fs.create(self._path(path), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _name(self, version: int) -> str:
        return f"{self.path}/_manifest/{version:010d}.json"

    def commit(self, before: dict, removed: set[str], added: list[dict], schema: str | None) -> dict:
        """The next manifest: all shards of ``before`` but ``removed``, and ``added``."""
        kept, left = [], []
        for p in before["parts"]:
            shards = self._part(p["name"])
            # parts that lose shards, and small ones, are written anew together
            if p["n"] < PART // 2 or removed and any(s["file"] in removed for s in shards):
                left += [s for s in shards if s["file"] not in removed]
            else:
                kept.append(p)
        left += added
        fresh = []
        for i in range(0, len(left), PART):
            fresh.append({"name": f"part-{uuid.uuid4().hex}.json", "n": len(left[i : i + PART])})
            self._put(f"{self.path}/_manifest/{fresh[-1]['name']}", left[i : i + PART])
        kept += fresh
        after = {"version": before["version"] + 1, "schema": before["schema"] or schema, "parts": kept}
        tmp = f"{self.path}/_manifest/.{uuid.uuid4().hex}"
        self._put(tmp, after)
        final = self._path(self._name(after["version"]))
        if self.versions()[-1:] > [before["version"]] or self.fs.exists(final) or not self.fs.rename(self._path(tmp), final):
            for name in (tmp, *(f"{self.path}/_manifest/{p['name']}" for p in fresh)):
                self.fs.delete(self._path(name), False)
            raise Conflict(after["version"])
        return self.manifest(after["version"])

    # shards

    def _write(self, df: DataFrame) -> list[dict]:
        """Files of a new claimed folder: path below the store, bytes, and how many files the folder has."""
        name = uuid.uuid4().hex
        self._put(f"{self.path}/_claims/{name}", time.time())
        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("maxRecordsPerFile", 0).parquet(f"{self.path}/data/{name}")
        if not rows.get["n"]:
            for left in (f"data/{name}", f"_claims/{name}"):
                self.fs.delete(self._path(f"{self.path}/{left}"), True)
            return []
        files = self.fs.listStatus(self._path(f"{self.path}/data/{name}"))
        found = sorted((f.getPath().getName(), int(f.getLen())) for f in files if f.getPath().getName().endswith(".parquet"))
        return [{"file": f"data/{name}/{f}", "bytes": n, "of": len(found)} for f, n in found]

    def _release(self, added: list[dict]) -> None:
        """Gives up the claims of folders that a manifest names now."""
        for folder in {s["file"].split("/")[1] for s in added}:
            self.fs.delete(self._path(f"{self.path}/_claims/{folder}"), False)

    def append(self, df: DataFrame, tries: int = 20) -> dict:
        """Writes an arrival, a shard per partition, and commits it."""
        added, schema = self._write(df), df.schema.json()
        m = self._retried(lambda m: self.commit(m, set(), added, schema), tries)
        self._release(added)
        return m

    def _retried(self, attempt, tries: int) -> dict:
        for left in reversed(range(tries)):
            try:
                return attempt(self.manifest())
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def tier(self, size: int) -> int:
        t = 0
        while size >= self.floor * self.fan ** (t + 1):
            t += 1
        return t

    def full_runs(self, manifest: dict) -> list[list[dict]]:
        """Runs to merge: of each tier with ``fan`` shards or more, the shards by size, packed up to the target."""
        tiers: dict[int, list[dict]] = {}
        for s in manifest["shards"]:
            if 2 * s["bytes"] <= self.target:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs = []
        for shards in (tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan):
            run, size = [], 0
            for s in sorted(shards, key=lambda s: (s["bytes"], s["file"])):
                if run and size + s["bytes"] > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, tries: int = 20) -> dict:
        """Merges until no tier is full; each round is a job for every ``RUNS`` runs, and one commit."""
        while runs := self.full_runs(m := self.manifest()):
            read = [s["file"] for r in runs for s in r]
            schema = T.StructType.fromJson(json.loads(m["schema"]))
            added = [s for i in range(0, len(runs), RUNS) for s in self._write(self._merged(runs[i : i + RUNS], schema))]
            self._retried(lambda now: self._swap(now, set(read), added), tries)
            self._release(added)
        return m

    def _swap(self, now: dict, read: set[str], added: list[dict]) -> dict:
        if not read <= {s["file"] for s in now["shards"]}:
            raise ValueError("another compaction has merged these shards")
        return self.commit(now, read, added, None)

    def _merged(self, runs: list[list[dict]], schema: T.StructType) -> DataFrame:
        """The runs' rows, a run a partition: each run's files are read by one task."""
        apart = self.spark.newSession()
        apart.conf.set("spark.sql.unionOutputPartitioning", "false")  # else one-partition parts of a union share a partition
        out = None
        for r in runs:
            one = apart.read.schema(schema).parquet(*self._paths(r)).coalesce(1)
            out = one if out is None else out.unionAll(one)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("nothing was ever appended")
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self._paths(m["shards"]))

    def _paths(self, shards: list[dict]) -> list[str]:
        """What to read: a folder where all its files are meant, else the files."""
        meant = Counter(s["file"].rpartition("/")[0] for s in shards)
        whole = {s["file"].rpartition("/")[0] for s in shards if meant[s["file"].rpartition("/")[0]] == s["of"]}
        rest = (s["file"] for s in shards if s["file"].rpartition("/")[0] not in whole)
        return [f"{self.path}/{x}" for x in (*sorted(whole), *rest)]

    def vacuum(self, keep: int = 1, claim_s: float = CLAIM_S) -> int:
        """Removes what only manifests before the newest ``keep`` name, and what nobody names or claims; returns how many files.

        Folders are listed before claims, and claims before manifests are read: a folder whose claim is gone by then is
        named by a manifest, or nobody wants it.
        """
        data, claims = self._path(f"{self.path}/data"), self._path(f"{self.path}/_claims")
        folders = [f.getPath() for f in self.fs.listStatus(data)] if self.fs.exists(data) else []
        since = time.time() - claim_s
        claimed = {c.getPath().getName() for c in self.fs.listStatus(claims) if c.getModificationTime() / 1000 >= since}
        known = self.versions()
        live = [self.manifest(v) for v in known[-keep:]]
        files = {s["file"] for m in live for s in m["shards"]}
        parts = {p["name"] for m in live for p in m["parts"]}
        gone = 0
        for at in folders:
            if at.getName() in claimed:
                continue
            found = [f.getPath() for f in self.fs.listStatus(at)]
            dead = [f for f in found if f"data/{at.getName()}/{f.getName()}" not in files]
            gone += sum(f.getName().endswith(".parquet") for f in dead)
            if len(dead) == len(found):
                self.fs.delete(at, True)
                self.fs.delete(self._path(f"{self.path}/_claims/{at.getName()}"), False)
            else:
                for f in dead:
                    self.fs.delete(f, False)
        for v in known[:-keep]:
            for p in self._json(self._name(v))["parts"]:
                if p["name"] not in parts:
                    self.fs.delete(self._path(f"{self.path}/_manifest/{p['name']}"), False)
            # the name stays as long as a writer may still take it for the next version
            if self.fs.getFileStatus(self._path(self._name(v))).getModificationTime() / 1000 < since:
                self.fs.delete(self._path(self._name(v)), False)
        return gone


def round_trip(docs: DataFrame, arrivals: int = 4, target: int = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Appends ``docs`` in some arrivals, compacts, drops what is merged, and returns what the store holds.

    Columns: id, bytes of the text and their SHA-256, from the newest version.
    """
    store = ShardStore(docs.sparkSession, shared_dir(docs.sparkSession, "shards"), target)
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(part == k))
    store.compact()
    store.vacuum()
    body = F.encode(text_of(text_col), "UTF-8")
    return store.read().select(id_col, F.length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("text_sha256"))
