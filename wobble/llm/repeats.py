"""Removal of repeated byte strings by suffix sorting (op 4).

Every byte that a string of ``LENGTH`` bytes covers which also starts anywhere else, in the same or another
document, is removed. Matches never cross documents and are judged on the input.

1. Anchors. Each window of ``LENGTH`` bytes chooses one of its ``GRAM``-byte grams: that with the smallest hash, the
   last of equal ones. Equal windows choose equal grams at equal places. Neighbouring windows with one choice form
   a run, so every window is in exactly one run, and windows can only be equal if their runs' grams are.
2. Runs whose gram occurs once are done. Of the others, equal runs (two independent 64-bit hashes of their at most 368
   bytes) are added up before anything is compared; a run that occurs twice or more as a whole is covered whole.
3. Runs of one gram that differ are sorted together: shards of whole groups go through the suffix sorter of
   :mod:`.suffix_kernel`, which compares their bytes and returns the ranges that repeated windows cover.
4. A group of more than ``HOT`` different runs (a phrase in very many documents) is first split by the bytes around
   its gram: of each run, the windows that hold the gram in their earlier and in their later half make a run each, and
   the group of such a run is named by the bytes that all those windows share. Equal windows hold the gram at equal
   places, so they stay together. That is repeated until a group is small or its runs are single windows, which are
   equal then; those are added up by their bytes. So no group is gathered that is larger than ``HOT`` runs.
5. Ranges go back to every run with that content, and the documents' bytes that they cover are cut.

Keys that hold more than one row in a thousand are joined apart (:func:`.shared.matched`), so that none stops a task.
Rows of a document are known by its id and a hash of its text. Defined results: a null text is an empty one;
a null id is kept; texts that occur twice or more (repeated rows too) are covered whole if they have ``LENGTH`` bytes;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE, CHUNK, Chunk, chunks, hashes, mixed, powers
from .shared import bounded_batches, matched, remove, scratch, stored, text_of, tidied, union
from .suffix_kernel import registered

LENGTH, GRAM, HOT = 200, 32, 2000
#: Bytes of runs that one call of the suffix sorter gets, about (a gram with its at most HOT runs is not split).
SHARD = 2 << 20
KEY = ("doc", "t")
TOP = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0x00000000FFFFFFFF)
BYTE2 = mixed(BYTE, 11)


def runs(c: Chunk, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text, gram hash, two content hashes, place, byte length and the gram's place in it of every run of a chunk's windows."""
    n, wide = len(c.data), length - gram + 1
    m = n - gram + 1
    valid = np.zeros(n + 1, bool)
    size = np.diff(c.at)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, c.at[:-1][long], 1)
    np.add.at(step, c.at[:-1][long] + size[long] - length + 1, -1)
    valid = np.cumsum(step[: n + 1]) > 0
    sums = c.sums()
    _, down = powers(n + 1)
    h = mixed((sums[gram:] - sums[:m]) * down[:m])
    order = (h & TOP) | (LOW - np.arange(m, dtype=np.uint64))
    padded = np.full(-(-m // wide) * wide + wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:m] = order
    blocks = padded.reshape(-1, wide)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.flatnonzero(valid[:n])
    least = np.minimum(tail[windows], head[windows + wide - 1])
    anchor = (LOW - (least & LOW)).astype(np.int64)
    cut = np.ones(len(windows) + 1, bool)
    cut[1:-1] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(cut)
    first, last = windows[at[:-1]], windows[at[1:] - 1]
    anchor = anchor[at[:-1]]
    content = mixed(hashes(sums, first, last + length) ^ mixed((anchor - first).astype(np.uint64), 9), 10)
    owner = c.owner(first)
    up, _ = powers(n + 1)
    second = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE2[c.data] * up[:n], out=second[1:])
    again = mixed(hashes(second, first, last + length) ^ mixed((anchor - first).astype(np.uint64), 12), 13)
    return owner, h[anchor].view(np.int64), content.view(np.int64), again.view(np.int64), first - c.at[owner], last + length - first, anchor - first


def overlapping(c: Chunk, length: int = LENGTH, limit: int = CHUNK) -> Iterator[tuple[int, Chunk]]:
    """A single long text in pieces that share ``length - 1`` bytes, so that every window is in one of them; a run may be cut in two."""
    if c.n != 1 or len(c.data) <= 2 * limit:
        yield 0, c
        return
    for o in range(0, len(c.data) - length + 1, limit):
        data = c.data[o : o + limit + length - 1]
        yield o, Chunk(data, np.array([0, len(data)]), c.first)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))


RUN = ("g", "c", "d")


def _anchors(rows: DataFrame) -> DataFrame:
    kind = rows.schema["doc"].dataType.simpleString()

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                for o, piece in overlapping(c):
                    owner, g, one, two, place, size, gram = runs(piece)
                    of = pa.array(owner + c.first)
                    cols = (pa.array(x.astype(np.int64)) for x in (g, one, two, place + o))
                    small_ = (pa.array(x.astype(np.int32)) for x in (size, gram))
                    yield pa.record_batch([batch.column("doc").take(of), batch.column("t").take(of), *cols, *small_], ["doc", "t", *RUN, "place", "size", "gram"])

    return bounded_batches(rows).mapInArrow(work, f"doc {kind}, t bigint, g bigint, c bigint, d bigint, place bigint, size int, gram int")


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.t") == F.col(f"{b}.t"))


def _halves(rows: DataFrame) -> DataFrame:
    """Runs (``group, low, high, base, gram, run``) split by where their windows hold the gram: ``low`` to the middle, and beyond to ``high``.

    ``base`` is the sub-run's place in the run that it comes from, ``gram`` the gram's place in the sub-run.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    parts = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
    each = rows.withColumn("part", F.explode(parts)).where("part.low <= part.high").withColumn("old", F.col("group"))
    first = F.greatest(F.lit(0), F.col("gram") - F.col("part.high"))
    last = F.least(F.length("run") - LENGTH, F.col("gram") - F.col("part.low"))
    each = each.withColumn("first", first).withColumn("last", last).where("first <= last")
    # bytes that all windows of the part hold, which lie in the run if any of them does
    context = F.substring(F.col("run"), F.col("gram") - F.col("part.low") + 1, LENGTH - (F.col("part.high") - F.col("part.low")))
    return each.select(
        *RUN, F.xxhash64("old", "part.low", "part.high", context).alias("group"), "part.low", "part.high",
        (F.col("base") + F.col("first")).alias("base"), (F.col("gram") - F.col("first")).alias("gram"),
        F.substring(F.col("run"), F.col("first") + 1, F.col("last") - F.col("first") + LENGTH).alias("run"),
    )


def _sorted_ranges(rows: DataFrame, shard: int) -> DataFrame:
    """``g, c, d, from, to`` that the suffix sorter finds in runs of whole groups."""
    total = rows.agg(F.sum(F.length("run"))).first()[0] or 0
    shards = max(1, round(total / shard))
    sort = registered(rows.sparkSession)
    # bounded: a shard holds some SHARD bytes, and a group adds HOT runs at most
    packed = rows.groupBy(F.pmod(F.xxhash64("group"), F.lit(shards)).alias("shard")).agg(F.collect_list(F.struct(*RUN, "base", "run")).alias("runs"))
    packed = packed.withColumn("found", F.expr(f"{sort}(runs.run, {LENGTH})")).select(F.expr("transform(runs, r -> named_struct('g', r.g, 'c', r.c, 'd', r.d, 'base', r.base))").alias("runs"), "found")
    triple = F.explode(F.expr("CASE WHEN size(found) > 0 THEN sequence(0, size(found) - 3, 3) ELSE array() END")).alias("k")
    flat = packed.select("runs", "found", triple).select(
        F.expr("runs[found[k]]").alias("r"), F.expr("found[k + 1]").cast("long").alias("from"), F.expr("found[k + 2]").cast("long").alias("to")
    )
    return flat.select("r.g", "r.c", "r.d", (F.col("from") + F.col("r.base")).alias("from"), (F.col("to") + F.col("r.base")).alias("to"))


def _differing_ranges(rows: DataFrame, hot: int, shard: int) -> DataFrame:
    """``g, c, d, from, to`` of windows that runs of one gram (``g, c, d, kinds, gram, run``) share."""
    now = rows.withColumn("group", F.col("g")).withColumn("low", F.lit(0)).withColumn("high", F.lit(LENGTH - GRAM)).withColumn("base", F.lit(0))
    done = [_sorted_ranges(now.where(F.col("kinds") <= hot), shard)]
    left = now.where(F.col("kinds") > hot).drop("kinds")
    while not left.isEmpty():
        halves = stored(_halves(left), "halves")
        sizes = halves.groupBy("group").agg(F.count("*").alias("kinds")).where("kinds > 1")
        sized = stored(matched(halves, sizes, ["group"]), "sized")
        done.append(_sorted_ranges(sized.where((F.col("kinds") <= hot) & (F.col("low") < F.col("high"))), shard))
        single = stored(sized.where("low = high"), "single")
        often = single.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
        done.append(matched(single, often, ["run"]).select(*RUN, F.col("base").cast("long").alias("from"), (F.col("base") + LENGTH).cast("long").alias("to")))
        left = sized.where((F.col("kinds") > hot) & (F.col("low") < F.col("high"))).drop("kinds")
    return union(done)


def covered(docs: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """``doc, t, ranges`` of the documents (``doc, t, text``) that hold a repeated string; ranges may overlap. Stored."""
    with scratch(docs.sparkSession) as keep:
        anchors = stored(_anchors(docs), "anchors")
        again = anchors.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").drop("k")
        live = stored(matched(anchors, again, ["g"]), "live")
        remove(docs.sparkSession, anchors.shared_path)
        equal = live.groupBy(*RUN).agg(F.count("*").alias("n"), F.min("size").alias("size"), F.min("gram").alias("gram"), F.min(F.struct("doc", "t", "place")).alias("at"))
        equal = stored(equal, "equal")
        kinds = equal.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1")
        mixed_ = stored(matched(equal, kinds, ["g"]).select(*RUN, "kinds", "size", "gram", "at.doc", "at.t", "at.place"), "mixed")
        whole = equal.where("n > 1").select(*RUN, F.lit(0).cast("long").alias("from"), F.col("size").cast("long").alias("to"))

        body = F.substring(F.col("text").cast("binary"), (F.col("place") + 1).cast("int"), F.col("size"))
        fetched = mixed_.alias("m").join(docs.alias("d"), _same_doc("m", "d")).select(*(f"m.{c}" for c in RUN), "kinds", "gram", body.alias("run"))
        # rows that are equal in id and text are met more than once
        fetched = stored(fetched.groupBy(*RUN).agg(*(F.first(c).alias(c) for c in ("kinds", "gram", "run"))), "runs")
        ranges = union([_differing_ranges(fetched, hot, shard), whole]).groupBy(*RUN).agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
        ranges = stored(ranges, "ranges")
        back = matched(live.select("doc", "t", *RUN, "place"), ranges, list(RUN))
        moved = F.transform("ranges", lambda r: F.struct((r["from"] + F.col("place")).alias("from"), (r["to"] + F.col("place")).alias("to")))
        # rows that are equal in id and text hold the same runs at the same places: each counts once
        once = back.select("doc", "t", "place", moved.alias("ranges")).repartition("doc", "t").dropDuplicates(["doc", "t", "place"])
        return keep(stored(once.groupBy("doc", "t").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "covered"))


def merged(ranges: np.ndarray) -> np.ndarray:
    """Maximal ranges of a list of (from, to)."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    first = np.flatnonzero(np.concatenate([[True], r[1:, 0] > reach[:-1]]))
    return np.stack([r[first, 0], reach[np.concatenate([first[1:] - 1, [len(r) - 1]])]], axis=1)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row per document: ``id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept``, what is left (binary)."""
    rows = keyed(docs, id_col, text_col)
    found = covered(rows)
    kind = rows.schema["doc"].dataType.simpleString()
    joined = rows.alias("d").join(found.alias("f"), _same_doc("d", "f"), "left").select("d.doc", "d.text", "f.ranges")

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column("text").cast(pa.binary()), batch.column("ranges")
            out = []
            for i in range(batch.num_rows):
                data, spans = texts[i].as_py(), ranges[i]
                r = np.zeros((0, 2), np.int64)
                if spans.is_valid:
                    flat = spans.values
                    r = merged(np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1))
                ends = [0, *r.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(r), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([batch.column("doc"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = bounded_batches(joined).mapInArrow(work, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
