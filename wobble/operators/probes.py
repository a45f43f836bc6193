"""Linear probes for all folds and strengths at once: moments of every fold in one scan, every head solved from them.

Rows have a feature array ``x``, a label ``y`` and ``cells``, the (outer, inner) pairs of folds in which the row is held out. The
moments of a cell's rows (counts, sums and products of 1, the features and the label) are added up in one scan. What a head
is trained on is the sum of the outer fold's cells less its own, so a grid of folds and strengths takes one scan for ridge
heads, and one an iteration for logistic heads (Newton's method, all heads side by side). Nothing but moments leaves a task:
(features + 2)² numbers for each cell, or for each logistic head, which suits some hundred features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written
from .prefix import running
from .relational import auroc, group_folds

EPSILON = 1e-8
#: A head that is trained on all cells of its outer fold.
WHOLE = -1
#: Numbers that a task ranks at a time.
CHUNK = 1 << 21
#: Newton steps at most, and the length of a gradient (per row) at which a head is done.
STEPS, FLAT = 60, 1e-9
HEADS = "outer int, inner int, strength double, mean array<double>, sd array<double>, w array<double>, b double"


def nested_cells(rows: DataFrame, group: str, inner: int, seed: int) -> DataFrame:
    """``rows`` (with ``fold``) with ``cells``: for each other fold as the outer one, the row's fold among ``inner`` of the rows outside it.

    Groups are never split. Only the table of groups is dealt to folds, again for each outer fold.
    """
    groups = written(rows.select(group, "fold").distinct(), "groups")
    parts = None
    for outer in sorted(r.fold for r in groups.select("fold").distinct().collect()):  # folds are few
        dealt = group_folds(groups.where(F.col("fold") != outer), group, inner, seed)
        dealt = dealt.select(group, F.struct(F.lit(outer).alias("outer"), F.col("fold").alias("inner")).alias("cell"))
        parts = dealt if parts is None else parts.unionByName(dealt)
    # a row per group; Spark knows its size, so that rows are shuffled only where groups are too many to broadcast
    cells = written(parts.groupBy(group).agg(F.array_sort(F.collect_list("cell")).alias("cells")), "cells")
    return rows.join(cells, group)


def _held(frame: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """The places of a batch's rows in each cell."""
    at: dict[tuple[int, int], list[int]] = {}
    for i, cells in enumerate(frame["cells"]):
        for c in cells:
            at.setdefault((c["outer"], c["inner"]), []).append(i)
    return {k: np.array(v) for k, v in at.items()}


def _coded(cells: str) -> Column:
    """Each cell as a number, which is cheaper to shuffle and to hand to Python than a pair."""
    return F.transform(cells, lambda c: F.shiftleft(c["outer"], 16).bitwiseOR(c["inner"]))


def _places(coded: pa.ListArray) -> dict[tuple[int, int], np.ndarray]:
    """The rows of each cell, in order."""
    code = coded.flatten().to_numpy()
    row = np.repeat(np.arange(len(coded)), coded.value_lengths().to_numpy())
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    cuts = np.flatnonzero(code[1:] != code[:-1]) + 1
    return {(int(own[0]) >> 16, int(own[0]) & 0xFFFF): at for own, at in zip(np.split(code, cuts), np.split(row, cuts), strict=True) if len(own)}


def _matrix(lists: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _summed(parts: DataFrame, by: list[str]) -> DataFrame:
    """``by, sums``: arrays of numbers added place by place."""
    return parts.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))


def moments(rows: DataFrame) -> DataFrame:
    """``outer, inner, sums``: the products of 1, ``x`` and ``y`` over each cell's rows, row by row of the matrix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([np.ones(batch.num_rows), _matrix(batch["x"]), batch["y"].to_numpy(zero_copy_only=False)])
                for cell, at in _places(batch["cells"]).items():
                    found[cell] = found.get(cell, 0.0) + z[at].T @ z[at]
        names = [pa.array([k[i] for k in found], pa.int32()) for i in range(2)]
        yield pa.RecordBatch.from_arrays([*names, pa.array([m.ravel() for m in found.values()], pa.list_(pa.float64()))], ["outer", "inner", "sums"])

    parts = rows.select(_coded("cells").alias("cells"), "x", F.col("y").cast("double").alias("y")).mapInArrow(work, "outer int, inner int, sums array<double>")
    return _summed(parts, ["outer", "inner"])


def _trainings(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each cell of an outer fold, the moments of what its head is trained on; at last those of all cells."""
    d = round(len(frame["sums"].iloc[0]) ** 0.5)
    each = {int(i): np.asarray(s).reshape(d, d) for i, s in zip(frame["inner"], frame["sums"], strict=True)}
    total = sum(each.values())
    for inner in sorted(each):
        yield inner, total - each[inner]
    yield WHOLE, total


def _scale(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, and each feature's mean and deviation (a population's, never zero)."""
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    return n, mean, np.sqrt(np.maximum(m.diagonal()[1:-1] / n - mean**2, 0.0)) + EPSILON


def ridge_heads(sums: DataFrame, strengths: tuple[float, ...]) -> DataFrame:
    """``HEADS``: a ridge head over standardised features for each strength, and for each cell left out or none (``inner`` is ``WHOLE``)."""

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for inner, m in _trainings(frame):
            if m[0, 0] < 0.5:
                continue
            n, mean, sd = _scale(m)
            gram = (m[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
            level = m[0, -1] / n
            aim = (m[1:-1, -1] - n * mean * level) / sd
            for s in strengths:
                w = np.linalg.solve(gram + s * np.eye(len(sd)), aim)
                out.append((int(frame["outer"].iloc[0]), inner, s, mean, sd, w, level))
        return pd.DataFrame(out, columns=["outer", "inner", "strength", "mean", "sd", "w", "b"])

    return sums.groupBy("outer").applyInPandas(solved, HEADS)  # a matrix for each inner fold


def logistic_heads(rows: DataFrame, sums: DataFrame, strengths: tuple[float, ...]) -> DataFrame:
    """``HEADS``: as :func:`ridge_heads`, logistic, with inverse penalties; no head where the rows it is trained on lack a class.

    A scan adds up the losses, gradients and curvatures of all heads; the driver holds these, (features + 1)² numbers a head, and
    steps. A step that raises a head's loss is halved.
    """
    spark = rows.sparkSession
    by_outer: dict[int, list] = {}
    for r in sums.collect():  # a matrix per cell
        by_outer.setdefault(r.outer, []).append((r.inner, r.sums))
    trained = {(outer, inner): m for outer, own in sorted(by_outer.items()) for inner, m in _trainings(pd.DataFrame(own, columns=["inner", "sums"]))}
    trained = {k: m for k, m in trained.items() if 0.5 < m[0, -1] < m[0, 0] - 0.5}  # both classes
    names = [(outer, inner, s) for outer, inner in trained for s in strengths]
    if not names:
        return spark.createDataFrame([], HEADS)
    d = len(next(iter(trained.values()))) - 1
    # all heads are sought in one scale, that of all rows of one outer fold; the penalty is each head's own
    _, center, spread = _scale(trained[max(trained, key=lambda k: trained[k][0, 0])])
    n, mean, sd = (np.array(x) for x in zip(*(_scale(trained[k[:2]]) for k in names), strict=True))
    penalty = np.column_stack([np.zeros(len(names)), (sd / spread) ** 2 / np.array([k[2] for k in names])[:, None]])
    now, step, loss = np.zeros((len(names), d)), np.zeros((len(names), d)), np.full(len(names), np.inf)
    open_ = np.ones(len(names), bool)
    rows = written(rows.select("cells", "x", F.col("y").cast("double").alias("y")), "probe-rows")
    for _ in range(STEPS):
        doing = np.flatnonzero(open_)
        found = {r.head: np.asarray(r.sums) for r in _summed(_curvatures(rows, [names[i] for i in doing], now[doing], center, spread), ["head"]).collect()}
        for place, i in enumerate(doing):
            f = found[place]
            value, slope = f[0] + (penalty[i] * now[i] ** 2).sum() / 2, f[1 : d + 1] + penalty[i] * now[i]
            if value > loss[i] + 1e-12 * abs(loss[i]):
                step[i] /= 2
                now[i] -= step[i]
                continue
            loss[i] = value
            step[i] = -np.linalg.solve(f[d + 1 :].reshape(d, d) + np.diag(penalty[i]), slope)
            open_[i] = np.abs(slope).max() > FLAT * n[i]
            now[i] += step[i] * open_[i]
        if not open_.any():
            break
    w = now[:, 1:] * (sd / spread)
    b = now[:, 0] + (now[:, 1:] * (mean - center) / spread).sum(axis=1)
    listed = [(*map(int, k[:2]), float(k[2]), mean[i].tolist(), sd[i].tolist(), w[i].tolist(), float(b[i])) for i, k in enumerate(names)]
    return spark.createDataFrame(listed, HEADS)


def _curvatures(rows: DataFrame, names: list[tuple[int, int, float]], at: np.ndarray, center: np.ndarray, spread: np.ndarray) -> DataFrame:
    """``head, sums``: each head's loss, its gradient and its matrix of second derivatives over the rows it is trained on, from each task."""
    d = at.shape[1]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(names), 1 + d + d * d))
        for frame in frames:
            if not len(frame):
                continue
            z = np.column_stack([np.ones(len(frame)), (np.stack(frame["x"].to_numpy()) - center) / spread])
            y, held = frame["y"].to_numpy(), _held(frame)
            outer = {k: np.unique(np.concatenate([v for c, v in held.items() if c[0] == k])) for k in {c[0] for c in held}}
            score = z @ at.T
            for h, (o, i, _) in enumerate(names):
                if o not in outer:
                    continue
                own = np.setdiff1d(outer[o], held.get((o, i), np.zeros(0, int)), assume_unique=True)
                s, zs, ys = score[own, h], z[own], y[own]
                p = 1 / (1 + np.exp(-s))
                sums[h, 0] += (np.logaddexp(0, s) - ys * s).sum()
                sums[h, 1 : d + 1] += zs.T @ (p - ys)
                sums[h, d + 1 :] += (zs.T @ (zs * (p * (1 - p))[:, None])).ravel()
        yield pd.DataFrame({"head": range(len(names)), "sums": list(sums)})

    return rows.mapInPandas(work, "head int, sums array<double>")


def scored(rows: DataFrame, key: list[str], heads: DataFrame) -> DataFrame:
    """``key, y, outer, inner, strength, score``: each row by the heads of the cells in which it is held out, and by those of its own ``fold`` that were trained on all others.

    The heads are collected: three arrays of features each.
    """
    found = heads.collect()
    at: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(found):
        at.setdefault((r.outer, r.inner), []).append(i)
    d = len(found[0].w) if found else 0
    weights = np.array([np.divide(r.w, r.sd) for r in found]).reshape(len(found), d)
    bias = np.array([r.b - np.dot(np.divide(r.w, r.sd), r["mean"]) for r in found])
    strengths = np.array([r.strength for r in found])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame) or not found:
                continue
            score = np.stack(frame["x"].to_numpy()) @ weights.T + bias
            held = _held(frame)
            own = frame["fold"].to_numpy()
            held |= {(int(k), WHOLE): np.flatnonzero(own == k) for k in np.unique(own)}
            for cell, places in held.items():
                for h in at.get(cell, ()):
                    part = frame[[*key, "y"]].iloc[places]
                    yield part.assign(outer=cell[0], inner=cell[1], strength=strengths[h], score=score[places, h])

    rows = rows.select(*key, F.col("y").cast("double").alias("y"), "fold", "cells", "x")
    schema = rows.select(*key, "y").schema.add("outer", "integer").add("inner", "integer").add("strength", "double").add("score", "double")
    return rows.mapInPandas(work, schema)


def _heads_by_cell(heads: DataFrame, strengths: tuple[float, ...]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The weights and constants of each cell's heads, a head for each strength. The heads are collected."""
    found = {(r.outer, r.inner, r.strength): r for r in heads.collect()}
    at = {}
    for outer, inner in {k[:2] for k in found}:
        own = [found[outer, inner, s] for s in strengths]
        w = np.array([np.divide(r.w, r.sd) for r in own])
        at[outer, inner] = w, np.array([r.b - np.dot(v, r["mean"]) for r, v in zip(own, w, strict=True)])
    return at


def _scores(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each row's score by each head, added in one order, so that equal features have equal scores."""
    return sum((x[:, j, None] * w[:, j] for j in range(w.shape[1])), b)


def trials(rows: DataFrame, heads: DataFrame, strengths: tuple[float, ...]) -> DataFrame:
    """``outer, inner, y, s0, s1, ...``: each row in each cell in which it is held out, with its score at each strength. The heads are collected."""
    at = _heads_by_cell(heads, strengths)
    names = [f"s{k}" for k in range(len(strengths))]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, y = np.stack(frame["x"].to_numpy()), frame["y"].to_numpy()
            for (outer, inner), places in _held(frame).items():
                if (outer, inner) in at:
                    score = _scores(x[places], *at[outer, inner])
                    yield pd.DataFrame({"outer": outer, "inner": inner, "y": y[places]} | {n: score[:, k] for k, n in enumerate(names)})

    return rows.select("cells", "x", F.col("y").cast("double").alias("y")).mapInPandas(work, "outer int, inner int, y double, " + ", ".join(f"{n} double" for n in names))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's features among the distinct ones, and a place of each."""
    code = np.zeros(len(x), np.int64)
    for column in x.T:
        own, names = pd.factorize(column, use_na_sentinel=False)
        code, _ = pd.factorize(code * len(names) + own)
    at = np.zeros(code.max() + 1, np.int64)
    at[code] = np.arange(len(code))
    return code, at


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.Table]:
    """A task's rows in tables of some ``chunk`` numbers."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += len(batch["x"].flatten()) + len(batch["cells"].flatten()) + batch.num_rows
        if size >= chunk:
            yield pa.Table.from_batches(some)
            some, size = [], 0
    if size:
        yield pa.Table.from_batches(some)


def rank_sums(rows: DataFrame, key: list[str], heads: DataFrame, strengths: tuple[float, ...], chunk: int = CHUNK) -> DataFrame:
    """``outer, inner, lo, s, n, r, ties``: for rows of a cell with equal scores ``s`` (one a strength) in one span of labels, their number and the sum of their labels' ranks in the span.

    Rows are put in order of their labels once, whatever the number of cells, in ranges that equal labels may cross (``key``
    parts them). A task ranks a chunk of them for every cell. Its first and its last label, which other chunks may have too,
    are spans of their own without ``r``; what lies between is one with ``ties``, the sum of its ties' t³ - t. ``lo`` is a span's
    least label. The heads are collected; rows without a label, or in a cell that gives them no score, do not count.
    """
    at = _heads_by_cell(heads, strengths)
    schema = pa.schema([("outer", pa.int32()), ("inner", pa.int32()), ("lo", pa.float64()), ("s", pa.list_(pa.float64())), ("n", pa.int64()), ("r", pa.float64()), ("ties", pa.float64())])

    def span(cell: tuple[int, int], label: np.ndarray, code: np.ndarray, score: np.ndarray, whole: bool) -> pa.RecordBatch:
        n = np.bincount(code, minlength=len(score))
        kept = np.flatnonzero(n)
        r, ties = None, np.zeros(len(kept))
        if not whole:
            first = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
            size = np.diff(np.append(first, len(label))).astype(float)
            r = np.bincount(code, np.repeat(first + (size + 1) / 2, size.astype(int)), len(score))[kept]
            ties[0] = (size**3 - size).sum()
        lists = pa.ListArray.from_arrays(np.arange(len(kept) + 1, dtype=np.int32) * len(strengths), score[kept].ravel())
        same = [np.full(len(kept), c, np.int32) for c in cell]
        ranks = pa.nulls(len(kept), pa.float64()) if r is None else r
        return pa.RecordBatch.from_arrays([*map(pa.array, (*same, np.full(len(kept), label[0]))), lists, *map(pa.array, (n[kept], ranks, ties))], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, chunk):
            x, y = _matrix(table["x"].combine_chunks()), table["y"].to_numpy()
            code, distinct = _distinct(x)
            for cell, places in _places(table["cells"].combine_chunks()).items():
                if cell not in at:
                    continue
                score = _scores(x[distinct], *at[cell])
                places = places[~np.isnan(score).any(axis=1)[code[places]]]
                label, own = y[places], code[places]
                low, high = np.searchsorted(label, y[0], "right"), np.searchsorted(label, y[-1], "left")
                for a, b, whole in ((0, low, True), (low, high, False), (max(low, high), len(label), True)):
                    if a < b:
                        yield span(cell, label[a:b], own[a:b], score, whole)

    y = F.col("y").cast("double") + F.lit(0.0)  # no negative zeros
    known = rows.select(_coded("cells").alias("cells"), "x", y.alias("y"), F.pmod(F.hash(*key), F.lit(256)).alias("part")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    n = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = known.repartitionByRange(n, "y", "part").sortWithinPartitions("y").select("cells", "x", "y")
    return ranged.mapInArrow(work, "outer int, inner int, lo double, s array<double>, n long, r double, ties double")


def rank_quality(rows: DataFrame, key: list[str], heads: DataFrame, strengths: tuple[float, ...], least: int = 3, chunk: int = CHUNK) -> DataFrame:
    """``outer, inner, strength, q``: Spearman's correlation of the label with each head's score over the rows held out in its cell; null below ``least`` rows or without variance.

    It is the sum over distinct scores of their rank times the ranks of their rows' labels, so no row is stored for a cell where scores repeat.
    """
    sums = written(rank_sums(rows, key, heads, strengths, chunk), "rank-sums")
    cube = lambda c: c.cast("double") * c * c - c
    spans = sums.groupBy("outer", "inner", "lo").agg(F.sum("n").alias("size"), F.sum("ties").alias("ties"), F.count("r").alias("ranked"))
    spans = spans.withColumn("ties", F.when(F.col("ranked") > 0, F.col("ties")).otherwise(cube(F.col("size"))))
    w = Window.partitionBy("outer", "inner")  # three spans a chunk
    before = F.coalesce(F.sum("size").over(w.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select("outer", "inner", "lo", "size", "ties", before.alias("before"), F.sum("size").over(w).alias("total")), "spans")
    own = F.coalesce("r", F.col("n") * (F.col("size") + 1) / 2) + F.col("n") * (F.col("before") - (F.col("total") + 1) / 2)
    long = sums.join(spans.drop("ties"), ["outer", "inner", "lo"]).select("outer", "inner", F.posexplode("s").alias("k", "v"), "n", own.alias("p"))
    values = running(long.groupBy(F.struct("outer", "inner", "k").alias("g"), "v").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), "n")
    r = F.col("before_n") + (F.col("n") + 1) / 2 - (F.col("total_n") + 1) / 2
    found = values.groupBy("g").agg(F.sum(r * F.col("p")).alias("both"), F.sum(F.col("n") * r * r).alias("a"))
    labels = spans.groupBy("outer", "inner").agg(F.max("total").alias("n"), ((cube(F.max("total")) - F.sum("ties")) / 12).alias("b"))
    size = F.sqrt("a") * F.sqrt("b")
    q = F.when((F.col("n") >= least) & (size > 0), F.col("both") / F.when(size > 0, size))
    strength = F.get(F.array(*map(F.lit, strengths)), F.col("k"))
    return found.select("g.*", "both", "a").join(labels, ["outer", "inner"]).select("outer", "inner", strength.alias("strength"), q.alias("q"))


def nested(rows: DataFrame, key: list[str], group: str, binary: bool, grid: tuple[float, ...], inner: int = 3, seed: int = 43) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores ``key, y, outer, strength, score`` of rows with ``fold``, and the ``strength`` that each outer fold's inner folds chose.

    A strength's worth is the mean over the inner folds of its heads' quality on the rows held out (area under the curve, or
    rank correlation; folds where it is not defined do not count); of equal ones the first of the grid is chosen.
    """
    split = written(nested_cells(rows, group, inner, seed), "nested")
    sums = moments(split)
    heads = written(logistic_heads(split, sums, grid) if binary else ridge_heads(sums, grid), "heads")
    tried = heads.where(F.col("inner") != WHOLE)
    by = ["outer", "inner", "strength"]
    if binary:
        quality = auroc(written(scored(split, [], tried), "scores").where(F.col("inner") != WHOLE), "y", "score", by).withColumnRenamed("auroc", "q")
    else:
        quality = rank_quality(split, key, tried, grid)
    place = F.array_position(F.array(*map(F.lit, grid)), F.col("strength"))
    worth = quality.groupBy("outer", "strength").agg(F.avg(F.when(~F.isnan("q"), F.col("q"))).alias("q"))
    first = F.row_number().over(Window.partitionBy("outer").orderBy(F.desc_nulls_last(F.round("q", 9)), place))
    picked = worth.withColumn("place", first).where("place = 1").select("outer", "strength", F.col("q").alias("worth"))
    picked = written(picked, "picked")
    chosen = heads.where(F.col("inner") == WHOLE).join(picked.select("outer", "strength"), ["outer", "strength"])
    out = scored(split, key, chosen.select(heads.columns))
    return out.select(*key, "y", "outer", "strength", "score"), picked
