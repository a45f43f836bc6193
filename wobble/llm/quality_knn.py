"""Quality by nearest-neighbour voting over latent-semantic vectors (op 7).

A text is a bag of hashed features in three views of equal weight: its words, the shapes of its words (runs of
upper and lower case letters, digits, and each punctuation mark), and what share of it repeats. Fitting takes a
sample of at most ``sample`` labelled rows (those with the smallest id hashes; 8192 by default, a bound that does
not grow), learns inverse document frequencies and a truncated SVD (randomised subspace iteration) from it, and
keeps the sample's vectors and labels. That model, at most ``sample + BINS`` rows of ``dims`` floats, is broadcast;
every text is then projected and compared with every labelled vector, a block of texts at a time, and the labels
of its ``k`` nearest vote with their cosine squared as weight.

Rows with ``crc32(id as text) mod 5 = 0`` never give labels. Labels, language, source and id are no features.

Defined results: a null text is an empty one; a text without any feature, or whose neighbours all have cosine 0
or less, gets the sample's mean label; with no labelled row every score is 0.5; a null id counts as held out;
several labels of one id count as their maximum, null labels not at all; of equal ids among the sampled the
smallest text is learnt from; ties between neighbours go to the lower place in the sample; repeated rows get a
row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE, Chunk, chunks, hashes, word_pieces
from .quality_rules import measure_arrays
from .shared import bounded_batches, text_of, tidied

SAMPLE, DIMS, NEIGHBOURS, THRESHOLD, FOLDS = 8192, 64, 15, 0.3, 5
WORD_BINS, SHAPE_BINS, PARTS = 1 << 13, 1 << 11, 16
BINS = WORD_BINS + SHAPE_BINS + 4 * PARTS
#: Class of a byte for word shapes: letters and digits share one each, other bytes are their own.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("A") : ord("Z") + 1], SHAPE[ord("a") : ord("z") + 1], SHAPE[ord("0") : ord("9") + 1] = 1, 2, 3
SHAPE[128:] = 2


def _bags(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bin of each word and each word's shape, and the texts of words that equal the one before."""
    inside = ~SPACE[c.data]
    start, end = c.runs(inside)
    owner = c.owner(start)
    whole = hashes(c.sums(), start, end)
    again = np.flatnonzero((whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])) + 1
    kinds = SHAPE[c.data]
    keep = inside.copy()
    keep[1:] &= kinds[1:] != kinds[:-1]
    keep[start] = True
    seen = np.concatenate([[0], np.cumsum(keep)])
    packed = kinds[keep]
    shapes = hashes(Chunk(packed, np.array([0, len(packed)]), 0).sums(), seen[start], seen[end]) % np.uint64(SHAPE_BINS)
    bins = np.concatenate([(whole % np.uint64(WORD_BINS)).astype(np.int64), shapes.astype(np.int64) + WORD_BINS])
    return np.concatenate([owner, owner]), bins, owner[again]


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bin and term frequency of each feature of a chunk, by text and bin. A long text's features are added up by pieces."""
    keys, times_, again = [], [], np.zeros(c.n, np.int64)
    for _, p in word_pieces(c):
        text, bins, same = _bags(p)
        key, n = np.unique(text * BINS + bins, return_counts=True)
        keys.append(key)
        times_.append(n)
        again += np.bincount(same, minlength=c.n)
    m = measure_arrays(c)
    n_words = np.maximum(m["n_words"], 1)
    shares = (m["n_repeat_words"] / n_words, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), np.minimum(m["n_symbols"] / n_words, 1), again / n_words)
    full = np.flatnonzero(m["n_words"])
    for i, s in enumerate(shares):
        part = np.minimum((PARTS - 1) * np.ceil(s[full] * 8) / 8, PARTS - 1).astype(np.int64)
        keys.append(full * BINS + WORD_BINS + SHAPE_BINS + i * PARTS + part)
        times_.append(np.ones(len(full), np.int64))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key // BINS, key % BINS, np.bincount(place, np.concatenate(times_), len(key)).astype(np.int64)


VIEW = np.repeat([0, 1, 2], [WORD_BINS, SHAPE_BINS, 4 * PARTS])


def weighted(text: np.ndarray, bins: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of features; each view of a text has length 1."""
    w = ((1 + np.log(n)) * idf[bins]).astype(np.float32)
    group = text * 3 + VIEW[bins]
    norm = np.sqrt(np.bincount(group, w.astype(np.float64) ** 2))
    return w / np.maximum(norm[group], 1e-12).astype(np.float32)


def times(at: np.ndarray, bins: np.ndarray, w: np.ndarray, dense: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """A sparse matrix (rows begin at ``at``, which has one entry more than rows) times a dense one."""
    out = np.zeros((len(at) - 1, dense.shape[1]), np.float32)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(at, at[a] + block, "right")) - 1)
        rows = np.flatnonzero(np.diff(at[a : b + 1])) + a
        if len(rows):
            lo, hi = at[a], at[b]
            out[rows] = np.add.reduceat(w[lo:hi, None] * dense[bins[lo:hi]], at[rows] - lo, axis=0)
        a = b
    return out


class Model:
    """Projection, labelled vectors and labels."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int):
        self.idf, self.basis, self.vectors, self.labels, self.k = idf, basis, vectors, labels, k

    def project(self, text: np.ndarray, bins: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        w = weighted(text, bins, n, self.idf)
        x = times(np.searchsorted(text, np.arange(rows + 1)), bins, w, self.basis)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """Weighted share of label 1 among each row's nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        out, k = np.empty(len(x)), min(self.k, len(self.labels))
        for a in range(0, len(x), block):
            cos = x[a : a + block] @ self.vectors.T
            # the k largest; of equal ones those that come first
            least = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
            over, level = cos > least, cos == least
            take = over | (level & (np.cumsum(level, axis=1) <= k - over.sum(axis=1, keepdims=True)))
            weight = np.where(take, np.maximum(cos, 0) ** 2, 0).astype(np.float64)
            total = weight.sum(axis=1)
            out[a : a + block] = np.where(total > 0, weight @ self.labels / np.maximum(total, 1e-300), self.labels.mean())
        return np.clip(out, 0, 1)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS, F.lit(0)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id, label, text`` of at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.max(F.col(label_col).cast("double")).alias("label"))
    texts = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    # a label may have no document in this table, so rows are chosen among those that have one
    present = known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id")
    known = F.broadcast(present.orderBy(F.xxhash64("id"), "id").limit(sample))  # at most `sample` rows
    return texts.join(known, texts.doc == known.id).groupBy("id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dims: int = DIMS, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 7) -> Model:
    rows = training_rows(docs, labels, sample, id_col, text_col, label_col)

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                text, bins, n = features(c)
                at = np.searchsorted(text, np.arange(c.n + 1))
                lists = (pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (bins, n))
                yield pa.record_batch([batch.column("id").slice(c.first, c.n), batch.column("label").slice(c.first, c.n), *lists], ["id", "label", "bins", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    got = bounded_batches(rows).mapInArrow(work, f"id {kind}, label double, bins array<int>, n array<int>").toArrow().sort_by("id").combine_chunks()
    label = got["label"].to_numpy()
    flat = lambda c: np.asarray(pa.chunked_array(got[c].chunks, got[c].type).combine_chunks().flatten() if len(got) else [], np.int64)
    bins, n = flat("bins"), flat("n")
    at = np.concatenate([[0], np.cumsum(got["bins"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) if len(got) else np.zeros(1, np.int64)
    m = len(label)
    idf = (np.log((1 + m) / (1 + np.bincount(bins, minlength=BINS))) + 1).astype(np.float32)
    text = np.repeat(np.arange(m), np.diff(at))
    w = weighted(text, bins, n, idf)
    basis = _basis(at, bins, w, min(dims, max(1, m)), seed)
    model = Model(idf, basis, np.zeros((0, basis.shape[1]), np.float32), label, k)
    model.vectors = model.project(text, bins, n, m)
    return model


def _basis(at: np.ndarray, bins: np.ndarray, w: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Leading right singular vectors, by randomised subspace iteration."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(bins, kind="stable")
    back = (np.searchsorted(bins[order], np.arange(BINS + 1)), rows[order], w[order])
    q = np.random.default_rng(seed).standard_normal((BINS, dims + 8)).astype(np.float32)
    for _ in range(3):
        q = np.linalg.qr(times(*back, times(at, bins, w, q)))[0]
    small = times(at, bins, w, q)
    _, _, v = np.linalg.svd(small.T @ small)
    return (q @ v.T[:, :dims]).astype(np.float32)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` for each row of ``docs``; no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.scores(m.project(*features(c), c.n)) for c in chunks(batch.column("text"))]
            yield pa.record_batch([batch.column("id"), batch.column("held_out"), pa.array(np.concatenate(found or [np.zeros(0)]))], ["id", "held_out", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    out = bounded_batches(rows).mapInArrow(work, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classified(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fits on the labelled rows outside the held-out fold and scores every row of ``docs``."""
    return score(docs, fit(docs, labels, **options))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.scores(m.project(*features(c), c.n)) for c in chunks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(found or [np.zeros(0)]) >= threshold))

    return bounded_batches(docs).mapInArrow(work, docs.schema)
