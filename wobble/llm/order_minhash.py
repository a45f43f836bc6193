"""Near-duplicate classes by Order MinHash (op 8).

A text is the sequence of its five-word shingles, each labelled with how often it occurred before in that text,
so that no element repeats. Order MinHash takes for each of ``SKETCHES`` hash functions the ``TAKEN`` labelled
shingles with the smallest values and keeps them in the order of the text; their hash is a bucket key, and texts
are likelier to share one the more of their sequences agree in order. Candidates are verified by banded alignment: the longest common
subsequence of the two sequences (with no element repeated: the longest increasing run of matched places), within
a band as wide as the threshold allows, must be at least 0.8 of the longer sequence.

Equal texts are one node, found by their MD5. In a bucket every node is compared with one leader, the node with
the smallest hash, which is mostly the same in all buckets of a group; nodes that are not found similar are
compared with two more leaders of the bucket. This links most of a group with as many pairs as the bucket has nodes.
The nodes of every bucket that still holds more than one group are then compared across groups (first with one node of
an element's largest group, then, across the groups still apart, with all), without a bound on their number: two sequences that agree in 0.8 of the longer one share an element among the first ``n - ceil(0.8 n) +
1`` of each in any common order of elements, and here common elements come last, so that texts which share a licence
or a template meet only if they share something rarer too. No pair of a bucket that could reach the threshold is left
out, and no bucket is gathered anywhere. Classes are connected components of verified pairs.

Words are runs of ASCII letters and digits and bytes beyond ASCII, ASCII letters in lower case. Defined results: a
text of one to four words has one shingle, all its words; texts without a word are alike only if equal; a null
text is a class of its own; the class id is the smallest id of the class, so of equal ids (repeated rows) all
carry the same; a null id counts only where no other is; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .decontamination import small
from .kernels import BASE, Chunk, chunks, found_runs, mixed
from .shared import bounded_batches, heavy_keys, matched, scratch, stored, stored_by, tidied

WORDS, THRESHOLD, SKETCHES, TAKEN = 5, 0.8, 16, 3
#: Nodes that an element may occur in before it counts as common (this orders elements, it leaves out none).
COMMON = 16
#: Bytes of words; lower case of ASCII letters.
LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def labelled(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The labelled shingles of a chunk's texts, in order, and where each text's begin (with the end)."""
    start, _, h, _ = found_runs(c, LETTER, mapped=LOWER)
    owner = c.owner(start)
    at = np.searchsorted(owner, np.arange(c.n + 1))
    n = np.diff(at)
    first = np.flatnonzero((np.arange(len(h)) + WORDS <= at[owner + 1]) | ((np.arange(len(h)) == at[owner]) & (n[owner] < WORDS)))
    key = np.zeros(len(first), np.uint64)
    for i in range(WORDS):
        place = np.minimum(first + i, len(h) - 1)
        inside = first + i < at[owner[first] + 1]
        key = mixed(key * BASE + np.where(inside, h[place], np.uint64(i + 1)), 4)
    text = owner[first]
    grouped = mixed(key ^ mixed(text.astype(np.uint64), 5), 6)
    order = np.argsort(grouped, kind="stable")
    g = grouped[order]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
    times = np.empty(len(g), np.uint64)
    times[order] = rank
    return mixed(key + times * np.uint64(0x9E3779B97F4A7C15), 7), np.searchsorted(text, np.arange(c.n + 1))


def sketch_keys(labels: np.ndarray, at: np.ndarray, sketches: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """A row of bucket keys for each text that has a shingle."""
    full = np.flatnonzero(np.diff(at))
    seg, n = at[:-1][full], np.diff(at)[full]
    keys = np.empty((len(full), sketches), np.int64)
    if not len(full):
        return keys
    rows = np.repeat(np.arange(len(full)), n)
    for s in range(sketches):
        value = mixed(labels, 100 + s)
        places = np.full((len(full), taken), np.iinfo(np.int64).max)
        for t in range(taken):
            least = np.minimum.reduceat(value, seg)
            hit = np.flatnonzero((value == least[rows]) & (n > t)[rows])
            places[rows[hit], t] = hit
            value[hit] = LAST
        places.sort(axis=1)
        key = np.full(len(full), s, np.uint64)
        for t in range(taken):
            there = places[:, t] < len(labels)
            key = mixed(key * BASE + np.where(there, labels[np.where(there, places[:, t], 0)], np.uint64(t)), 8)
        keys[:, s] = key.view(np.int64)
    return keys


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Banded alignment of two sequences of distinct elements: the share of the longer one that is matched in order; 0 below the threshold."""
    longer = max(len(a), len(b))
    need = threshold * longer
    if not longer or min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= longer - need  # a matched place further off leaves too few others
    if np.count_nonzero(near) < need:
        return 0.0
    i, j = i[near], j[near]
    i = i[np.argsort(j)]
    if (np.diff(i) > 0).all():
        n = len(i)
    else:
        tails: list[int] = []
        for x in i.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        n = len(tails)
    return n / longer if n >= need else 0.0


def _sketched(texts: DataFrame) -> DataFrame:
    """``node, n, keys`` for each row of ``node, text`` with a shingle."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                labels, at = labelled(c)
                keys, full = sketch_keys(labels, at), np.flatnonzero(np.diff(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * SKETCHES, pa.int32()), pa.array(keys.ravel()))
                yield pa.record_batch([batch.column("node").take(pa.array(c.first + full)), pa.array(np.diff(at)[full].astype(np.int64)), lists], ["node", "n", "keys"])

    return bounded_batches(texts).mapInArrow(work, "node binary, n bigint, keys array<bigint>")


def _sequences(texts: DataFrame) -> DataFrame:
    """``node, seq`` for each row of ``node, text``: its labelled shingles, 8 bytes each."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                labels, at = labelled(c)
                seq = [labels[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                yield pa.record_batch([batch.column("node").slice(c.first, c.n), pa.array(seq, pa.binary())], ["node", "seq"])

    return bounded_batches(texts).mapInArrow(work, "node binary, seq binary")


def _verified(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose alignment reaches the threshold. The pairs of a node that has very many meet its sequence in many tasks."""
    pairs = stored(pairs, "pairs")
    heavy = heavy_keys(pairs, ["a"])
    seq_a = sequences.withColumnsRenamed({"node": "a", "seq": "seq_a"})
    rows = pairs.join(sequences.withColumnsRenamed({"node": "b", "seq": "seq_b"}), "b")
    hot = F.xxhash64("a").isin(heavy) if heavy else F.lit(False)
    near = rows.where(~hot).join(seq_a, "a")
    if heavy:
        near = near.unionByName(matched(rows.where(hot), seq_a.where(hot), ["a"], heavy=heavy))
    rows = near

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("seq_a"), batch.column("seq_b"), strict=True)
            ok = [similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in p), threshold) > 0 for p in both]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return stored(bounded_batches(rows.select("a", "b", "seq_a", "seq_b")).mapInArrow(work, "a binary, b binary"), "links")


def _elements(sequences: DataFrame) -> DataFrame:
    """``node, n, e``: a row per element of each of the ``node, seq`` rows."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("seq")]
            n = np.array([len(x) for x in seqs], np.int64)
            at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int64), *seqs])))
            yield pa.record_batch([batch.column("node"), pa.array(n), lists], ["node", "n", "es"])

    rows = bounded_batches(sequences.select("node", "seq")).mapInArrow(work, "node binary, n bigint, es array<bigint>")
    return rows.select("node", "n", F.explode("es").alias("e"))


def _prefixes(sequences: DataFrame, threshold: float) -> DataFrame:
    """``node, n, e, place``: of each sequence so many elements, common ones last, that similar sequences share one."""
    elements = stored(_elements(sequences), "elements")
    common = stored(elements.groupBy("e").agg(F.count("*").alias("times")).where(F.col("times") > COMMON), "common")
    ordered = elements.join(small(common, 64 * common.count()), "e", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "e"))
    first = ordered.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    return stored(first.select("node", "n", "e", "place"), "prefixes")


def _across(prefixes: DataFrame, groups: DataFrame, sequences: DataFrame, threshold: float, every: bool) -> DataFrame:
    """Pairs ``a, b`` of labels in ``groups`` (``node, label``) that have similar nodes.

    Compared are, by shared element, the nodes outside its largest group with all nodes of other groups (``every``), or
    all nodes with one of the largest group.
    """
    named = stored(prefixes.join(groups, "node"), "labelled")
    sizes = named.groupBy("e", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("e").agg(F.max_by("label", "size").alias("main"), F.count("*").alias("labels")).where("labels > 1").select("e", "main")
    shared = stored(matched(named, main, ["e"]), "shared")
    columns = ("node", "n", "place", "label")
    if every:
        a = shared.where("label <> main")
    else:
        least = F.min(F.struct(F.xxhash64("e", "node").alias("h"), *columns)).alias("l")
        a = shared.where("label = main").groupBy("e").agg(least).select("e", *(F.col(f"l.{c}").alias(c) for c in columns))
    a, b = (x.select("e", *(F.col(c).alias(f"{c}_{name}") for c in columns)) for x, name in ((a, "a"), (shared, "b")))
    # what follows the first shared element must suffice for both
    enough = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1 >= threshold * F.greatest("n_a", "n_b") - 1e-9
    # an element has one `a` unless all are wanted
    pairs = (a.join(b, "e") if every else matched(b, a, ["e"])).where("label_a <> label_b").where(enough)
    similar_ = _verified(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), sequences, threshold)
    for x in "ab":
        similar_ = similar_.join(groups.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), x)
    return stored(similar_.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "across")


def links(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``a, b`` among distinct ``node, text`` rows that connect every class: similar nodes, or nodes of two groups that have similar ones."""
    sketches = _sketched(texts)
    rows = stored(sketches.select("node", "n", F.explode("keys").alias("key")), "buckets")
    h = F.xxhash64("node")
    lead = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(h.alias("h"), "node", "n")).alias("l")).where("size > 1")
    lead = lead.select("key", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n"))
    members = stored(matched(rows, lead, ["key"]), "members")
    heavy = heavy_keys(members, ["key"])  # a template's buckets
    candidate = members.where("node <> leader").where(F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n"))
    pairs = candidate.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    nodes = stored(members.select("node").distinct(), "candidates")
    sequences = stored_by(_sequences(texts.join(nodes, "node", "left_semi")), "node", "sequences")
    first = _verified(pairs, sequences, threshold)

    # nodes that a bucket's leader is not similar to meet two more leaders of that bucket
    left = members.where("node <> leader").join(first.select(F.col("a").alias("leader"), F.col("b").alias("node")), ["leader", "node"], "left_anti")
    left = stored(left.select("key", "node", "n"), "left")
    own = F.xxhash64("key", "node")
    any_ = matched(members, left.select("key").distinct(), ["key"], "left_semi", heavy).groupBy("key").agg(F.max(F.struct(own.alias("h"), "node", "n")).alias("l"))
    among = left.groupBy("key").agg(F.min(F.struct(own.alias("h"), "node", "n")).alias("l"))
    more = any_.unionByName(among).groupBy("key").agg(F.collect_list(F.struct(F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n"))).alias("ls"))  # two
    again = matched(left, more, ["key"], heavy=heavy).select("key", "node", "n", F.inline("ls")).where("node <> leader").where(F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n"))
    again = again.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    second = _verified(again, sequences, threshold)
    found = first.unionByName(second)

    # buckets that still hold more than one group: their nodes are compared across groups
    labels = components(found)
    named = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    named = stored(named, "named")
    mixed_ = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    groups = stored(matched(named, mixed_, ["key"], "left_semi", heavy).select("node", "label").distinct(), "groups")
    prefixes = _prefixes(sequences.join(groups, "node", "left_semi"), threshold)
    some = _across(prefixes, groups, sequences, threshold, every=False)
    merged = components(some).select(F.col("node").alias("label"), F.col("label").alias("merged"))
    groups = stored(groups.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label")), "groups")
    return found.unionByName(some).unionByName(_across(prefixes, groups, sequences, threshold, every=True))


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``id, node, class`` for each row of ``docs``: node and class are null for a null text. Stored."""
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        rows = rows.withColumn("node", F.unhex(F.md5("text")))
        ids = stored(rows.select("id", "node"), "nodes")
        texts = rows.where("node is not null").select("node", "text")
        # of equal texts one goes on; the largest groups of copies are thinned before the shuffle
        distinct = stored_by(texts.groupBy("node").agg(F.first("text").alias("text")), "node", "texts")
        labels = components(links(distinct, threshold))
        named = matched(ids, labels, ["node"], "left").withColumn("class", F.coalesce("label", "node"))
        return keep(stored(named.select("id", "node", "class"), "classes"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id, class_size`` for each row of ``docs``."""
    named = _classes(docs, threshold, id_col, text_col)
    sizes = named.where("class is not null").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    out = matched(named, sizes, ["class"], "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns: of each class one row, with the smallest id.

    Rows are told apart by id and text. A row with a null id is kept only if its class has no other id; every row with
    a null text is a class of its own and is kept.
    """
    with scratch(docs.sparkSession) as hold:
        named = _classes(docs, threshold, id_col, text_col).where("class is not null")
        each = named.groupBy("class", "id", "node").agg(F.count("*").alias("n"))
        least = each.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "n")).alias("l"))
        keep = hold(stored(least.select(F.col("l.id").alias("_id"), F.col("l.node").alias("_node"), F.col("l.n").alias("_n")), "kept"))
    digest = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    rows = docs.withColumn(digest, F.unhex(F.md5(F.col(text_col).cast("string"))))

    def of(kept: DataFrame) -> DataFrame:
        return rows.join(kept, (rows[digest] == kept["_node"]) & rows[id_col].eqNullSafe(kept["_id"]), "left_semi")

    once = of(keep.where("_n = 1")).drop(digest)
    repeated = of(keep.where("_n > 1")).dropDuplicates([id_col, digest]).drop(digest)
    return once.unionByName(repeated).unionByName(docs.where(F.col(text_col).isNull()))
