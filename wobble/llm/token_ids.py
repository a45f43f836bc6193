"""Token ids in binary shards (op 6).

A corpus is one array of ids, documents in ascending id order, cut into shards. A shard is

* ``NAME.ids``   its ids, little-endian, 16 bits each if the vocabulary allows and else 32;
* ``NAME.ends``  the end of each document in the shard's array, Elias-Fano coded, with a select structure;
* ``NAME.docs``  the document ids in the same order (they do not decrease), Elias-Fano coded.

``manifest.json`` lists the shards in order with the place of each one's first id in the whole array. A task
writes under a name of its own attempt, and only attempts whose rows reached the manifest count, so a retried
or doubled task leaves no trace. Shards are as many as shuffle partitions.

Texts are encoded by the tokenizers library. Where its file is a byte-level BPE with the usual pattern, a piece
begins before every space and newline that stands between two characters that are no white space, so a batch is cut
there and each different word goes to the library only once while it is remembered; ids are put together as arrays.
A text with white space side by side or at an end goes to the library in parts of some ``PART`` characters.

Defined results: a null or empty text is the end id alone; documents with a null id come first and keep a null
id; rows with equal ids (repeated rows) are kept all, in an order fixed by their texts' hashes; other columns are
ignored; an empty table gives an empty corpus.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .files import opened, read_bytes, write_bytes
from .shared import bounded_batches, shared_dir, text_of, tidied

JOINED, END_ID = 100, 0
#: Bytes of words and ids that an encoder remembers, and words that are put together at a time.
REMEMBERED, BLOCK = 48 << 20, 1 << 18
#: White space, as any of the libraries may see it; a text that has two of these side by side or at an end is not cut.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
ODD = f"{SPACE}{SPACE}|^{SPACE}|{SPACE}$"
#: A place to cut any text: before a space or newline that stands alone between ASCII letters or digits.
SAFE = re.compile(r"[0-9A-Za-z][ \n][0-9A-Za-z]")
#: Characters after which a text that goes to the library as it is gets cut at the next such place.
PART = 1 << 16
#: ASCII punctuation but for the apostrophe, which may begin a contraction.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def safe_parts(text: str) -> Iterator[str]:
    """The text in parts that are encoded alike alone and together."""
    at = 0
    while found := SAFE.search(text, at + PART):
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def taken(source: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` entries of ``source`` from ``start``, end to end."""
    ends = np.cumsum(n)
    return source[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts. Words are remembered as Arrow strings beside one array of ids, some 40 bytes each."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.remembered = remembered
        about = json.loads(self.model.to_str())
        pre, model = about["pre_tokenizer"] or {}, about["model"]
        self.special = [t["content"] for t in about["added_tokens"]]
        self.cuts = (
            about["normalizer"] is None
            and (about["post_processor"] or {"type": "ByteLevel"}).get("type") == "ByteLevel"
            and pre.get("type") == "ByteLevel"
            and bool(pre.get("use_regex", True))
            and not pre.get("add_prefix_space")
            and model["type"] == "BPE"
            and not model.get("dropout")
            and not any(x != "".join(x.split()) for x in self.special)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in about["added_tokens"])
        )
        line = self.whole(["\n"])[0]
        self.cuts = self.cuts and len(line) == 1
        self.newline = line[:1]
        self.tails: dict[str, np.ndarray] = {}
        self.words, self.ids, self.at = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def fetch(self, words: list[str], space: str) -> list[np.ndarray]:
        """Ids of words, ``space`` before each. Many go to the library at a time, a newline between."""
        out: list[np.ndarray] = []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self.whole(["\n".join(space + w for w in g) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) == len(group) - 1:
                at = [-1, *cuts.tolist(), len(ids)]
                out += [ids[a + 1 : b] for a, b in zip(at, at[1:], strict=False)]
            else:  # a word's own ids hold the newline's
                out += self.whole([space + w for w in group])
        return out

    def _learn(self, new: pa.Array) -> None:
        """Remembers words that follow a space and, behind the newline that they begin with, those that follow one."""
        words = new.to_pylist()
        lines = [i for i, w in enumerate(words) if w[:1] == "\n"]
        found: list = [None] * len(words)
        for i, ids in zip(lines, self.fetch([words[i][1:] for i in lines], ""), strict=True):
            found[i] = np.concatenate([self.newline, ids])
        inner = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(inner, self.fetch([words[i] for i in inner], " "), strict=True):
            found[i] = ids
        self.words = pa.concat_arrays([self.words, new])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, *found])

    def _known(self, stems: pa.Array) -> np.ndarray:
        """The places of different words among those remembered; unknown ones are learnt, old ones forgotten if they are too many."""
        places = pc.index_in(stems, self.words)
        if places.null_count:
            if self.words.nbytes + self.ids.nbytes + self.at.nbytes > self.remembered:
                kept = places.drop_null()
                chosen = kept.to_numpy(zero_copy_only=False)
                n = np.diff(self.at)[chosen]
                self.words, self.ids = self.words.take(kept), taken(self.ids, self.at[chosen], n)
                self.at = np.concatenate([[0], np.cumsum(n)])
                places = pc.index_in(stems, self.words)
            new = stems.filter(places.is_null())
            here = places.is_null().to_numpy(zero_copy_only=False)
            out = places.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out[here] = len(self.words) + np.arange(len(new))
            self._learn(new)
            return out
        return places.to_numpy(zero_copy_only=False).astype(np.int64)

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words end to end, and where each word's begin (with the end).

        Punctuation after a letter at a word's end is a piece of its own, so words are remembered without it.
        """
        stems = pc.utf8_rtrim(words, characters=TAIL)
        cut = pc.and_(pc.match_substring_regex(stems, "[A-Za-zÀ-ÖØ-öø-ÿ]$"), pc.not_equal(pc.binary_length(stems), pc.binary_length(words)))
        for x in self.special:
            cut = pc.and_(cut, pc.invert(pc.match_substring(words, x)))
        coded = pc.if_else(cut, stems, words).dictionary_encode()
        place = self._known(coded.dictionary)[coded.indices.to_numpy()]
        n = np.diff(self.at)[place]
        which = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        chosen = pa.array(which)
        tails = [w[k:] for w, k in zip(words.take(chosen).to_pylist(), pc.utf8_length(stems.take(chosen)).to_pylist(), strict=True)]
        if len(self.tails) > 10_000:
            self.tails = {}
        new = list({x for x in tails if x not in self.tails})
        self.tails.update(zip(new, self.whole(new), strict=True))
        more = np.zeros(len(n), np.int64)
        more[which] = [len(self.tails[x]) for x in tails]
        at = np.concatenate([[0], np.cumsum(n + more)])
        table = np.empty(at[-1], self.dtype)
        fill = lambda start, k: np.repeat(start - (np.cumsum(k) - k), k) + np.arange(k.sum())
        table[fill(at[:-1], n)] = taken(self.ids, self.at[place], n)
        if tails:
            table[fill(at[which] + n[which], more[which])] = np.concatenate([self.tails[x] for x in tails])
        return table, at

    def _cut(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, of texts that can be cut before every space and newline; each is taken to follow a newline."""
        kind = texts.type
        lines = pc.binary_join_element_wise(pa.scalar("", kind), pc.replace_substring(texts, "\n", " \n"), pa.scalar("\n", kind))
        units = pc.split_pattern(lines, " ")
        of = units.offsets.to_numpy().astype(np.int64)
        coded = units.flatten().dictionary_encode()
        table, at = self._table(coded.dictionary.cast(pa.string()))
        unit, n = coded.indices.to_numpy(), np.diff(at)
        out = np.concatenate([taken(table, at[unit[i : i + BLOCK]], n[unit[i : i + BLOCK]]) for i in range(0, len(unit), BLOCK)])
        ends = np.concatenate([[0], np.cumsum(n[unit])])[of - of[0]]
        # the newline that each text but the first begins with gives its place to the end id of the one before
        out[ends[:-1]] = end
        return np.concatenate([out[1:], end]), np.diff(ends)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end_id`` after each, and how many ids each has."""
        end = np.array([end_id], self.dtype)
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        if not odd.any():
            return self._cut(texts, end)
        plain = np.flatnonzero(~odd)
        ids, n = self._cut(texts.take(pa.array(plain)), end) if len(plain) else (end[:0], np.zeros(0, np.int64))
        parts: list = [None] * len(texts)
        for i, x in zip(plain, np.split(ids, np.cumsum(n)), strict=False):
            parts[i] = x
        for i in np.flatnonzero(odd):
            text = texts[int(i)].as_py()
            parts[i] = np.concatenate([*self.whole([*safe_parts(text)] if self.cuts else [text]), end])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Bytes of text that a task of the shuffle gets about, and documents and ids after which a shard ends (with the batch).
TASK_BYTES, SHARD_DOCS, SHARD_IDS = 256 << 20, 1 << 21, 1 << 28


class Shard:
    """A shard being written: ids go to their file as they come; ends and names, ``SHARD_DOCS`` and a batch's at most, wait to be coded."""

    def __init__(self, out: str, part: int, at: int, width: int):
        self.base, self.width = f"{out}/{part:06d}-{at:04d}-{uuid.uuid4().hex}", width
        self.about = {"part": part, "at": at, "name": self.base.rsplit("/", 1)[1]}
        self.ends, self.names, self.n_docs, self.n_null, self.n_ids = [], [], 0, 0, 0
        store, path = opened(f"{self.base}.ids")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = store.open_output_stream(path)

    def add(self, names: pa.Array, coded: np.ndarray, n: np.ndarray) -> None:
        self.file.write(coded.data)
        self.ends.append(self.n_ids + np.cumsum(n))
        self.names.append(names.drop_null().to_numpy(zero_copy_only=False))
        self.n_docs, self.n_null, self.n_ids = self.n_docs + len(names), self.n_null + names.null_count, self.n_ids + int(n.sum())

    def full(self, most: tuple[int, int]) -> bool:
        return self.n_docs >= most[0] or self.n_ids >= most[1]

    def close(self) -> pa.RecordBatch:
        """Writes what waited; the shard's entry."""
        self.file.close()
        write_bytes(f"{self.base}.ends", EliasFano.encode(np.concatenate(self.ends)).tobytes())
        write_bytes(f"{self.base}.docs", EliasFano.encode(np.concatenate(self.names)).tobytes())
        return pa.RecordBatch.from_pylist([self.about | {"n_docs": self.n_docs, "n_null": self.n_null, "n_ids": self.n_ids, "width": self.width}])


def write_corpus(docs: DataFrame, tokenizer: str, out: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", most: tuple[int, int] = (SHARD_DOCS, SHARD_IDS)) -> dict:
    """Writes the corpus below ``out`` and returns its manifest (one entry a shard).

    One shuffle: the texts, by ranges of ids and hash, in as many tasks as their bytes ask for. A task begins a new shard
    after ``most`` documents or ids.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    # the hash lets different texts of one id, or of none, go to several tasks
    rows = rows.repartitionByRange(tasks, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    @tidied
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            coded, n = model.encode(batch.column("text"), end_id)
            shard = shard or Shard(out, part, at, model.dtype.itemsize)
            shard.add(batch.column("id"), coded, n)
            if shard.full(most):
                yield shard.close()
                shard, at = None, at + 1
        if shard:
            yield shard.close()

    done = bounded_batches(rows).mapInArrow(write, "part bigint, at bigint, name string, n_docs bigint, n_null bigint, n_ids bigint, width bigint").collect()
    shards, start = [], 0
    for r in sorted(done, key=lambda r: (r.part, r.at)):
        shards.append({"name": r.name, "n_docs": r.n_docs, "n_null": r.n_null, "n_ids": r.n_ids, "width": r.width, "start": start})
        start += r.n_ids
    manifest = {"format": 1, "end_id": end_id, "n_ids": start, "shards": shards}
    write_bytes(f"{out}/manifest.json", json.dumps(manifest).encode())
    return manifest


#: Bytes of ids, and documents, that are read at a time; a longer document is read alone.
READ, DOCS = 4 << 20, 1 << 13


def read_corpus(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``id, start, n_tokens, ids_crc32, width, ids`` of each document, from the files. ``ids`` is binary, as stored, or null.

    Boundaries stay coded: select finds where a window of documents ends, and only that window is decoded.
    """
    manifest = json.loads(read_bytes(f"{path}/manifest.json"))
    schema = f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint, width bigint, ids binary"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(s["name"], s["n_null"], s["width"], s["start"]) for s in manifest["shards"]], "name string, n_null bigint, width bigint, start bigint")

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (s for b in batches for s in b.to_pylist()):
            ends = EliasFano.frombytes(read_bytes(f"{path}/{s['name']}.ends"))
            docs = EliasFano.frombytes(read_bytes(f"{path}/{s['name']}.docs"))
            store, file = opened(f"{path}/{s['name']}.ids")
            width, nulls, done, begin = s["width"], s["n_null"], 0, 0
            with store.open_input_file(file) as f:
                while done < ends.n:
                    upto = min(done + DOCS, max(done + 1, ends.upto(begin + READ // width, done)))
                    at = np.concatenate([[begin], ends.window(done, upto)])
                    data = memoryview(f.read(int(at[-1] - begin) * width))
                    wide = data if width == 4 else memoryview(np.frombuffer(data, f"<u{width}").astype("<u4")).cast("B")
                    cuts = (at - begin).tolist()
                    crc = [zlib.crc32(wide[a * 4 : b * 4]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    ids = [bytes(data[a * width : b * width]) for a, b in zip(cuts, cuts[1:], strict=False)] if with_ids else [None] * len(crc)
                    named = docs.window(max(done, nulls) - nulls, max(upto, nulls) - nulls)
                    name = pa.concat_arrays([pa.nulls(upto - done - len(named), pa.int64()), pa.array(named, pa.int64())])
                    yield pa.record_batch(
                        [name, pa.array(s["start"] + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([width] * len(crc), pa.int64()), pa.array(ids, pa.binary())],
                        [id_col, "start", "n_tokens", "ids_crc32", "width", "ids"],
                    )
                    begin, done = int(at[-1]), upto

    return shards.repartition(len(manifest["shards"])).mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` to the shared folder and returns what the files say of each document."""
    spark = docs.sparkSession
    out = shared_dir(spark, "ids")
    write_corpus(docs, tokenizer, out, id_col=id_col, text_col=text_col)
    return read_corpus(spark, out, id_col, with_ids=False).select(id_col, "start", "n_tokens", "ids_crc32")
