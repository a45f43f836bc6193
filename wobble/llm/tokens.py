"""Token counts (op 9): batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and every text is cut at safe boundaries before it goes to the library, so that a long
one is never encoded at once.

* ``.model`` files: a boundary is safe at a space that follows a character which is neither a space nor the space
  mark, unless the text ends there, provided that no piece of the vocabulary holds the mark after another character
  and that white space is not rewritten (both are checked when the model is loaded): the leading mark that the
  encoder adds replaces that space, so the parts' lengths add up to the text's.
* ``.json`` files: byte-level BPE with the usual pattern is cut as in :mod:`.token_ids`; one that drops white space
  before it looks at pieces (``WORDS_ONLY``) at white space between two ASCII letters or digits; any other is not cut.

A part without a safe boundary (one very long word) is encoded as it is. Each different part of a batch is encoded
once, and a worker remembers counts up to ``REMEMBERED`` bytes.

Defined results: null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are counted
each; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, text_of, tidied
from .token_ids import PART, Encoder

#: Bytes of different parts that go to the library at once, and of parts that a worker remembers.
BATCH_BYTES, REMEMBERED = 1 << 18, 32 << 20
MARK = "\u2581"
#: The pattern of a pre-tokenizer that keeps runs of letters, single digits and runs of other characters, and drops white space.
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Counter:
    """Counts the tokens of texts by the counts of their parts."""

    def __init__(self) -> None:
        self.parts, self.counts = pa.array([], pa.string()), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[int]:
        raise NotImplementedError

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, and where each text's begin (with the end)."""
        raise NotImplementedError

    def fetched(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        batch: list[str] = []
        size = 0
        for part in parts:
            batch.append(part)
            size += len(part.encode())
            if size >= BATCH_BYTES:
                out += self.encode(batch)
                batch, size = [], 0
        return out + (self.encode(batch) if batch else [])

    def lengths(self, texts: pa.Array) -> np.ndarray:
        parts, at = self.cut(texts)
        coded = parts.dictionary_encode()
        words = coded.dictionary
        places = pc.index_in(words, self.parts)
        new = places.is_null().to_numpy(zero_copy_only=False)
        old = places.fill_null(0).to_numpy(zero_copy_only=False)
        n = self.counts[old] if len(self.counts) else np.zeros(len(words), np.int64)
        if new.any():
            fresh = words.filter(pa.array(new))
            n[new] = self.fetched(fresh.to_pylist())
            if self.parts.nbytes + self.counts.nbytes > REMEMBERED:  # all but this batch's are forgotten
                self.parts, self.counts = words, n
            else:
                self.parts, self.counts = pa.concat_arrays([self.parts, fresh]), np.concatenate([self.counts, n[new]])
        total = np.concatenate([[0], np.cumsum(n[coded.indices.to_numpy()])])
        return np.diff(total[at])


def _listed(lists: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
    return pa.array([x for y in lists for x in y], pa.string()), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])


class SentencePieceCounter(Counter):
    """Token counts of a ``.model`` file."""

    SAFE = re.compile(f"(?<=[^ {MARK}]) (?!\\Z)")

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        gaps = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2003\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
        probes = ["ab cd éi", "a  b", " a", "a ", "a   b  c ", *(f"a{g} b" for g in gaps), *(f"a {g}b" for g in gaps)]
        whole = self.encode(probes)
        parts = [sum(self.encode(self.SAFE.split(x))) for x in probes]
        self.cuts = whole == parts and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not self.cuts:
            return texts, np.arange(len(texts) + 1)
        odd = pc.match_substring_regex(texts, f"  |^ | $|{MARK}")
        if not pc.any(odd, min_count=0).as_py():
            split = pc.split_pattern(texts, " ")
            at = split.offsets.to_numpy().astype(np.int64)
            return split.flatten(), at - at[0]
        # a text with runs of spaces, or with the mark itself
        return _listed([self.SAFE.split(x) for x in texts.to_pylist()])


class TokenizersCounter(Counter):
    """Token counts of a ``.json`` file."""

    SAFE = re.compile(r"(?<=[0-9A-Za-z])\s+(?=[0-9A-Za-z])", re.ASCII)

    def __init__(self, path: str):
        super().__init__()
        self.coder = Encoder(path)
        self.model = self.coder.model
        about = json.loads(self.model.to_str())
        steps = (about["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        first = steps[0]
        self.words_only = (
            first.get("type") == "Split"
            and first["pattern"] == {"Regex": WORDS_ONLY}
            and first["behavior"] == "Removed"
            and first["invert"]
            and about["post_processor"] is None
            and not any(x != "".join(x.split()) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in about["added_tokens"] for x in [t["content"]])
        )

    def encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not self.words_only:
            return texts, np.arange(len(texts) + 1)
        return _listed([self.SAFE.split(x) if len(x) > PART else [x] for x in texts.to_pylist()])

    def lengths(self, texts: pa.Array) -> np.ndarray:
        if self.coder.cuts:
            return self.coder.encode(texts, 0)[1] - 1
        return super().lengths(texts)


@lru_cache(4)
def counter(path: str) -> Counter:
    return SentencePieceCounter(path) if path.endswith(".model") else TokenizersCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for each row of ``docs``; no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    @tidied
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            texts = batch.column("text")
            n = model.lengths(texts)
            yield pa.record_batch([batch.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    id_type = rows.schema["id"].dataType.simpleString()
    out = bounded_batches(rows).mapInArrow(counted, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
