"""Rule bitmask ledger (op 3): every rule is evaluated once; its failure bit and the measurements are stored.

:func:`ledger` reads each text once and writes measurements and one bit per rule to the shared folder; all that follows
reads those rows, not the texts. A policy is a named, versioned set of rules; :func:`applied` is a bitwise test of the
stored mask, and :func:`ablations` adds up, for every rule of a policy, what it alone removes, from counts per distinct
mask. A text of any length is walked piece by piece; what is kept of it is some bytes a word and a line.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Lines are
split at line feeds. Defined results: a null text has measurements of an empty one and fails ``few_words``; a
null id stays null; repeated rows get a row each; ties do not arise (rows do not depend on each other); other
columns are ignored; an empty table gives an empty ledger, and no ablations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import BASE, SPACE, Chunk, chunks, counts, found_runs, grouped_counts, mixed
from .shared import bounded_batches, stored, text_of, tidied

MEASURES = ("n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bare_words")
SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
UPPER = np.isin(np.arange(256), range(ord("A"), ord("Z") + 1))
#: Bytes that make a word more than punctuation: ASCII letters, digits, and all beyond ASCII.
SOLID = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
#: Bytes that begin a character of a word.
POINT = np.array([not SPACE[b] and b & 0xC0 != 0x80 for b in range(256)])
FEED = np.arange(256) == 10
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A rule's bit and when a document fails it, over the measurements."""

    bit: int
    name: str
    fails: Column | str


#: Bits keep their meaning for ever; a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule(4, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(5, "capitals", "2 * n_upper > word_chars"),
    Rule(6, "bare_words", "5 * n_bare_words > n_words"),
)
#: Versioned policies: names of the rules that must not fail.
POLICIES = {
    "base": {1: ("few_words", "repeated_words")},
    "text": {
        1: ("few_words", "repeated_words", "symbols", "word_length", "duplicate_lines", "capitals", "bare_words"),
        2: ("few_words", "repeated_words", "symbols", "word_length", "duplicate_lines"),
    },
}


def _counts(c: Chunk) -> list[np.ndarray]:
    n, total = c.n, np.diff(c.at)
    start, end, h, solid = found_runs(c, ~SPACE, counted=SOLID)
    owner = c.owner(start)
    words = grouped_counts(owner, None, n)
    points, symbols, upper, feeds = counts(c, POINT, SYMBOL, UPPER, FEED)
    bare = grouped_counts(owner[solid == 0], None, n)

    # lines with a word that equal an earlier line of their text; a line without a byte has none
    first, last, key, _ = found_runs(c, ~FEED)
    full = np.searchsorted(start, last, "left") > np.searchsorted(start, first, "left")
    line_of = c.owner(first[full])
    key = mixed(key[full] ^ mixed(line_of.astype(np.uint64), 1))
    _, at = np.unique(key, return_index=True)
    dup = grouped_counts(line_of, None, n) - grouped_counts(line_of[at], None, n)

    # words in windows that their text holds twice or more
    repeated = np.zeros(n, np.int64)
    if len(start) >= WINDOW:
        m = len(h) - WINDOW + 1
        key = mixed(owner[:m].astype(np.uint64), 2)
        for i in range(WINDOW):
            key = mixed(key * BASE + h[i : i + m], 3)
        inside = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
        order = inside[np.argsort(key[inside], kind="stable")]
        k = key[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(h), bool)
        for i in range(WINDOW):
            covered[order[twice] + i] = True
        repeated = grouped_counts(owner[covered], None, n)
    return [total, words, points, symbols, feeds + 1, dup, repeated, upper, bare]


def measure_arrays(c: Chunk) -> dict[str, np.ndarray]:
    """The measurements of a chunk's texts by name."""
    return dict(zip(MEASURES, _counts(c), strict=True))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of each row's text, in one pass over the bytes; no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counts(c) for c in chunks(batch.column("text"))]
            cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(MEASURES)
            yield pa.record_batch([batch.column("id"), *(pa.array(x.astype(np.int64)) for x in cols)], ["id", *MEASURES])

    kind = rows.schema["id"].dataType.simpleString()
    out = bounded_batches(rows).mapInArrow(work, f"id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return out.withColumnRenamed("id", id_col)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored ledger: a row per document with its measurements and ``failed``, the bits of the rules that fail."""
    mask = F.lit(0).cast("long")
    for r in rules:
        fails = F.expr(r.fails) if isinstance(r.fails, str) else r.fails
        mask = mask.bitwiseOR(F.when(fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return stored(measured(docs, id_col, text_col).withColumn("failed", mask), "ledger")


def bits(policy: str, version: int, rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[name] for name in POLICIES[policy][version])


def applied(failed: Column, policy: str, version: int) -> Column:
    """Whether a mask passes the policy."""
    return failed.bitwiseAND(F.lit(bits(policy, version))) == 0


def ablations(rows: DataFrame, policy: str, version: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it removes, and that the policy without it keeps.

    The ledger is added up by distinct mask first, so what follows has at most ``2 ** rules`` rows.
    """
    all_bits = bits(policy, version, rules)
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(all_bits)).alias("m")).agg(F.count("*").alias("n"))
    named = [r for r in rules if all_bits >> r.bit & 1]
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in named)))
    one = masks.select("m", "n", each.alias("r")).select("m", "n", "r.rule", "r.b")
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    m, b = F.col("m"), F.col("b")
    return one.groupBy("rule").agg(
        n(m.bitwiseAND(b) != 0).alias("n_failed"), n(m == b).alias("n_only"), n(m.bitwiseAND(F.bitwise_not(b)) == 0).alias("n_kept_without")
    )
