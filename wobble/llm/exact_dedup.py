"""Exact duplicates by a 128-bit content hash, compared byte by byte (op 11), in DataFrame functions only.

Rows are grouped by the MD5 of their text. Only texts whose hash occurs again are read a second time: in each group the
smallest and the largest text, byte by byte, are the same if and only if all its texts are, so one row per group and task
is shuffled and no group is gathered. Hashes whose texts differ are settled by the texts themselves, which then are part of
the group's key. In a group one row stays: that with the smallest stable id, or the largest if asked for.

Groups meet their rows again through a broadcast if they are small in bytes (counted), else in a join that deals the rows of
heavy groups to many tasks.

Two texts are equal if they are byte for byte, or with ``folded`` if they are once A to Z are lower-cased, and no other
letter. Defined results: null is the empty text, and all empty texts are equal. A null id is after all others, so it stays
only in a group without any other; of rows with the id that stays, repeated rows among them, one does. Other columns,
whatever their names, are ignored by :func:`exact_duplicates` and kept by :func:`deduplicated`; empty tables give empty
results.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import _total, small
from .shared import matched, scratch, stored, text_of


def folded_text(text: Column) -> Column:
    """``text`` with A to Z, and no other letter, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def _read(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``r, id, t`` with the hash ``h``."""
    return rows.select("r", "id", "t", digest(F.col("t")).alias("h"))


def _groups(rows: DataFrame, smallest: bool, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Rows ``r, id, h, x, s`` of ``r, id, t``, and of each group of two or more ``h, x, n, best``. Both stored.

    ``x`` is empty but for hashes that texts share which differ; ``s`` is the SHA-256; ``best`` has ``id`` and ``r`` of
    the row that stays.
    """
    with scratch(rows.sparkSession) as keep:
        narrow = _read(rows, digest).select("r", "id", "h", F.lit("").alias("x"), F.unhex(F.sha2("t", 256)).alias("s"))
        narrow = stored(narrow, "hashed")
        again = stored(narrow.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
        texts = _read(rows, digest).join(small(again, _total(again, 64)), "h", "left_semi")
        ends = texts.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high"))
        unlike = stored(ends.where("low <> high").select("h"), "collisions")
        if not unlike.isEmpty():
            few = small(unlike, _total(unlike, 64))
            apart = _read(rows, digest).join(few, "h", "left_semi").select("r", "id", "h", F.col("t").alias("x"), F.unhex(F.sha2("t", 256)).alias("s"))
            narrow = stored(narrow.join(few, "h", "left_anti").unionByName(apart), "settled")
        # nulls are last either way; of equal ids it is the row's number that decides
        order = F.struct(F.isnull("id").alias("none"), "id", "r") if smallest else F.struct(F.isnotnull("id").alias("some"), "id", "r")
        best = (F.min if smallest else F.max)(order).alias("best")
        groups = narrow.groupBy("h", "x").agg(F.count("*").alias("n"), best).where("n > 1")
        return keep(narrow), keep(stored(groups, "groups"))


def _judged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``r, id, s, n, best`` of all rows; the last two are null for a row whose text is the only one of its kind."""
    n_bytes = _total(groups, 96, "x")
    near = small(groups, n_bytes)
    return rows.join(near, ["h", "x"], "left") if near is not groups else matched(rows, groups, ["h", "x"], "left")


def _normal(text_col: str, folded: bool) -> Column:
    return folded_text(text_of(text_col)) if folded else text_of(text_col)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True, folded: bool = False, digest: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """A row per document: its id, ``keep_id`` (the id that stays), ``group_size``, ``kept``, ``text_sha256``."""
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), _normal(text_col, folded).alias("t"))
    out = _judged(*_groups(rows, smallest, digest))
    alone = F.isnull("n")
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best.r") == F.col("r"))).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"),
    )


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True, folded: bool = False, digest: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all columns."""
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    with scratch(docs.sparkSession) as keep:
        whole = keep(stored(docs.withColumn(own, F.monotonically_increasing_id()), "numbered"))
        rows = whole.select(F.col(own).alias("r"), F.col(id_col).alias("id"), _normal(text_col, folded).alias("t"))
        out = _judged(*_groups(rows, smallest, digest))
        gone = keep(stored(out.where(F.col("best.r") != F.col("r")).select(F.col("r").alias(own)), "gone"))
    return whole.join(small(gone, _total(gone, 40)), own, "left_anti").drop(own)
