"""Vectorised kernels over Arrow batches of texts: one pass of NumPy over the bytes of many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random 64-bit value for each byte.
BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=U64) | U64(1)
#: Bytes of text that are worked on at a time; a longer text is walked piece by piece.
CHUNK = 1 << 18

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if len(_powers["up"]) < n:
        for name, by in (("up", BASE), ("down", INVERSE)):
            x = np.full(max(n, 2 * CHUNK), by, U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer; other salts give other functions."""
    x = x ^ U64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64))
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Chunk:
    """Some texts of a batch, end to end: their bytes, and where each begins (the last entry is the end)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first, self.n = data, at, first, len(at) - 1

    def sums(self) -> np.ndarray:
        """Prefix sums of the bytes' values times powers, one more than there are bytes."""
        up, _ = powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, U64)
        np.cumsum(BYTE[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each maximal run of bytes marked ``inside``; runs end with their text."""
        edge = np.zeros(len(self.data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[self.at] = True
        cuts = np.flatnonzero(edge)
        keep = inside[cuts[:-1]] if len(inside) else np.zeros(0, bool)
        return cuts[:-1][keep], cuts[1:][keep]

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The text, from 0, that holds each byte place."""
        return np.searchsorted(self.at, places, "right") - 1


def raw_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of each range's bytes; that of two ranges end to end is the first's plus the second's times BASE**(first's length)."""
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range."""
    return mixed(raw_hashes(sums, start, end) + (end - start).astype(U64))


def pieces(c: Chunk, limit: int | None = None) -> Iterator[tuple[int, Chunk]]:
    """The chunk in pieces that fit, with the place of each; only a single long text is cut."""
    limit = limit or CHUNK
    if c.n != 1 or len(c.data) <= 2 * limit:
        yield 0, c
        return
    for o in range(0, len(c.data), limit):
        data = c.data[o : o + limit]
        yield o, Chunk(data, np.array([0, len(data)]), c.first)


def found_runs(c: Chunk, inside: np.ndarray, mapped: np.ndarray | None = None, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the maximal runs of bytes of the table ``inside``, and how many bytes of ``counted`` each has.

    ``mapped`` replaces bytes first. Memory beyond the result is that of a piece, however long a text is.
    """
    out = []
    for o, p in pieces(c):
        q = p if mapped is None else Chunk(mapped[p.data], p.at, p.first)
        start, end = q.runs(inside[q.data])
        raw = raw_hashes(q.sums(), start, end)
        n = np.zeros(len(start), np.int64)
        if counted is not None:
            seen = np.concatenate([[0], np.cumsum(counted[q.data])])
            n = seen[end] - seen[start]
        out.append((start + o, end + o, raw, n))
    start, end, raw, n = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(out) > 1:  # runs that go on in the next piece
        keep = np.ones(len(start), bool)
        for i in np.flatnonzero(start[1:] == end[:-1]).tolist():
            head = i if keep[i] else head  # noqa: F821  a run of several pieces grows from its first
            raw[head] = (int(raw[head]) + int(raw[i + 1]) * pow(int(BASE), int(end[head] - start[head]), 1 << 64)) % (1 << 64)
            end[head], n[head], keep[i + 1] = end[i + 1], n[head] + n[i + 1], False
        start, end, raw, n = start[keep], end[keep], raw[keep], n[keep]
    return start, end, mixed(raw + (end - start).astype(U64)), n


def counts(c: Chunk, *tables: np.ndarray) -> list[np.ndarray]:
    """Of each text, how many of its bytes are in each table."""
    if c.n == 1:
        return [np.array([sum(int(np.count_nonzero(t[p.data])) for _, p in pieces(c))]) for t in tables]
    return [np.diff(np.concatenate([[0], np.cumsum(t[c.data])])[c.at]) for t in tables]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """The texts of a column in order, some at a time; a null is an empty text."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Chunk(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def grouped_counts(owner: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(owner, weights, n).astype(np.int64)


def word_pieces(c: Chunk, limit: int | None = None) -> Iterator[tuple[int, Chunk]]:
    """As :func:`pieces`, but cut before white space if a piece has any: only a word that is longer than a piece comes in several."""
    limit = limit or CHUNK
    if c.n != 1 or len(c.data) <= 2 * limit:
        yield 0, c
        return
    o = 0
    while o < len(c.data):
        data = c.data[o : o + limit]
        if o + limit < len(c.data):
            gaps = np.flatnonzero(SPACE[data[1:]])
            data = data[: int(gaps[-1]) + 1] if len(gaps) else data
        yield o, Chunk(data, np.array([0, len(data)]), c.first)
        o += len(data)
