"""Texts walked piece by piece give what they give as a whole; memory of very long ones."""

import random

import numpy as np
import pyarrow as pa
import pytest

from wobble.llm import kernels, order_minhash, quality_knn, quality_rules, repeats

rng = random.Random(1)
BITS = ["ab", "c", "\n", " ", "  ", "#", "Ü", "word", "the ", "a b a b "]
TEXTS = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 1500))) for _ in range(12)] + ["x" * 4000, " " * 1500, "\n" * 1500, "ab " * 900, ""]


def chunk(text):
    return next(kernels.chunks(pa.array([text])))


def found(text):
    c = chunk(text)
    labels, at = order_minhash.labelled(c)
    return [x.tolist() for x in quality_rules._counts(c)], labels.tolist(), at.tolist()


@pytest.mark.parametrize("piece", [1, 7, 100, 1000])
def test_pieces_give_the_whole(monkeypatch, piece):
    whole = [found(t) for t in TEXTS]
    together = [np.concatenate(x).tolist() for x in zip(*(quality_rules._counts(c) for c in kernels.chunks(pa.array(TEXTS))))]
    assert [[w[0][i][0] for w in whole] for i in range(len(together))] == together
    monkeypatch.setattr(kernels, "CHUNK", piece)
    assert [found(t) for t in TEXTS] == whole


def test_features_of_pieces(monkeypatch):
    """Words are not cut where there is white space."""
    whole = [[x.tolist() for x in quality_knn.features(chunk(t))] for t in TEXTS if len(t) != 4000]
    monkeypatch.setattr(kernels, "CHUNK", 64)
    assert [[x.tolist() for x in quality_knn.features(chunk(t))] for t in TEXTS if len(t) != 4000] == whole


def test_windows_of_pieces():
    """Every window lies in one run, whose gram is the same however the text is cut."""
    text = "".join(rng.choice("abcdef ") for _ in range(3000))

    def grams(limit):
        out = {}
        for o, p in repeats.overlapping(chunk(text), limit=limit):
            _, g, _, _, place, size, _ = repeats.runs(p)
            for h, a, n in zip(g.tolist(), place.tolist(), size.tolist()):
                for w in range(o + a, o + a + n - repeats.LENGTH + 1):
                    assert w not in out
                    out[w] = h
        return out

    assert grams(400) == grams(1 << 20) and len(grams(400)) == len(text) - repeats.LENGTH + 1


def test_very_long_texts():
    """20 MB in a text: the arrays that are kept are some bytes a word, not a byte."""
    import tracemalloc

    text = "".join(f"some words of a text that is rather long and varied {i}\n" for i in range(330_000))
    c = chunk(text)
    for f in (quality_rules._counts, order_minhash.labelled, quality_knn.features):
        tracemalloc.start()
        f(c)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30 * len(text)
    tracemalloc.start()
    for _, p in repeats.overlapping(c):
        repeats.runs(p)
    assert tracemalloc.get_traced_memory()[1] < 3 * len(text)
    tracemalloc.stop()
