import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the table.
CLASHES = ("id", "node", "class", "key", "n", "w", "h", "s", "t", "doc", "g", "item", "label", "score", "size", "start", "keys", "_id", "_class", "ranges", "failed", "kept")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(7)
    base = words(rng, 120)
    near = base.copy()
    near[60] = "changed"
    far = words(rng, 120)
    shared = " ".join(words(rng, 60))
    texts = [
        None, "", " \n ", "a", "ünï cödé ☃ 語 語", " ".join(base), " ".join(base), " ".join(near), " ".join(far), " ".join(base[:30] + far[:30]),
        f"{' '.join(words(rng, 20))} {shared} {' '.join(words(rng, 20))}", f"{' '.join(words(rng, 30))} {shared}", "xyz " * 400, " ".join(words(rng, 40_000)), "</s> <s> <|endoftext|> a",
        "line one here\nline one here\n\n\nline two", "#" * 300, "WORDS IN CAPITALS " * 30,
    ]
    rows = [(i * 3 + 1, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, "a row without an id " * 12, None, None, None), rows[5], rows[0]]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(edge_rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")
