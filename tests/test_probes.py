"""Factor structure and nested probes against plain NumPy loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wobble.operators import audits, factors, heads, probes

COLUMNS = ["a", "b", "c", "d", "e"]


def metric_frame(n=160, seed=8):
    """Two hidden factors behind five columns, with ties, nulls and NaNs; one group has too few rows, one a constant column."""
    rng = np.random.default_rng(seed)
    f = rng.standard_normal((n, 2))
    x = np.column_stack([f[:, 0], f[:, 0] + rng.standard_normal(n) / 2, f[:, 1], -f[:, 1] + rng.standard_normal(n) / 3, rng.standard_normal(n)]).round(1)
    frame = pd.DataFrame(x, columns=COLUMNS).assign(g=np.where(np.arange(n) % 3 == 0, "one", "two"))
    frame.loc[5, "a"], frame.loc[8, "b"] = None, float("nan")
    frame = pd.concat([frame, pd.DataFrame([[1.0, 2, 3, 4, 5, "few"]] * 2, columns=[*COLUMNS, "g"]), frame[frame.g == "one"].assign(g=None, e=1.0)])
    return frame.astype({"g": object})


def planar(loadings, sweeps=200):
    """Varimax by turning two factors at a time to the angle of the greatest criterion."""
    x = loadings.copy()
    p, k = x.shape
    for _ in range(sweeps):
        for i in range(k):
            for j in range(i + 1, k):
                u, v = x[:, i] ** 2 - x[:, j] ** 2, 2 * x[:, i] * x[:, j]
                num, den = 2 * (u @ v) - 2 * u.sum() * v.sum() / p, (u @ u - v @ v) - (u.sum() ** 2 - v.sum() ** 2) / p
                t = np.arctan2(num, den) / 4
                x[:, [i, j]] = x[:, [i, j]] @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    return x


def spread(x):
    return ((x**2).var(axis=0)).sum()


def test_factors_equal_numpy(spark):
    frame = metric_frame()
    rows = spark.createDataFrame(frame.replace({np.nan: None}).values.tolist(), "a double, b double, c double, d double, e double, g string").repartition(5)
    got = factors.factors(rows, ["g"], COLUMNS, 2).toPandas()
    for name, own in frame.groupby(frame.g.fillna("none")):
        full = own[COLUMNS].dropna().astype(float)
        matrix = np.nan_to_num(full.corr(method="spearman").to_numpy()) if len(full) > 2 else np.zeros((5, 5))
        np.fill_diagonal(matrix, 1)
        sizes, vectors = np.linalg.eigh(matrix)
        sizes, vectors = sizes[::-1].clip(0), vectors[:, ::-1]
        mine = got[got.g.fillna("none") == name].sort_values("rank")
        assert list(mine.name) == COLUMNS and np.allclose(mine.eigenvalue, sizes, atol=1e-8)
        assert np.allclose(mine.explained, sizes[:2].sum() / sizes.sum(), atol=1e-8)
        loadings = np.stack(mine.loadings)
        plain = vectors[:, :2] * np.sqrt(sizes[:2])
        if name in ("one", "two"):  # two factors are there
            want = planar(plain)
            want = want * np.where(want[np.abs(want).argmax(axis=0), [0, 1]] < 0, -1, 1)
            # the same turn, but for the order of the factors; the criterion's maximum is flat, so the places agree to its root
            assert min(np.abs(loadings - want).max(), np.abs(loadings - want[:, ::-1]).max()) < 2e-3
            assert spread(loadings) > spread(want) - 1e-6
        assert np.allclose(loadings @ loadings.T, plain @ plain.T, atol=1e-8)
        assert (loadings[np.abs(loadings).argmax(axis=0), [0, 1]] > 0).all() and list(mine.factor) == list(np.abs(loadings).argmax(axis=1))


def test_rotation_equals_a_loop_of_its_definition():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((9, 3))
    turn, best = np.eye(3), 0
    for _ in range(100):
        lam = a @ turn
        gradient = np.zeros((3, 3))
        for i in range(9):
            for j in range(3):
                gradient[:, j] += a[i] * (lam[i, j] ** 3 - lam[i, j] * (lam[:, j] ** 2).sum() / 9)
        u, s, v = np.linalg.svd(gradient)
        turn = u @ v
        if s.sum() < best * (1 + 1e-6):
            break
        best = s.sum()
    assert np.allclose(factors.rotated(a), a @ turn, atol=1e-9)


def test_rank_matrix_reads_its_rows_once(spark):
    frame = metric_frame()[COLUMNS].dropna()
    rows = spark.createDataFrame(frame.values.tolist(), "a double, b double, c double, d double, e double")
    got = {(r.a, r.b): r.rho for r in audits.rank_matrix(rows, COLUMNS).collect()}
    want = frame.corr(method="spearman")
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :])
    assert [tuple(r) for r in audits.rank_matrix(rows.limit(2), ["a", "b"]).collect()] == [("a", "b", None, 2)]


# probes


def fitted(x, y, strength, binary):
    """Mean, deviation, weights and intercept of one head."""
    mean, sd = x.mean(0), x.std(0) + 1e-8
    z = (x - mean) / sd
    if not binary:
        return mean, sd, np.linalg.solve(z.T @ z + strength * np.eye(z.shape[1]), z.T @ (y - y.mean())), y.mean()
    z, a = np.c_[np.ones(len(z)), z], np.zeros(z.shape[1] + 1)
    flat = np.r_[0, np.ones(z.shape[1] - 1)] / strength
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ a))
        a -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(flat), z.T @ (p - y) + flat * a)
    return mean, sd, a[1:], a[0]


def worth(y, score, binary):
    if binary:
        pos, neg = score[y == 1], score[y == 0]
        return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) if len(pos) and len(neg) else np.nan
    return np.corrcoef(pd.Series(y).rank(), pd.Series(score).rank())[0, 1]


def looped(frame, folds, binary, grid, inner_of):
    """Out-of-fold scores and picks by one fit after another. ``inner_of(outer)`` is the inner fold of each question."""
    x, y = np.stack(frame.x), frame.y.to_numpy(float)
    out, picked = {}, {}
    for outer in sorted(set(folds)):
        train, inner = folds != outer, frame.q.map(inner_of(outer)).to_numpy()
        tried = []
        for s in grid:
            own = []
            for i in sorted(set(inner[train])):
                a, b = train & (inner != i), train & (inner == i)
                if binary and len(set(y[a])) < 2:
                    continue
                mean, sd, w, c = fitted(x[a], y[a], s, binary)
                own.append(worth(y[b], (x[b] - mean) / sd @ w + c, binary))
            own = [v for v in own if np.isfinite(v)]
            tried.append(np.mean(own) if own else -np.inf)
        picked[outer] = grid[int(np.argmax(np.round(tried, 9)))]
        mean, sd, w, c = fitted(x[train], y[train], picked[outer], binary)
        out |= dict(zip(frame.i[~train], (x[~train] - mean) / sd @ w + c))
    return out, picked


@pytest.mark.parametrize("binary", [False, True])
def test_nested_probes_equal_the_loop(spark, binary):
    rng = np.random.default_rng(4)
    n, grid = 150, heads.PENALTIES if binary else (0.1, 10.0, 1000.0)
    x = rng.standard_normal((n, 6)) * [1, 5, 0.1, 1, 2, 1] + [0, 30, 0, 1, 0, 0]
    v = x @ [1.0, 0.1, 3.0, 0, 0, 0] + rng.standard_normal(n) * 2 - 3
    y = (v > 0.7).astype(float) if binary else v
    q = [f"q{i // 5}" for i in range(n)]
    rows = spark.createDataFrame([(i, q[i], x[i].tolist(), float(y[i])) for i in range(n)], "i int, q string, x array<double>, y double").repartition(6)
    split = heads.folded(rows, "q", 4, 11)
    scores, picked = probes.nested(split, ["i"], "q", binary, grid, inner=3, seed=12)
    frame = split.select("i", "q", "x", "y", "fold").toPandas()
    inner_of = lambda outer: {r.q: r.fold for r in heads.group_folds(split.where(F.col("fold") != outer), "q", 3, 12).collect()}
    want, chosen = looped(frame, frame.fold.to_numpy(), binary, grid, inner_of)
    assert {r.outer: r.strength for r in picked.collect()} == chosen
    got = {r.i: r.score for r in scores.collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6
    quality, again = heads.nested(split, ["i"], "q", binary, grid, inner=3, seed=12)
    assert again == chosen and abs(quality - worth(frame.y.to_numpy(), frame.i.map(want).to_numpy(), binary)) < 1e-9


def test_heads_without_both_classes(spark):
    rows = spark.createDataFrame([(i, f"q{i}", [float(i % 7), 1.0], 1.0 if i == 3 else 0.0) for i in range(40)], "i int, q string, x array<double>, y double")
    split = heads.folded(rows, "q", 4, 1)
    scores, picked = probes.nested(split, ["i"], "q", True, (0.1, 1.0), inner=2)
    alone = split.where("i = 3").first().fold
    assert {r.outer for r in scores.select("outer").distinct().collect()} == set(range(4)) - {alone}  # the fold whose rest has one class has no head
    assert picked.count() >= 3
