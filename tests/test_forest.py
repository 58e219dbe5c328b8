"""Random forest: against a tree grown row by row, and the same wherever nodes are grown."""

import random

import numpy as np
import pytest

from sondage.operators import forest as R

COLUMNS = "product string, a double, b double, c double, d double, y double"
PREDICTORS = ["a", "b", "c", "d"]


def survey(n=900, seed=3, products=("P", "Q")):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c, d = (float(rnd.randint(1, k)) for k in (9, 5, 3, 2))
        y = 2 * a + (b if i % 2 else 0) + rnd.choice([-1, 0, 0, 1])
        rows.append((products[i % len(products)], a, b, c, d, float(y)))
    return rows


def weights(df, **options):
    return {(r[0], r[1]): r[2] for r in R.forest_importance(df, PREDICTORS, "y", **options).collect()}


def naive(bins, w, t, path, most, scale):
    """The importances of a tree by plain recursion over rows, in exact fractions of integers."""
    gains = [0] * bins.shape[1]

    def split(rows, path):
        rows = [i for i in rows if w[i]]
        varying = [j for j in range(bins.shape[1]) if len({int(bins[i, j]) for i in rows}) > 1]
        if len({int(t[i]) for i in rows}) < 2 or not varying:
            return
        draw = R.mixed(path ^ R.mixed(np.arange(bins.shape[1]) + 3))
        best = None
        for j in sorted(varying, key=lambda j: int(draw[j]))[:most]:
            for cut in sorted({int(bins[i, j]) for i in rows})[:-1]:
                left = [i for i in rows if bins[i, j] <= cut]
                lw, ls = sum(int(w[i]) for i in left), sum(int(w[i] * t[i]) for i in left)
                nw, ns = sum(int(w[i]) for i in rows), sum(int(w[i] * t[i]) for i in rows)
                drop = float(R.variance_drop(np.array([lw]), np.array([ls]), np.array([nw]), np.array([ns]))[0])
                if best is None or drop > best[0]:
                    best = drop, j, cut
        drop, j, cut = best
        gains[j] += round(drop * scale)
        left, right = R.child_paths(path)
        split([i for i in rows if bins[i, j] <= cut], np.array([left]))
        split([i for i in rows if bins[i, j] > cut], np.array([right]))
    split(range(len(w)), path)
    return gains


def test_a_tree_equals_plain_recursion():
    rng = np.random.default_rng(1)
    for tree in range(6):
        n = 300
        bins = np.stack([rng.integers(k, size=n) for k in (2, 4, 9, 1, 30)], axis=1).astype(np.uint8)
        t = (bins[:, 2] * 5 + rng.integers(4, size=n)).astype(np.int64) * 1000
        w = R.bootstrap(rng.integers(1, 4, size=n), rng.integers(-2 ** 62, 2 ** 62, size=n), tree)
        path = R.root_path(42, 0, tree)
        scale = 2.0 ** 50 / (w.sum() * float(t.max()) ** 2)
        assert R.grow(bins, w, t, path, 2, scale, None).tolist() == naive(bins, w, t, path, 2, scale)
    assert R.grow(bins, w * 0, t, path, 2, scale, None).tolist() == [0] * 5


def test_bootstrap_draws_poisson():
    cell = np.arange(40_000) * 977
    for n in (1, 7, 300, 9000):
        draws = R.bootstrap(np.full(len(cell), n), cell, 5)
        assert draws.mean() == pytest.approx(n, rel=0.02) and draws.var() == pytest.approx(n, rel=0.05)
    assert (R.bootstrap(np.ones(len(cell), np.int64), cell, 5) == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_passes_and_tasks_grow_the_same_forest(spark, monkeypatch):
    df = spark.createDataFrame(survey(), COLUMNS)
    whole = weights(df, num_trees=8)
    assert set(whole) == {(g, c) for g in "PQ" for c in PREDICTORS}
    for g in "PQ":
        assert sum(whole[g, c] for c in PREDICTORS) == pytest.approx(100) and whole[g, "a"] > 60
    assert weights(df.repartition(5).orderBy("y"), num_trees=8) == whole
    monkeypatch.setattr(R, "TASK_CELLS", 60)
    assert weights(df, num_trees=8) == whole
    shallow = weights(df, num_trees=4, max_depth=2)
    monkeypatch.undo()
    assert weights(df, num_trees=4, max_depth=2) == shallow != weights(df, num_trees=4)


def test_odd_rows(spark):
    nan = float("nan")
    rows = survey(200)
    rows += [("P", None, 1.0, 1.0, 1.0, 90.0), ("P", 1.0, nan, 1.0, 1.0, -90.0), ("P", 1.0, 1.0, 1.0, 1.0, None), (None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    rows += [("flat", float(i % 4), 1.0, 2.0, 3.0, 5.0) for i in range(20)]  # a constant target
    rows += [("gap", float(i), None, float(i % 2), 1.0, float(i)) for i in range(20)]  # b is missing throughout
    rows += [("none", None, None, None, None, 1.0)]
    got = weights(spark.createDataFrame(rows, COLUMNS), num_trees=5)
    clean = weights(spark.createDataFrame(survey(200), COLUMNS), num_trees=5)
    assert {g for g, _ in got} == {"P", "Q", "flat", "gap"}
    assert [got["flat", c] for c in PREDICTORS] == [0.0] * 4 and ("gap", "b") not in got and got["gap", "a"] > got["gap", "c"]
    assert all(abs(got["P", c] - clean["P", c]) < 25 for c in PREDICTORS)
    assert weights(spark.createDataFrame([], COLUMNS)) == {}
