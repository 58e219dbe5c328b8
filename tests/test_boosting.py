"""Histogram boosting against a brute-force version, and permutation importance."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondage.operators import boosting as B
from sondage.operators import drivers as D

PREDICTORS = ["a", "b", "c", "d"]
SCHEMA = "product string, a double, b double, c double, d double, y double"


def answers(n=500, seed=1, products=("P", "Q"), gaps=0.2):
    rnd = random.Random(seed)
    rows = []
    for p in products:
        for _ in range(n):
            a, b, c, d = rnd.randint(1, 10), rnd.randint(1, 5), rnd.choice([0, 1]), rnd.random()
            y = 0.7 * a + (2.0 if b > 3 else 0.0) - 1.5 * c + (1.0 if d > 0.4 else 0.0) + rnd.gauss(0, 0.5)
            hole = [rnd.random() < gaps for _ in range(4)]
            if hole[0]:
                y += 3.0  # missing answers tell something of their own
            rows.append((p, *(None if h else float(x) for h, x in zip(hole, (a, b, c, d), strict=True)), y if rnd.random() > 0.02 else None))
    return rows


def brute_boost(bins, y, n, held, max_iter, rate, max_leaves, least, patience):
    """Leaf-wise growth over expanded training rows; every split tried one by one."""
    train = np.repeat(np.arange(len(y)), n)
    f = np.full(len(y), y[train].mean())
    gap = [(bins[train, j] == 255).any() for j in range(bins.shape[1])]
    trees, losses = 0, []

    def candidates(rows):
        g = (f - y)[rows]
        for j in range(bins.shape[1]):
            x = bins[rows, j]
            for gap_left in (False, True):
                for cut in range(255):
                    left = (x <= cut) | ((x == 255) & gap_left)
                    left &= (x != 255) | gap_left
                    if least <= left.sum() <= len(rows) - least:
                        gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(rows)
                        yield gain, j, cut, gap_left, left

    def best(rows):
        top = None
        for cand in candidates(rows):
            if cand[0] > 1e-9 and (top is None or cand[0] > top[0] * (1 + 1e-9)):
                top = cand
        return top

    while True:
        if held.sum():
            losses.append(float((held * (f - y) ** 2).sum() / held.sum() / 2))
            if len(losses) > patience and min(losses[-patience:]) >= losses[-patience - 1] - 1e-7:
                return f, trees, losses
        if trees == max_iter:
            return f, trees, losses
        leaves = [(train, np.arange(len(y)), best(train))]  # training rows, all cells, split
        while len(leaves) < max_leaves and any(s for *_, s in leaves):
            k = max((i for i in range(len(leaves)) if leaves[i][2]), key=lambda i: leaves[i][2][0])
            rows, cells, (_, j, cut, gap_left, left) = leaves.pop(k)
            gap_left = gap_left if gap[j] else left.sum() > len(rows) - left.sum()
            x = bins[cells, j]
            goes = np.where(x == 255, gap_left, x <= cut)
            for part in (True, False):
                r = rows[left == part]
                leaves.append((r, cells[goes == part], best(r) if len(r) >= 2 * least else None))
        step = np.zeros(len(y))
        for rows, cells, _ in leaves:
            step[cells] = -rate * (f - y)[rows].mean() if len(rows) else 0.0
        f = f + step
        trees += 1


def cells_of(cells, code):
    rows = cells.where(F.col("code") == code).collect()
    return (np.array([list(r["bins"]) for r in rows], np.uint8), np.array([r["y"] for r in rows]),
            np.array([r["n"] for r in rows]), np.array([r["held"] for r in rows]))


def predicted(g, bins):
    f = np.full(len(bins), g.base)
    for t in g.trees:
        f = f + t.predict(bins)
    return f


@pytest.mark.parametrize("everywhere", [False, True])
def test_trees_equal_brute_force(spark, monkeypatch, everywhere):
    """In one task per group, and by passes over all tasks."""
    df = spark.createDataFrame(answers(300, products=("P",)) + answers(150, 2, ("Q",), 0.0), SCHEMA).repartition(3)
    groups, cells = B.make_cells(df, PREDICTORS, "y", "product", 0.99, 0.1, 7)
    if everywhere:
        monkeypatch.setattr(B, "TASK_CELLS", 0)
        monkeypatch.setattr(B, "FOLD_ROUNDS", 2)
    B.boost(groups, cells, 4, max_iter=4, max_leaves=6, least=10)
    for g in groups:
        bins, y, n, held = cells_of(cells, g.code)
        want, trees, losses = brute_boost(bins, y, n, held, 4, 0.1, 6, 10, 10)
        assert len(g.trees) == trees == 4 and all((t.feature >= 0).sum() == 5 for t in g.trees)
        assert predicted(g, bins) == pytest.approx(want, abs=1e-6)
        assert g.losses == pytest.approx(losses[: len(g.losses)], abs=1e-6)


def test_stops_early(spark):
    rnd = random.Random(4)
    noise = [("P", float(rnd.randint(1, 5)), None, None, None, rnd.gauss(0, 1)) for _ in range(400)]
    groups, cells = B.make_cells(spark.createDataFrame(noise, SCHEMA), ["a"], "y", "product", 0.99, 0.3, 7)
    B.boost(groups, cells, 1, max_iter=60, least=5, patience=3)
    bins, y, n, held = cells_of(cells, 0)
    want, trees, _ = brute_boost(bins, y, n, held, 60, 0.1, 32, 5, 3)
    assert 3 <= len(groups[0].trees) == trees < 60
    assert predicted(groups[0], bins) == pytest.approx(want, abs=1e-6)


def test_missing_values_have_a_side(spark):
    rows = [("P", float(i % 4) if i % 3 else None, None, None, None, 9.0 if i % 3 == 0 else float(i % 4)) for i in range(240)]
    groups, cells = B.make_cells(spark.createDataFrame(rows, SCHEMA), ["a"], "y", "product", 0.99, 0.0, 7)
    B.boost(groups, cells, 1, max_iter=80, least=5)
    bins, y, n, held = cells_of(cells, 0)
    assert held.sum() == 0 and len(groups[0].trees) == 80  # nothing held out: no early end
    assert predicted(groups[0], bins) == pytest.approx(y, abs=0.01)


def test_zero_fill_is_for_binary_predictors_only(spark):
    df = spark.createDataFrame(answers(60, products=("P",)), SCHEMA)
    groups, cells = B.make_cells(df, PREDICTORS, "y", "product", 0.99, 0.1, 7)
    assert groups[0].zero_fill == {"c"}
    bins, *_ = cells_of(cells, 0)
    assert set(bins[:, 2]) == {0, 1} and all((bins[:, j] == 255).any() for j in (0, 1, 3))


def test_bin_edges():
    assert B.bin_edges(np.array([3.0, 1.0, 1.0, 2.0])) == [1.5, 2.5]
    assert B.bin_edges(np.array([])) == [] == B.bin_edges(np.array([4.0]))
    many = B.bin_edges(np.random.default_rng(1).random(10_000))
    assert len(many) == 254 and many == sorted(many)
    assert np.bincount(np.searchsorted(many, np.random.default_rng(1).random(10_000))).max() < 120


def test_importance_is_independent_of_partitions_batches_and_order(spark):
    rows = answers(300)
    weights = []
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        for parts, size, order in ((1, "10000", 1), (7, "13", -1)):
            spark.conf.set(batch, size)
            df = spark.createDataFrame(rows[::order], SCHEMA).repartition(parts)
            got = B.boosted_importance(df, PREDICTORS, "y", repeats=2, max_iter=5)
            weights.append(sorted(map(tuple, got.collect())))
    finally:
        spark.conf.set(batch, before)
    assert weights[0] == weights[1]
    for p in "PQ":
        w = {v: x for q, v, x in weights[0] if q == p}
        assert sum(w.values()) == pytest.approx(100) and max(w, key=w.get) == "a" and set(w) == set(PREDICTORS)


def test_ranks_are_a_permutation(spark):
    rows = spark.range(5000).select((F.col("id") % 3 % 2).cast("int").alias("code"), F.lit(0).alias("rep"), F.lit(b"x").alias("bins"),
                                    F.lit(1.0).alias("y"), F.col("id").alias("copy"))
    got = B.ranked(rows, B._unit(F.lit(1), "copy"), 7).toPandas()
    for _, part in got.groupby("code"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert np.corrcoef(part["rank"].astype(float), part["copy"].astype(float))[0, 1] < 0.1


def test_importance_equals_its_definition(spark):
    """The pairs come from the ranks; the errors from the trees, row by row."""
    df = spark.createDataFrame(answers(80, products=("P",)), SCHEMA)
    groups, cells = B.make_cells(df, PREDICTORS, "y", "product", 0.99, 0.1, 7)
    B.boost(groups, cells, 4, max_iter=3)
    got = B.permutation_importance(groups, cells, PREDICTORS, 2, 7)[0]
    rows = cells.select("code", "bins", "y", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + F.col("held"))).alias("copy"))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2))))
    ranks = {}
    for r in rows.withColumn("k", B._unit(F.lit(7), "rep", "code", "bins", "y", "copy")).collect():
        ranks.setdefault(r["rep"], []).append((r["k"], bytes(r["bins"]), r["y"], r["copy"]))
    ordered = {k: sorted(v) for k, v in ranks.items()}
    own = np.array([list(x[1]) for x in ordered[0]], np.uint8)
    y = np.array([x[2] for x in ordered[0]])
    base = ((predicted(groups[0], own) - y) ** 2).mean()
    for j, c in enumerate(PREDICTORS):
        rises = []
        for k in (1, 2):
            x = own.copy()
            x[:, j] = [x2[1][j] for x2 in ordered[k]]
            rises.append(((predicted(groups[0], x) - y) ** 2).mean() - base)
        assert got[c] == pytest.approx(np.mean(rises), abs=1e-6)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert B.boosted_importance(empty, PREDICTORS, "y").count() == 0
    flat = spark.createDataFrame([("P", 1.0, None, None, None, 2.0)] * 60 + [("Q", 1.0, 2.0, 0.0, 1.0, None)] * 5
                                 + [(None, 1.0, 2.0, 0.0, 1.0, 3.0)] * 5, SCHEMA)
    got = {tuple(r) for r in B.boosted_importance(flat, [*PREDICTORS, "a", "y"], "y", threshold=50, repeats=1, max_iter=3).collect()}
    assert got == {("P", "a", 0.0)}
    assert D.gbt_permutation_importance(empty, PREDICTORS, "y").columns == ["product", "variable", "hgb_weight"]


def test_leaf_wise_order_takes_the_greatest_gain_first():
    t = B.Growing(100, 0, 1, 3)
    t.learn(0, (9.0, 0, 0, False, 50, 5))
    left, right = t._expand(0)
    t.learn(left, (1.0, 0, 0, False, 20, 1))
    t.learn(right, (4.0, 0, 0, False, 20, 1))
    assert t.order() == ([0, right], []) and list(itertools.chain(t.tree(0.1, 1.0).feature)).count(0) == 1
    assert (t.finished(0.1, 1.0).feature >= 0).tolist() == [True, False, True, False, False]


def counted_rows(spark, n=300):
    """Rows whose every reading is counted: (df, accumulator)."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("A" if i % 3 else "B", float(i % 5), float(i % 4), float(i % 5 + i % 2)) for i in range(n)]
    schema = "product string, a double, b double, liking double"
    return spark.createDataFrame(rows, schema).repartition(3).mapInArrow(count, schema), read


def test_rows_are_read_once(spark):
    df, read = counted_rows(spark)
    groups, cells = B.make_cells(df, ["a", "b"], "liking", "product", 0.99, 0.1, 1)
    assert sum(r["n"] + r["held"] for r in cells.collect()) == 300 and read.value == 300


def test_driver_merge_reads_its_rows_once(spark):
    df, read = counted_rows(spark)
    out = D.driver_merge(df, ["a", "b"], "liking", run_hgb=False).collect()
    assert len(out) == 4 and read.value == 300


def test_alike_pairs_are_predicted_once(monkeypatch):
    tree = B.Tree(np.array([0, -1, -1]), np.array([1, 0, 0]), np.array([False] * 3), np.array([1, 0, 0]), np.array([2, 0, 0]), np.array([0.0, -1.0, 1.0]))
    group = B.Group(0, "A", ["a", "b"], span=4.0, rows=900, trees=[tree])
    rng = np.random.default_rng(3)
    own = np.repeat(np.array([[0, 1], [2, 1], [2, 3]], np.uint8), 300, axis=0)
    y, other = np.repeat([0.0, 1.0, 3.0], 300), rng.integers(0, 4, (900, 2)).astype(np.uint8)
    batch = pa.RecordBatch.from_pydict({"code": pa.array([0] * 900, pa.int32()), "bins": [b.tobytes() for b in own], "y": y,
                                        "partner": [b.tobytes() for b in other]})
    predicted = []
    plain = B.Tree.predict
    monkeypatch.setattr(B.Tree, "predict", lambda self, bins: predicted.append(len(bins)) or plain(self, bins))
    out = {r["feature"]: r["e"] for b in B._permuted_errors([group], 2, ["a", "b"])(iter([batch])) for r in b.to_pylist()}
    assert sum(predicted) == 3 + 3 * 4  # the rows as they are, and each with the four values of ``a``; ``b`` has no part in the tree
    for f in (-1, 0, 1):
        x = own.copy()
        if f >= 0:
            x[:, f] = other[:, f]
        assert out[f] == int(B._fixed((plain(tree, x) - y) ** 2, 2.0 ** group.loss_bits).astype(np.int64).sum())
