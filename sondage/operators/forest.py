"""Random forest importances for all groups and trees in the same jobs.

Rows of a group with equal predictors (in bins) and target are one cell with a weight, as in
``boosting``.  A tree draws its bootstrap from the cells: a cell of n rows counts Poisson(n)
times, by a hash of cell and tree, which is the sum of n draws of Poisson(1).  Trees grow
until a node is pure or no predictor varies in it; each node draws sqrt(p) of the predictors
that vary there, by a hash of its path.  Splits lower the variance the most, and what they
lower it by is the importance of their predictor: per tree to 1, then over trees to 100.

A node with more than ``TASK_CELLS`` cells is split by a pass: tasks add up weights and
targets per (tree, node, predictor, bin), Spark sums these, and a row per node comes back.
One pass serves such nodes of all groups and trees.  Smaller nodes are dealt to tasks and
grown to the end there; a group that is small from the start goes whole, with a block of
trees.  Sums are integers (fixed point) and draws are hashes, so the result depends on
neither partitions nor order nor on where a node is grown.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .boosting import Group, make_cells

TASK_CELLS = 1 << 17  # a node of up to so many cells is grown within one task
MOST_TASKS = 4096
IMPORTANCE_BITS = 50  # fixed-point places of an importance, as a share of the group's sum of squares
GAINS = "code int, tree int, feature int, gain long"
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finalizer of splitmix64)."""
    x = np.asarray(x, np.uint64) + STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def root_path(seed: int, code: int, tree: int) -> np.ndarray:
    return mixed(mixed(mixed([seed]) ^ np.uint64(code)) ^ np.uint64(tree))


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Left and right child of every path, in turn."""
    return mixed(np.stack((paths ^ np.uint64(1), paths ^ np.uint64(2)), axis=1).ravel())


@functools.lru_cache(maxsize=512)
def _kept_distribution(mean: int):
    return _distribution(mean)


def _distribution(mean: int) -> tuple[int, np.ndarray]:
    """The least value of Poisson(mean) to reckon with, and the distribution function from there."""
    reach = int(12 * mean ** 0.5) + 24
    k = np.arange(max(0, mean - reach), mean + reach + 1)
    log = np.concatenate(([0.0], np.cumsum(np.log(mean / k[1:]))))
    chance = np.exp(log - log.max())
    return int(k[0]), np.cumsum(chance) / chance.sum()


def bootstrap(n: np.ndarray, cell: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree sees each cell: Poisson(n) by the hash of the cell."""
    u = (mixed(cell.view(np.uint64) ^ mixed([tree])) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    out = np.empty(len(n), np.int64)
    for mean in np.unique(n).tolist():
        at = n == mean
        least, below = _kept_distribution(mean) if mean <= 4096 else _distribution(mean)
        out[at] = least + np.minimum(np.searchsorted(below, u[at], side="right"), len(below) - 1)
    return out


def variance_drop(lw, ls, w, s):
    """By how much a split lowers the sum of squares: weights and sums of the left part and of the node."""
    d = ls - lw * (s / w)
    return d * d * (w / (lw * (w - lw).astype(np.float64)))


def chosen(paths: np.ndarray, varies: np.ndarray, most: int) -> np.ndarray:
    """For each node the predictors that it may split by, in the order of their draw; the last may not vary."""
    order = mixed(paths[:, None] ^ mixed(np.arange(varies.shape[1]) + 3)[None, :])
    return np.lexsort((order, ~varies), axis=1)[:, :most]


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def best_cuts(rank: np.ndarray, values: np.ndarray, w: np.ndarray, wt: np.ndarray, n_w: np.ndarray, n_s: np.ndarray):
    """(nodes, cuts, drops): the best cut of every node by one predictor, the lowest of equal ones.

    rank: the node of a row, ascending; values: bins; n_w, n_s: weight and sum of every node.
    """
    key = rank * 256 + values
    order = np.argsort(key, kind="stable")
    key = key[order]
    last = np.concatenate((_starts(key)[1:], [len(key)])) - 1
    node, cut = key[last] >> 8, key[last] & 255
    lw = np.cumsum(w[order])[last] - (np.cumsum(n_w) - n_w)[node]
    ls = np.cumsum(wt[order])[last] - (np.cumsum(n_s) - n_s)[node]
    inner = lw < n_w[node]  # behind the largest value there is nothing
    node, cut, lw, ls = node[inner], cut[inner], lw[inner], ls[inner]
    drop = variance_drop(lw, ls, n_w[node], n_s[node])
    first = np.lexsort((cut, -drop, node))
    first = first[_starts(node[first])] if len(first) else first
    return node[first], cut[first], drop[first]


def grow(bins: np.ndarray, w: np.ndarray, t: np.ndarray, path: np.ndarray, most: int, scale: float, levels: int | None) -> np.ndarray:
    """Importances (fixed point) of the tree below a node, grown level by level on arrays."""
    p = bins.shape[1]
    gains = np.zeros(p, np.int64)
    seen = w > 0
    bins, w, t, node = bins[seen], w[seen], t[seen], np.zeros(int(seen.sum()), np.int64)
    paths = path
    while len(w) and (levels is None or levels > 0):
        at = _starts(node)
        varies = np.minimum.reduceat(bins, at, axis=0) < np.maximum.reduceat(bins, at, axis=0)
        splits = (np.minimum.reduceat(t, at) < np.maximum.reduceat(t, at)) & varies.any(axis=1)
        sizes = np.diff(np.concatenate((at, [len(node)])))
        keep = np.repeat(splits, sizes)
        bins, w, t = bins[keep], w[keep], t[keep]
        if not len(w):
            break
        paths, varies, sizes = paths[node[at]][splits], varies[splits], sizes[splits]
        k = len(sizes)
        rank, at = np.repeat(np.arange(k), sizes), np.cumsum(sizes) - sizes
        wt = w * t
        n_w, n_s = np.add.reduceat(w, at), np.add.reduceat(wt, at)
        picks = chosen(paths, varies, most)
        best, feature, cut = np.full(k, -1.0), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for r in range(picks.shape[1]):
            nodes, cuts, drops = best_cuts(rank, bins[np.arange(len(w)), picks[rank, r]], w, wt, n_w, n_s)
            better = drops > best[nodes]
            nodes = nodes[better]
            best[nodes], feature[nodes], cut[nodes] = drops[better], picks[nodes, r], cuts[better]
        np.add.at(gains, feature, np.rint(best * scale).astype(np.int64))
        node = 2 * rank + (bins[np.arange(len(w)), feature[rank]] > cut[rank])
        order = np.argsort(node, kind="stable")
        bins, w, t, node = bins[order], w[order], t[order], node[order]
        paths = child_paths(paths)
        levels = None if levels is None else levels - 1
    return gains


class Forest:
    """What tasks know: fixed-point scales of the groups, and settings."""

    def __init__(self, groups: list[Group], lows: dict, p: int, seed: int, levels: int | None):
        self.p, self.seed, self.levels = p, seed, levels
        self.low, self.fixed = lows, {g.code: 2.0 ** g.bits for g in groups}
        self.scale = {g.code: 2.0 ** IMPORTANCE_BITS / (max(g.rows, 1) * (g.span * 2.0 ** g.bits) ** 2) for g in groups}
        self.most = {g.code: max(1, int(len(g.predictors) ** 0.5)) for g in groups}

    def targets(self, code: int, y: np.ndarray) -> np.ndarray:
        return np.rint((y - self.low[code]) * self.fixed[code]).astype(np.int64)

    def matrix(self, bins) -> np.ndarray:
        return np.frombuffer(b"".join(bins), np.uint8).reshape(-1, self.p)

    def pieces(self, batches: Iterator[pa.RecordBatch]):
        """(code, bins, targets, n, hash) of the cells of one group at a time, some thousands at most."""
        for table in boosting._gathered(batches):
            columns = {c: table.column(c).to_numpy() for c in ("code", "y", "n", "h")}
            bins = self.matrix(table.column("bins").to_pylist())
            for code in np.unique(columns["code"]).tolist():
                at = np.flatnonzero(columns["code"] == code)
                yield code, bins[at], self.targets(code, columns["y"][at]), columns["n"][at], columns["h"][at]

    def gain_rows(self, code: int, tree: int, gains: np.ndarray) -> list:
        return [(code, tree, int(j), int(gains[j])) for j in np.flatnonzero(gains)]


def _signed(path: np.ndarray) -> int:
    return int(path.view(np.int64)[0])


class Top:
    """The upper part of a tree, whose nodes are split by passes: node -> (feature, cut, left, right)."""

    def __init__(self, root: int):
        self.root, self.inner, self.open, self.ready = root, {}, {root: 0}, {}  # open, ready: node -> depth

    def learn(self, node: int, r, limit: int) -> None:
        depth = self.open.pop(node)
        if r["feature"] < 0:
            return
        left, right = child_paths(np.array([node], np.int64).view(np.uint64)).view(np.int64).tolist()
        self.inner[node] = r["feature"], r["cut"], left, right
        for child, cells in ((left, r["left_cells"]), (right, r["cells"] - r["left_cells"])):
            (self.ready if cells <= limit else self.open)[child] = depth + 1

    def places(self, bins: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(node, rows) at the lower end."""
        todo = [(self.root, at)]
        while todo:
            node, i = todo.pop()
            if not len(i):
                continue
            if node in self.inner:
                feature, cut, left, right = self.inner[node]
                goes_left = bins[i, feature] <= cut
                todo += [(left, i[goes_left]), (right, i[~goes_left])]
            else:
                yield node, i


SUMS = "code int, tree int, node long, at int, w long, s long, low long, high long, cells long"


def _sums(forest: Forest, tops: dict):
    """Per task: weights and sums of the open nodes by predictor and bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, bins, t, n, h in forest.pieces(batches):
            for tree, top in tops[code].items():
                if not top.open:
                    continue
                w = bootstrap(n, h, tree)
                for node, i in top.places(bins, np.flatnonzero(w)):
                    if node not in top.open:
                        continue
                    key = (bins[i].astype(np.int64) + 256 * np.arange(forest.p)).ravel()
                    order = np.argsort(key, kind="stable")
                    first = _starts(key[order])
                    row = i[order // forest.p]
                    wt = w[row] * t[row]
                    columns = [np.full(len(first), code, np.int32), np.full(len(first), tree, np.int32), np.full(len(first), node, np.int64),
                               key[order][first].astype(np.int32), np.add.reduceat(w[row], first), np.add.reduceat(wt, first),
                               np.minimum.reduceat(t[row], first), np.maximum.reduceat(t[row], first),
                               np.diff(np.concatenate((first, [len(row)])))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in SUMS.split(", ")])
    return run


SPLITS = "code int, tree int, node long, feature int, cut int, gain long, cells long, left_cells long"


def _split(forest: Forest):
    """The sums of a node -> its split (feature -1: none)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        code, tree, node = int(pdf["code"].iloc[0]), int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        feature, value = pdf["at"].to_numpy() // 256, pdf["at"].to_numpy() % 256
        w, s, cells = (pdf[c].to_numpy() for c in ("w", "s", "cells"))
        varies = np.bincount(feature, minlength=forest.p)[None, :] > 1
        first = feature == 0
        best = (-1, 0, 0, int(cells[first].sum()), 0)
        if pdf["low"].min() < pdf["high"].max() and varies.any():
            n_w, n_s = w[first].sum(keepdims=True), s[first].sum(keepdims=True)
            drop = -1.0
            for j in chosen(np.array([node], np.int64).view(np.uint64), varies, forest.most[code])[0]:
                at = feature == j
                # a bin is a row of its weight here, with its sum in place of weight times target
                _, cuts, drops = best_cuts(np.zeros(at.sum(), np.int64), value[at].astype(np.int64), w[at], s[at], n_w, n_s)
                if len(drops) and drops[0] > drop:
                    drop = drops[0]
                    left = at & (value <= cuts[0])
                    best = (int(j), int(cuts[0]), int(np.rint(drop * forest.scale[code])), best[3], int(cells[left].sum()))
        return pd.DataFrame([(code, tree, node, *best)], columns=[c.split()[0] for c in SPLITS.split(", ")])
    return run


def _dealt(forest: Forest, tops: dict):
    """Cells -> a row for each tree and small node that they lie in, with the bootstrap's weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, bins, t, n, h in forest.pieces(batches):
            for tree, top in tops[code].items():
                w = bootstrap(n, h, tree)
                for node, i in top.places(bins, np.flatnonzero(w)):
                    if node in top.ready:
                        same = [np.full(len(i), x, kind) for x, kind in ((code, np.int32), (tree, np.int32), (node, np.int64), (top.ready[node], np.int32))]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array([b.tobytes() for b in bins[i]], pa.binary()),
                                                          pa.array(t[i]), pa.array(w[i])], names=["code", "tree", "node", "depth", "bins", "t", "w"])
    return run


def _grown(forest: Forest):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code, tree, depth = (int(pdf[c].iloc[0]) for c in ("code", "tree", "depth"))
        levels = None if forest.levels is None else forest.levels - depth
        gains = grow(forest.matrix(pdf["bins"]), pdf["w"].to_numpy(), pdf["t"].to_numpy(), pdf["node"].to_numpy()[:1].view(np.uint64),
                     forest.most[code], forest.scale[code], levels)
        return pd.DataFrame(forest.gain_rows(code, tree, gains), columns=["code", "tree", "feature", "gain"])
    return run


def _whole(forest: Forest, num_trees: int, blocks: int):
    """The trees of a block, on all cells of a group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code, block = int(pdf["code"].iloc[0]), int(pdf["block"].iloc[0])
        bins, t = forest.matrix(pdf["bins"]), forest.targets(code, pdf["y"].to_numpy())
        rows = []
        for tree in range(block, num_trees, blocks):
            w = bootstrap(pdf["n"].to_numpy(), pdf["h"].to_numpy(), tree)
            rows += forest.gain_rows(code, tree, grow(bins, w, t, root_path(forest.seed, code, tree), forest.most[code], forest.scale[code], forest.levels))
        return pd.DataFrame(rows, columns=["code", "tree", "feature", "gain"])
    return run


def _large(forest: Forest, cells: DataFrame, codes: list, num_trees: int) -> DataFrame:
    """Gains of groups that are too large for a task: passes down to small nodes, which are dealt to tasks."""
    spark = cells.sparkSession
    tops = {c: {tree: Top(_signed(root_path(forest.seed, c, tree))) for tree in range(num_trees)} for c in codes}
    gains, depth = [], 0
    while any(top.open for trees in tops.values() for top in trees.values()) and (forest.levels is None or depth < forest.levels):
        sums = (cells.mapInArrow(_sums(forest, tops), SUMS).groupBy("code", "tree", "node", "at")
                .agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("cells").alias("cells")))
        for r in sums.groupBy("code", "tree", "node").applyInPandas(_split(forest), SPLITS).collect():  # a row per large node
            tops[r["code"]][r["tree"]].learn(r["node"], r, TASK_CELLS)
            if r["feature"] >= 0:
                gains.append((r["code"], r["tree"], r["feature"], r["gain"]))
        depth += 1
    dealt = cells.mapInArrow(_dealt(forest, tops), "code int, tree int, node long, depth int, bins binary, t long, w long")
    grown = dealt.groupBy("code", "tree", "node").applyInPandas(_grown(forest), GAINS)
    return grown.unionByName(spark.createDataFrame(gains, GAINS))


def forest_importance(df: DataFrame, predictors: Sequence[str], target: str, threshold: float = 0.3, group: str = "product",
                      num_trees: int = 100, seed: int = 42, max_depth: int | None = None) -> DataFrame:
    """(group, variable, rf_weight): impurity importances of a forest, as percent of the group's sum.

    Predictors with a greater missing share than ``threshold`` are left out per group, then rows
    that lack a predictor or the target.  Predictors of more than 255 values are cut at
    quantiles.  Groups without a predictor or a complete row have no rows, null groups
    are left out; where no tree splits (a constant target), all weights are 0.
    """
    preds = [c for c in dict.fromkeys(predictors) if c != target]
    spark = df.sparkSession
    schema = f"{group} {dict(df.dtypes)[group]}, variable string, rf_weight double"
    groups, cells = make_cells(df, preds, target, group, threshold, 0.0, seed, complete=True)
    if not groups:
        return spark.createDataFrame([], schema)
    size = {r["code"]: r for r in cells.groupBy("code").agg(F.min("y").alias("low"), F.count(F.lit(1)).alias("cells")).collect()}  # a row per group
    groups = [g for g in groups if g.code in size]
    growing = [g for g in groups if g.span > 0]
    forest = Forest(growing, {c: r["low"] for c, r in size.items()}, len(preds), seed, max_depth)
    cells = cells.select("code", "bins", "y", "n", F.xxhash64(F.lit(seed), "bins", "y").alias("h"))
    small = [g.code for g in growing if size[g.code]["cells"] <= TASK_CELLS]
    large = [g.code for g in growing if size[g.code]["cells"] > TASK_CELLS]
    gains = spark.createDataFrame([], GAINS)
    if small:
        blocks = max(1, min(num_trees, -(-2 * spark.sparkContext.defaultParallelism // len(small))))
        tasks = min(MOST_TASKS, 2 * blocks * len(small))
        dealt = cells.where(F.col("code").isin(small)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        gains = gains.unionByName(dealt.repartition(tasks, "code", "block").groupBy("code", "block")
                                  .applyInPandas(_whole(forest, num_trees, blocks), GAINS))
    if large:
        gains = gains.unionByName(_large(forest, cells.where(F.col("code").isin(large)), large, num_trees))
    per_tree = gains.groupBy("code", "tree", "feature").agg(F.sum("gain").alias("gain"))
    share = F.col("gain") / F.sum("gain").over(Window.partitionBy("code", "tree"))
    parts = per_tree.select("code", "feature", F.rint(share * 2.0 ** 40).cast("long").alias("part")).groupBy("code", "feature").agg(F.sum("part").alias("part"))
    found = {(r["code"], r["feature"]): r["part"] for r in parts.collect()}  # a row per group and predictor
    rows = []
    for g in groups:
        part = {c: found.get((g.code, preds.index(c)), 0) for c in g.predictors}
        rows += [(g.name, c, 100.0 * x / max(sum(part.values()), 1)) for c, x in part.items()]
    return spark.createDataFrame(rows, schema)
