"""Histogram gradient boosting and permutation importance, for all groups in the same jobs.

Answers are coarse, so rows with the same group, predictors (in bins) and target are one
cell with a weight; cells are written once, dealt by group and hash, so that a group of
any size spreads over all tasks.

Boosting (squared loss): a pass over the cells adds up gradients per (group, node,
predictor, bin) inside each task, Spark sums these, and the best split of every node comes
back: a row per node, whatever the data.  Trees are grown leaf-wise to ``max_leaves``.  A
pass covers all nodes that may still be split, of all groups, so a tree takes about as many
passes as it is deep; the leaf-wise order is settled from the gains afterwards.  A missing
value has a bin of its own and goes to the side that gains more.  A tenth of the rows is
held out; a group stops when its loss has not fallen for ``patience`` rounds.

Gradients and losses are added up as integers (fixed point), so the result depends neither on
partitions nor on the order of rows, and a group with few cells goes through the same
passes inside one task.

Permutation importance: rows get a rank by a seeded key within their group, in two steps
(buckets, then within a bucket), and rank joins rank: each row is paired with another
one for each repeat, and every predictor in turn takes the partner's value.  Pairs whose own
rows are alike are brought together, and a prediction is made once for alike rows and values.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

MISSING = 255  # the bin of missing values; others are 0 .. 254
SAMPLE_ROWS = 200_000  # rows of a group that bin edges are taken from
TASK_CELLS = 1 << 17  # a group of up to so many cells is boosted within one task
CHUNK = 1 << 16  # cells that a task works on at a time
SLOTS = 1024  # places that the cells of a group are dealt to
FOLD_ROUNDS = 10  # rounds after which predictions are written to the cells
BUCKET_ROWS = 10_000  # rows of a rank bucket to aim at
PLACE_ROWS = 20_000  # alike rows whose pairs are dealt to one place
SHARE_BITS = 53
RANK_BITS = 40  # of the rank of a row in its group


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------
# Bins and cells
# ---------------------------------------------------------------------------


@dataclass
class Group:
    """What the driver knows of a group: its predictors, bins and, later, its trees."""

    code: int
    name: object
    predictors: list
    edges: dict = field(default_factory=dict)  # predictor -> ascending thresholds
    zero_fill: frozenset = frozenset()
    complete: bool = False  # rows that lack a predictor take no part
    span: float = 0.0  # of the target
    rows: int = 0
    base: float = 0.0
    gap: np.ndarray | None = None  # predictors with missing values in the training rows
    trees: list = field(default_factory=list)
    losses: list = field(default_factory=list)

    @property
    def bits(self) -> int:
        """Fixed-point places of a gradient: one is exact in a double, and the sum of all fits a long."""
        return self._places(self.span)

    @property
    def loss_bits(self) -> int:
        return self._places(self.span ** 2)

    def _places(self, top: float) -> int:
        return math.floor(min(52, 57 - math.log2(max(self.rows, 1))) - math.log2(max(top, 1e-200)))


def bin_edges(values: np.ndarray, most: int = MISSING) -> list:
    """Midpoints between the distinct values, or between ``most`` quantiles where there are more."""
    distinct = np.unique(values)
    if len(distinct) > most:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, most), method="lower"))
    return [float(x) for x in (distinct[:-1] + distinct[1:]) / 2]


def _edges(df: DataFrame, group: str, predictors: list, rows: dict, seed: int) -> dict:
    """(group, predictor) -> edges, from all rows of a group or a sample of ``SAMPLE_ROWS`` by hash."""
    share = F.create_map(*[F.lit(x) for g, n in rows.items() for x in (g, min(1.0, SAMPLE_ROWS / max(n, 1)))])
    u = F.pmod(F.xxhash64(F.lit(seed), *predictors, "_y", "_copy"), F.lit(1 << SHARE_BITS)) / F.lit(float(1 << SHARE_BITS))
    long = df.where(u < share[F.col(group)]).unpivot([group], predictors, "variable", "value").where("value IS NOT NULL")
    found = long.groupBy(group, "variable").applyInPandas(
        lambda pdf: pd.DataFrame({group: pdf[group].iloc[:1], "variable": pdf["variable"].iloc[:1],
                                  "edges": [bin_edges(pdf["value"].to_numpy())]}),
        f"{group} {dict(df.dtypes)[group]}, variable string, edges array<double>")
    return {(r[group], r["variable"]): list(r["edges"]) for r in found.collect()}


def _binned(groups: dict, group: str, predictors: list):
    """Batches of (group, predictors, target) -> (code, bins as bytes, target)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby(group, sort=False):
                g = groups.get(name)
                if g is None:
                    continue
                bins = np.full((len(part), len(predictors)), MISSING, np.uint8)
                for c in g.predictors:
                    x = part[c].to_numpy(np.float64)
                    if c in g.zero_fill:
                        x = np.where(np.isnan(x), 0.0, x)
                    known = ~np.isnan(x)
                    bins[known, predictors.index(c)] = np.searchsorted(g.edges.get(c, []), x[known], side="left")
                yield pd.DataFrame({"code": np.int32(g.code), "bins": [b.tobytes() for b in bins], "y": part["_y"].to_numpy()})

    return run


def _unit(*columns) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << SHARE_BITS)) / F.lit(float(1 << SHARE_BITS))


def make_cells(df: DataFrame, predictors: Sequence[str], target: str, group: str, threshold: float,
               holdout: float, seed: int, complete: bool = False) -> tuple[list[Group], DataFrame]:
    """The groups, and their cells (code, bins, y, n, held, f): ``n`` training and ``held`` held-out rows.

    Rows without target take no part.  Per group, predictors with a greater missing share
    than ``threshold`` are left out (over all its rows), and missing values of predictors that only
    hold 0 and 1 become 0; with ``complete``, no missing value is filled and rows that lack one of the
    predictors left are dropped.  Of a cell of c rows, c * ``holdout`` are held out, rounded up or down by a hash.
    """
    preds = [c for c in dict.fromkeys(predictors) if c != target]
    num = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    d = df.select(F.col(group), *[num(c).alias(c) for c in preds], num(target).alias("_y"))
    # the only reading of ``df``: all rows, also those without a target, as the shares of missing values are theirs
    everything = _written(d.where(F.col(group).isNotNull()).groupBy(group, *preds, "_y").agg(F.count(F.lit(1)).alias("_n")), "boost-rows")
    aggs = [F.sum(F.when(F.col("_y").isNotNull(), F.col("_n"))).alias("_rows"), F.sum("_n").alias("_all"),
            F.min("_y").alias("_low"), F.max("_y").alias("_high")]
    aggs += [F.struct(F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)).alias("missing"),
                      F.max((F.col(c) != 0) & (F.col(c) != 1)).alias("other")).alias(c) for c in preds]
    groups, rows = {}, {}
    for r in sorted(everything.groupBy(group).agg(*aggs).collect(), key=lambda r: r[group]):  # a row per group
        kept = [c for c in preds if r[c]["missing"] / r["_all"] <= threshold]
        if r["_rows"] and kept:
            g = groups[r[group]] = Group(len(groups), r[group], kept, span=r["_high"] - r["_low"], rows=r["_rows"], complete=complete,
                                         zero_fill=frozenset(c for c in kept if not r[c]["other"] and not complete))
            rows[r[group]] = g.rows
    spark = df.sparkSession
    cell = "code int, bins binary, y double, n long, held long, f double"
    if not groups:
        return [], spark.createDataFrame([], cell)
    counted = everything.where(F.col("_y").isNotNull())
    # copies of a row are told apart, so that a sample takes its share of them
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("_n", F.lit(SAMPLE_ROWS)))))
    for (name, c), e in _edges(copies, group, preds, rows, seed).items():
        if name in groups and c in groups[name].predictors:
            groups[name].edges[c] = e
    for g in groups.values():
        for c in g.zero_fill:  # the filled zeros have a bin as well, whether or not 0 occurs
            e = g.edges.get(c, [])
            g.edges[c] = e or [0.5]
    keyed = counted.select(group, *preds, "_y", "_n").mapInPandas(_weighted(groups, group, preds), "code int, bins binary, y double, c long")
    cells = keyed.groupBy("code", "bins", "y").agg(F.sum("c").alias("c"))
    held = F.floor(F.col("c") * F.lit(float(holdout)) + _unit(F.lit(seed), "code", "bins", "y")).cast("long")
    cells = cells.select("code", "bins", "y", (F.col("c") - held).alias("n"), held.alias("held"), F.lit(0.0).alias("f"))
    # a group is dealt to SLOTS places, so that a hot one doesn't meet in one task, and comes in a row there
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, "code", F.pmod(F.xxhash64("bins", "y"), F.lit(SLOTS))).sortWithinPartitions("code", "bins", "y")
    return list(groups.values()), _written(cells, "boost-cells")


def _weighted(groups: dict, group: str, predictors: list):
    binned = _binned(groups, group, predictors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby(group, sort=False):
                if name in groups and groups[name].complete:
                    part = part.dropna(subset=groups[name].predictors)
                for out in binned([part]):
                    yield out.assign(c=part["_n"].to_numpy())

    return run


# ---------------------------------------------------------------------------
# Trees
# ---------------------------------------------------------------------------


@dataclass
class Tree:
    """Arrays by node; ``feature`` is -1 at leaves.  Bins up to ``cut`` go left, missing ones by ``gap_left``."""

    feature: np.ndarray
    cut: np.ndarray
    gap_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int32)
        inner = np.flatnonzero(self.feature[node] >= 0)
        while len(inner):
            at = node[inner]
            x = bins[inner, self.feature[at]]
            goes = np.where(x == MISSING, self.gap_left[at], x <= self.cut[at])
            node[inner] = np.where(goes, self.left[at], self.right[at])
            inner = inner[self.feature[node[inner]] >= 0]
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


def best_split(count: np.ndarray, grad: np.ndarray, gap: np.ndarray, least: int):
    """(gain, predictor, cut, missing go left, rows left, gradient left), or None.

    ``count`` and ``grad``: predictors x 256 bins.  Of equal gains: the first predictor, missing
    values right, the lowest cut.  Where the training rows have no missing values
    (``gap``), those met later go with the larger side.
    """
    n, g = int(count[0].sum()), int(grad[0].sum())
    n_left, g_left = count[:, :MISSING].cumsum(axis=1), grad[:, :MISSING].cumsum(axis=1)
    n_left = np.stack([n_left, n_left + count[:, MISSING:]], axis=1).astype(np.float64)  # predictors x side x cut
    g_left = np.stack([g_left, g_left + grad[:, MISSING:]], axis=1)
    n_right = n - n_left
    first, second = g_left.astype(np.float64) * n, g * n_left
    d = first - second
    d[np.abs(d) <= 1e-12 * (np.abs(first) + np.abs(second))] = 0.0  # rounding alone
    fits = (n_left >= least) & (n_right >= least)
    gain = np.where(fits, d * d, 0.0) / np.where(fits, n * n_left * n_right, 1.0)
    f, side, cut = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, side, cut] > 0:
        return None
    left = int(n_left[f, side, cut])
    return (float(gain[f, side, cut]), int(f), int(cut), bool(side) if gap[f] else left > n - left, left, int(g_left[f, side, cut]))


class Growing:
    """One tree while it grows: which nodes can be split, and which of these the leaf-wise order takes."""

    def __init__(self, n: int, g: int, least: int, max_leaves: int):
        self.least, self.max_leaves = max(least, 1), max_leaves
        self.n, self.g, self.split, self.children = [n], [g], {}, {}
        self.open = [0] if n >= 2 * least else []  # nodes whose histogram is wanted

    def learn(self, node: int, split) -> None:
        self.split[node] = split

    def order(self) -> tuple[list, list]:
        """Nodes split, in leaf-wise order as far as it is known; nodes that hold it up."""
        heap, taken, waits, offered = [], [], [], itertools.count()

        def offer(node):
            if node in self.split:
                if self.split[node]:
                    heapq.heappush(heap, (-self.split[node][0], next(offered), node))  # equal gains: the older node
            elif self.n[node] >= 2 * self.least:
                waits.append(node)

        offer(0)
        while heap and not waits and len(taken) < self.max_leaves - 1:
            node = heapq.heappop(heap)[2]
            taken.append(node)
            if len(taken) < self.max_leaves - 1:
                for child in self._expand(node):
                    offer(child)
        return taken, waits

    def _expand(self, node: int) -> tuple[int, int]:
        if node not in self.children:
            _, _, _, _, n_left, g_left = self.split[node]
            at = len(self.n)
            self.n += [n_left, self.n[node] - n_left]
            self.g += [g_left, self.g[node] - g_left]
            self.children[node] = (at, at + 1)
        return self.children[node]

    def advance(self) -> bool:
        """Choose the nodes of the next pass; False when the tree is settled.

        Besides the nodes that are needed at once, children of all nodes that may be split
        are looked at, those of the greatest gains first, ``max_leaves`` at most.
        """
        if not self.order()[1]:
            self.open = []
            return False
        ahead = sorted((s for s in self.split if self.split[s]), key=lambda s: (-self.split[s][0], s))[: self.max_leaves]
        for node in ahead:
            self._expand(node)
        reach = {c for node in ahead for c in self._expand(node)} | set(self.order()[1])
        self.open = sorted(c for c in reach if c not in self.split and self.n[c] >= 2 * self.least)
        return True

    def tree(self, rate: float, scale: float) -> Tree:
        """The tree with all known splits while it grows; ``finished`` cuts it back to the leaf-wise order."""
        return self._arrays([s for s in self.children if self.split.get(s)], rate, scale)

    def finished(self, rate: float, scale: float) -> Tree:
        taken = self.order()[0]
        for node in taken:
            self._expand(node)
        return self._arrays(taken, rate, scale)

    def _arrays(self, inner: list, rate: float, scale: float) -> Tree:
        m = len(self.n)
        t = Tree(np.full(m, -1, np.int16), np.zeros(m, np.int16), np.zeros(m, bool), np.zeros(m, np.int32), np.zeros(m, np.int32),
                 np.array([-rate * (g / scale) / n if n else 0.0 for n, g in zip(self.n, self.g, strict=True)]))
        for node in inner:
            _, t.feature[node], t.cut[node], t.gap_left[node], _, _ = self.split[node]
            t.left[node], t.right[node] = self.children[node]
        return t


# ---------------------------------------------------------------------------
# Passes over the cells
# ---------------------------------------------------------------------------


@dataclass
class Part:
    """What a task needs of a group in a pass."""

    fresh: list  # trees since predictions were written to the cells
    growing: Tree | None
    nodes: list
    scale: float
    loss_scale: float | None  # set where the held-out loss is wanted


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of ``CHUNK`` rows at most, however the session cuts Arrow batches."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            if size + piece.num_rows > CHUNK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(piece)
            size += piece.num_rows
    if size:
        yield pa.Table.from_batches(held)


def _bins(table: pa.Table, name: str, p: int) -> np.ndarray:
    fixed = table.column(name).combine_chunks().cast(pa.binary(p))  # the bytes of all rows in a row
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * p:][: len(fixed) * p].reshape(-1, p)


def _chunks(batches: Iterator[pa.RecordBatch], p: int):
    """(code, bins, y, n, held, f) of the cells of one group at a time, ``CHUNK`` at most."""
    for table in _gathered(batches):
        columns = {c: table.column(c).to_numpy() for c in ("code", "y", "n", "held", "f")}
        bins = _bins(table, "bins", p)
        for code in np.unique(columns["code"]):
            at = np.flatnonzero(columns["code"] == code)
            yield int(code), bins[at], *(columns[c][at] for c in ("y", "n", "held", "f"))


def _fixed(x: np.ndarray, scale: float) -> np.ndarray:
    return np.rint(x * scale)


def _add(part: Part, p: int, bins, y, n, held, f, total, loss) -> None:
    """Add the sums of some cells of a group to ``total`` (node x predictor x bin) and ``loss``."""
    for tree in part.fresh:
        f = f + tree.predict(bins)
    error = f - y
    if part.loss_scale is not None:
        loss[0] += int(held.sum())
        loss[1] += int((_fixed(error * error, part.loss_scale).astype(np.int64) * held).sum())
    place = np.zeros(len(y), np.int64)
    if part.growing is not None:
        slot = np.full(len(part.growing.feature), -1, np.int64)
        slot[part.nodes] = np.arange(len(part.nodes))
        place = slot[part.growing.leaves(bins)]
    at = np.flatnonzero((place >= 0) & (n > 0))
    key = ((place[at, None] * p + np.arange(p)) * 256 + bins[at]).ravel()
    w = n[at]
    g = _fixed(error[at], part.scale).astype(np.int64) * w  # a cell stands for w rows; sums stay below 2^62
    np.add.at(total[0], key, np.repeat(w, p))
    np.add.at(total[1], key, np.repeat(g, p))


def _histograms(parts: dict, p: int):
    """Sums (code, node, feature, bin, n, g) of a task; feature -1 carries the held-out rows and loss."""
    names = ["code", "node", "feature", "bin", "n", "g"]

    def rows(code, part, total, loss):
        count, grad = total
        at = np.flatnonzero(count)
        node, rest = np.divmod(at, p * 256)
        columns = [np.asarray(part.nodes, np.int32)[node], (rest // 256).astype(np.int32), (rest % 256).astype(np.int32), count[at], grad[at]]
        if part.loss_scale is not None:
            columns = [np.append(c, np.array(v, c.dtype)) for c, v in zip(columns, (0, -1, 0, *loss), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), code, np.int32)), *map(pa.array, columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = total = loss = None
        for code, bins, y, n, held, f in _chunks(batches, p):
            part = parts.get(code)
            if part is None:
                continue
            if code != current:
                if current is not None:
                    yield rows(current, parts[current], total, loss)
                size = len(part.nodes) * p * 256
                current, total = code, (np.zeros(size, np.int64), np.zeros(size, np.int64))
                loss = [0, 0]
            _add(part, p, bins, y, n, held, f, total, loss)
        if current is not None:
            yield rows(current, parts[current], total, loss)

    return run


def _node_split(code: int, gap: np.ndarray, least: int):
    def split(node: int, count: np.ndarray, grad: np.ndarray, loss) -> dict:
        gain, f, cut, gap_left, left, g_left = best_split(count, grad, gap, least) or (0.0, -1, 0, False, 0, 0)
        return {"code": code, "node": node, "rows": int(count[0].sum()), "grad": int(grad[0].sum()), "gain": gain, "feature": f, "cut": cut,
                "gap_left": gap_left, "left_rows": left, "left_grad": g_left, "gap": (count[:, MISSING] > 0).tolist(),
                "held": int(loss[0]), "loss": int(loss[1])}

    return split


def _splits(gaps: dict, p: int, least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code, node = int(pdf["code"].iloc[0]), int(pdf["node"].iloc[0])
        feature, at = pdf["feature"].to_numpy(), pdf["bin"].to_numpy()
        n, g = pdf["n"].to_numpy(), pdf["g"].to_numpy()
        loss = feature < 0
        count, grad = np.zeros((p, 256), np.int64), np.zeros((p, 256), np.int64)
        count[feature[~loss], at[~loss]] = n[~loss]
        grad[feature[~loss], at[~loss]] = g[~loss]
        return pd.DataFrame([_node_split(code, gaps[code], least)(node, count, grad, (n[loss].sum(), g[loss].sum()))])

    return run


SPLIT = ("code int, node int, rows long, grad long, gain double, feature int, cut int, gap_left boolean, left_rows long, "
         "left_grad long, gap array<boolean>, held long, loss long")


def _pass(cells: DataFrame, parts: dict, gaps: dict, p: int, least: int) -> list:
    """One row per (group, node) of ``parts``: its totals and best split."""
    sums = cells.mapInArrow(_histograms(parts, p), "code int, node int, feature int, bin int, n long, g long")
    keys = sum(max(len(x.nodes), 1) for x in parts.values())
    # tasks have summed their own: a key gets at most predictors x bins rows from each
    dealt = sums.repartition(min(keys, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "code", "node")
    summed = dealt.groupBy("code", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    return summed.groupBy("code", "node").applyInPandas(_splits(gaps, p, least), SPLIT).collect()


def _folded(trees: dict, p: int):
    """The cells with the predictions of ``trees`` added to ``f``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, bins, y, n, held, f in _chunks(batches, p):
            for tree in trees.get(code, []):
                f = f + tree.predict(bins)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(y), code, np.int32)), pa.array([b.tobytes() for b in bins], pa.binary()), *map(pa.array, (y, n, held, f))],
                names=["code", "bins", "y", "n", "held", "f"])

    return run


def _stops(losses: list, patience: int, tol: float = 1e-7) -> bool:
    """Whether none of the last ``patience`` rounds is better than the one before them."""
    return len(losses) > patience and not any(x < losses[-patience - 1] - tol for x in losses[-patience:])


def _rounds(groups: list[Group], run, fold, p: int, every: int, max_iter: int, rate: float, max_leaves: int, least: int, patience: int) -> None:
    """Grow the trees of ``groups``: ``run(parts, gaps)`` makes a pass, ``fold(trees)`` adds predictions every ``every`` rounds."""
    by_code = {g.code: g for g in groups}
    active, fresh = list(groups), {g.code: [] for g in groups}
    gaps = {g.code: np.ones(p, bool) for g in groups}
    for done in range(max_iter):
        parts = {g.code: Part(fresh[g.code], None, [0], 2.0 ** g.bits, 2.0 ** g.loss_bits) for g in active}
        growing = {}
        for r in run(parts, gaps):
            g = by_code[r["code"]]
            if g.gap is None:
                g.gap = gaps[g.code] = np.array(r["gap"])
            if r["held"]:
                g.losses.append(r["loss"] / 2.0 ** g.loss_bits / r["held"] / 2)
            if r["held"] and _stops(g.losses, patience):
                continue
            growing[g.code] = tree = Growing(r["rows"], r["grad"], least, max_leaves)
            tree.learn(0, _split_of(r, gaps[g.code]))
        active = [g for g in active if g.code in growing]
        if not active:
            return
        unsettled = {c: t for c, t in growing.items() if t.advance()}
        while unsettled:
            parts = {c: Part(fresh[c], t.tree(rate, 1.0), t.open, 2.0 ** by_code[c].bits, None) for c, t in unsettled.items()}
            for r in run(parts, gaps):
                unsettled[r["code"]].learn(r["node"], _split_of(r, gaps[r["code"]]))
            unsettled = {c: t for c, t in unsettled.items() if t.advance()}
        for c, t in growing.items():
            tree = t.finished(rate, 2.0 ** by_code[c].bits)
            by_code[c].trees.append(tree)
            fresh[c].append(tree)
        if (done + 1) % every == 0 and done + 1 < max_iter:
            fold(fresh)
            fresh = {g.code: [] for g in groups}


TREES = ("code int, tree int, feature array<int>, cut array<int>, gap_left array<boolean>, left array<int>, right array<int>, "
         "value array<double>, losses array<double>")
TREE_FIELDS = ("feature", "cut", "gap_left", "left", "right", "value")


def _whole_group(groups: list[Group], p: int, options: dict):
    """All rounds of a group within one task: the same passes over its cells, held as arrays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = groups[int(pdf["code"].iloc[0])]
        g = Group(g.code, g.name, g.predictors, span=g.span, rows=g.rows)
        bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, p)
        y, n, held, f = (pdf[c].to_numpy() for c in ("y", "n", "held", "f"))
        state = [f]

        def passed(parts, gaps):
            part = parts[g.code]
            size = len(part.nodes) * p * 256
            total, loss = (np.zeros(size, np.int64), np.zeros(size, np.int64)), [0, 0]
            for at in range(0, len(y), CHUNK):
                c = slice(at, at + CHUNK)
                _add(part, p, bins[c], y[c], n[c], held[c], state[0][c], total, loss)
            count, grad = (t.reshape(-1, p, 256) for t in total)
            split = _node_split(g.code, gaps[g.code], options["least"])
            return [split(node, count[k], grad[k], loss) for k, node in enumerate(part.nodes) if count[k].any() or node == 0]

        def fold(trees):
            for tree in trees[g.code]:
                state[0] = state[0] + tree.predict(bins)

        _rounds([g], passed, fold, p, 1, **options)
        rows = [(g.code, i, *(getattr(t, c).tolist() for c in TREE_FIELDS), g.losses) for i, t in enumerate(g.trees)]
        return pd.DataFrame(rows or [(g.code, -1, [], [], [], [], [], [], g.losses)], columns=[c.split()[0] for c in TREES.split(", ")])

    return run


def boost(groups: list[Group], cells: DataFrame, p: int, max_iter: int = 100, rate: float = 0.1, max_leaves: int = 32,
          least: int = 20, patience: int = 10) -> None:
    """Fill ``base``, ``trees`` and ``losses`` of every group.

    Groups of up to ``TASK_CELLS`` cells are boosted in one task each, larger ones by passes of all
    tasks; both do the same sums in integers and give the same trees.
    """
    options = {"max_iter": max_iter, "rate": rate, "max_leaves": max_leaves, "least": max(least, 1), "patience": patience}
    # the base is the mean of the training rows, summed in fixed point
    scales = F.create_map(*[F.lit(x) for g in groups for x in (g.code, 2.0 ** g.bits)])
    size = {r["code"]: r for r in cells.groupBy("code").agg(F.min("y").alias("low"), F.count(F.lit(1)).alias("cells")).collect()}
    lows = F.create_map(*[F.lit(x) for c, r in size.items() for x in (c, r["low"])])
    fixed = F.rint((F.col("y") - lows[F.col("code")]) * scales[F.col("code")]).cast("decimal(38,0)") * F.col("n")
    for r in cells.groupBy("code").agg(F.sum(fixed).alias("s"), F.sum("n").alias("n")).collect():
        g = groups[r["code"]]
        g.base = size[g.code]["low"] + (float(int(r["s"])) / 2.0 ** g.bits / r["n"] if r["n"] else 0.0)
    start = F.create_map(*[F.lit(x) for g in groups for x in (g.code, g.base)])
    cells = cells.withColumn("f", start[F.col("code")])

    small = [c for c, r in size.items() if r["cells"] <= TASK_CELLS]
    if small:
        whole = cells.where(F.col("code").isin(small)).groupBy("code").applyInPandas(_whole_group(groups, p, options), TREES)
        for r in sorted(whole.collect(), key=lambda r: (r["code"], r["tree"])):  # the model: a row per tree
            groups[r["code"]].losses = list(r["losses"])
            if r["tree"] >= 0:
                groups[r["code"]].trees.append(Tree(*(np.array(r[c]) for c in TREE_FIELDS)))
    large = [g for g in groups if size[g.code]["cells"] > TASK_CELLS]
    if large:
        state = [cells.where(F.col("code").isin([g.code for g in large]))]

        def fold(trees):
            state[0] = _written(state[0].mapInArrow(_folded(trees, p), "code int, bins binary, y double, n long, held long, f double"), "boost-folded")

        _rounds(large, lambda parts, gaps: _pass(state[0], parts, gaps, p, options["least"]), fold, p, FOLD_ROUNDS, **options)


def _split_of(r, gap: np.ndarray):
    if r["feature"] < 0:
        return None
    left, rows = r["left_rows"], r["rows"]
    gap_left = r["gap_left"] if gap[r["feature"]] else left > rows - left
    return r["gain"], r["feature"], r["cut"], gap_left, left, r["left_grad"]


# ---------------------------------------------------------------------------
# Permutation importance
# ---------------------------------------------------------------------------


def ranked(rows: DataFrame, key: F.Column, buckets: int) -> DataFrame:
    """``rows`` with ``rank`` (from 1) by ``key`` (0 to 1) within (code, rep); equal keys by bins, y and copy.

    Two steps: buckets of equal key ranges are counted and their starts summed, then rows are
    numbered inside a bucket.  Keys are hashes, so the buckets of a group of any size are even.
    """
    d = rows.withColumn("key", key).withColumn("bucket", F.floor(F.col("key") * buckets).cast("long"))
    counts = d.groupBy("code", "rep", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("code", "rep").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("code", "rep", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    # the hash tells buckets apart at a glance while rows are sorted
    inside = Window.partitionBy("part", "code", "rep", "bucket").orderBy("key", "bins", "y", "copy")
    return (d.withColumn("part", F.xxhash64("code", "rep", "bucket")).withColumn("place", F.row_number().over(inside))
            .join(starts, ["code", "rep", "bucket"])
            .withColumn("rank", F.col("start") + F.col("place")).drop("key", "bucket", "start", "place", "part"))


def _alike(table: pa.Table, p: int):
    """(code, bins, y, partners' bins, own row of each partner) by group; rows next to each other that are alike are one own row."""
    codes, y = table.column("code").to_numpy(), table.column("y").to_numpy()
    own, other = _bins(table, "bins", p), _bins(table, "partner", p)
    new = np.ones(len(y), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (y[1:] != y[:-1]) | (own[1:] != own[:-1]).any(axis=1)
    for code in np.unique(codes):
        at = np.flatnonzero(codes == code)
        first = at[new[at]]
        yield int(code), own[first], y[first], other[at], np.cumsum(new[at]) - 1


def _permuted_errors(groups: list[Group], p: int, predictors: list):
    """Per task and group: summed squared error as it is (feature -1) and with each predictor from the partner.

    Rows that are alike come next to each other: a prediction for a row and a partner's value counts for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for table in _gathered(batches):
            for code, own, y, other, row in _alike(table, p):
                g = groups[code]
                plain = [tree.predict(own) for tree in g.trees]
                for f in [-1, *(predictors.index(c) for c in g.predictors)]:
                    value = other[:, f] if f >= 0 else 0
                    key, times = np.unique(row * 256 + value, return_counts=True)
                    at, value = np.divmod(key, 256)
                    x = own[at]
                    if f >= 0:
                        x[:, f] = value
                    e = np.full(len(at), g.base)
                    for tree, unchanged in zip(g.trees, plain, strict=True):
                        e += tree.predict(x) if f >= 0 and (tree.feature == f).any() else unchanged[at]
                    e -= y[at]
                    total[code, f] = total.get((code, f), 0) + int((_fixed(e * e, 2.0 ** g.loss_bits).astype(np.int64) * times).sum())
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in keys], pa.int32()), pa.array([f for _, f in keys], pa.int32()),
                                              pa.array(list(total.values()), pa.int64())], names=["code", "feature", "e"])

    return run


def permutation_importance(groups: list[Group], cells: DataFrame, predictors: list, repeats: int, seed: int) -> dict:
    """code -> {predictor: rise of the mean squared error, averaged over ``repeats``}; all rows, held out or not."""
    p, most = len(predictors), max(g.rows for g in groups)
    alike = F.col("n") + F.col("held")
    rows = cells.select("code", "bins", "y", alike.alias("alike"), F.explode(F.sequence(F.lit(1).cast("long"), alike)).alias("copy"))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats))))
    ranks = ranked(rows, _unit(F.lit(seed), "rep", "code", "bins", "y", "copy"), max(1, most // BUCKET_ROWS))
    ranks = _written(ranks.drop("copy"), "permuted-rows")
    # one number for group and rank, as rows are joined and sorted by it
    at = F.shiftleft(F.col("code").cast("long"), RANK_BITS) + F.col("rank")
    partner = ranks.where("rep > 0").select(at.alias("at"), F.col("bins").alias("partner"))
    # pairs of alike rows meet and are next to each other, by a hash; rows with very many copies go to several places
    place = F.pmod(F.col("rank"), 1 + F.floor(F.col("alike") / PLACE_ROWS))
    own = ranks.where("rep = 0").select("code", "bins", "y", at.alias("at"), place.alias("place"), F.xxhash64("code", "bins", "y").alias("same"))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = own.join(partner, "at").repartition(tasks, "same", "place").sortWithinPartitions("same").select("code", "bins", "y", "partner")
    errors = pairs.mapInArrow(_permuted_errors(groups, p, predictors), "code int, feature int, e long")
    sums = {(r["code"], r["feature"]): int(r["e"]) for r in
            errors.groupBy("code", "feature").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("e")).collect()}
    out = {}
    for g in groups:
        scale = 2.0 ** g.loss_bits * g.rows * repeats
        out[g.code] = {c: (sums[g.code, predictors.index(c)] - sums[g.code, -1]) / scale for c in g.predictors}
    return out


def boosted_importance(df: DataFrame, predictors: Sequence[str], target: str, threshold: float = 0.99, group: str = "product",
                       repeats: int = 5, seed: int = 42, max_iter: int = 100, holdout: float = 0.1, **options) -> DataFrame:
    """(group, variable, hgb_weight): permutation importance of boosted trees, clipped at 0, as percent of the group's sum.

    ``threshold`` over 1 is a percentage.  A group without a usable predictor or target has no
    rows; null groups are left out.  A constant target makes all weights 0.  No rows: no rows.
    """
    preds = [c for c in dict.fromkeys(predictors) if c != target]
    share = threshold / 100.0 if threshold > 1 else float(threshold)
    groups, cells = make_cells(df, preds, target, group, share, holdout, seed)
    rows = []
    if groups:
        boost(groups, cells, len(preds), max_iter, **options)
        for code, rise in permutation_importance(groups, cells, preds, repeats, seed).items():
            clipped = {c: max(v, 0.0) for c, v in rise.items()}
            total = sum(clipped.values())
            rows += [(groups[code].name, c, 100.0 * v / total if total > 0 else 0.0) for c, v in clipped.items()]
    return df.sparkSession.createDataFrame(rows, f"{group} {dict(df.dtypes)[group]}, variable string, hgb_weight double")
