"""Approximate nearest neighbours by an inverted multi-index (largest cosine).

1. Vectors that take part are scaled to length 1; equal ones collapse to a class that keeps
   its smallest distinct ids (as many as an answer can hold, and one more for the query
   itself), each as often as it is given, but not more often than an answer can hold it.
2. Two codebooks, one per half of the vector, are fitted on a bounded sample.  A vector lies
   in the cell of its two nearest centroids; K x K cells, with K growing with the corpus.
3. A query visits centroid pairs in order of summed distance, with a heap over the two sorted
   lists, until the cells visited hold enough entries.  How many are enough is measured on
   the sample: the share of entries that finds ``recall`` of the true neighbours there.
   What the query takes along are the cells that it visits.
4. Entries lie in blocks of neighbouring cells (a cell larger than a block is cut).  A query
   goes to the blocks of its cells; a block is copied only if more queries come than one
   group holds, once per such group.  Entries in visited cells are scored exactly, and the
   best of all blocks make the answer.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, spread_sample, written

SAMPLE_ROWS = 1 << 13  # distinct vectors that the codebooks and the share are fitted on
TRIALS = 256  # of them, that are queries when the share is measured
CELL_ROWS = 32  # entries of a cell to aim at
ENTRY_BLOCK, QUERY_BLOCK = 1 << 13, 1 << 10
GATHER = 1 << 14  # rows whose equal vectors collapse before the shuffle
SALTS = 16  # parts of the queries of a block when they learn how many groups the block has


def _take_part(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Places of the rows that take part, and their vectors as bytes of doubles."""
    places, vectors = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            norm = float(np.sqrt(x @ x))
            if np.isfinite(x).all() and 0 < norm < np.inf:
                places.append(i)
                vectors.append((x + 0.0).tobytes())
    return np.array(places, np.int64), vectors


def _smallest(ids: list[int], top: int) -> list[int]:
    """The ``top`` + 1 smallest distinct ids in ascending order, each up to ``top`` times."""
    n = Counter(ids)
    return [i for i in sorted(n)[:top + 1] for _ in range(min(n[i], top))]


def _collapse(top: int):
    """(id, vector) -> (v, ids): per block of rows one row per distinct vector, with its smallest ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        n = 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([_smallest(x, top) for x in held.values()], pa.list_(pa.int64()))],
                                             names=["v", "ids"])
            held.clear()
            return out
        for b in batches:
            ids = b.column(0).to_pylist()
            places, vectors = _take_part(b.column(1))
            for i, v in zip(places.tolist(), vectors, strict=True):
                if ids[i] is not None:
                    held.setdefault(v, []).append(ids[i])
                    n += 1
            if n >= GATHER:
                yield flush()
                n = 0
        yield flush()
    return run


def _matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, vectors)), np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def _centroids(x: np.ndarray, k: int, rng) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(12):
        near = _distances(x, c).argmin(axis=1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class MultiIndex:
    """The two codebooks."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.half = max(1, sample.shape[1] // 2)
        k = max(1, min(256, len(sample), round((n / CELL_ROWS) ** 0.5)))
        self.books = [_centroids(sample[:, :self.half], k, rng), _centroids(sample[:, self.half:], k, rng)]
        self.k = k

    def near(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(unit[:, :self.half], self.books[0]), _distances(unit[:, self.half:], self.books[1])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.near(unit)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)


def traverse(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Centroid pairs (summed distance, i, j) in ascending order, by a heap over the sorted lists."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[ia].tolist(), b[ib].tolist()
    ia, ib = ia.tolist(), ib.tolist()
    heap, reached = [(sa[0] + sb[0], 0, 0)], [0] * len(sb)
    while heap:
        d, i, j = heapq.heappop(heap)
        yield d, ia[i], ib[j]
        # (i, j) opens its right neighbour; the first of a row opens the next row
        if i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        if i == 0 and j + 1 < len(sb):
            heapq.heappush(heap, (sa[0] + sb[j + 1], 0, j + 1))


def visited_cells(index: MultiIndex, a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> np.ndarray:
    """The occupied cells, ascending, up to the summed distance at which they hold ``enough`` entries.

    a, b: distances of one query to the centroids of the halves.  Cells as far as the last one are in.
    """
    held, stop = 0, np.inf
    for d, i, j in traverse(a, b):
        held += counts[i * index.k + j]
        if held >= enough:
            stop = d
            break
    return np.flatnonzero(((a[:, None] + b[None, :]).ravel() <= stop) & (counts > 0))


def places(cells: np.ndarray, starts: np.ndarray) -> dict[int, list[int]]:
    """block -> those of ``cells`` that have entries in it; starts: of cells in the order of all entries."""
    out: dict[int, list[int]] = {}
    first, last = starts[cells] // ENTRY_BLOCK, (starts[cells + 1] - 1) // ENTRY_BLOCK
    for c, i, j in zip(cells.tolist(), first.tolist(), last.tolist(), strict=True):
        for block in range(i, j + 1):
            out.setdefault(block, []).append(c)
    return out


def needed_share(index: MultiIndex, sample: np.ndarray, top: int, recall: float) -> float:
    """The share of entries after which ``recall`` of the true neighbours of sample queries are found."""
    n = len(sample)
    if n <= top + 1:
        return 1.0
    q = np.arange(0, n, max(1, n // TRIALS))
    score = sample[q] @ sample.T
    score[np.arange(len(q)), q] = -np.inf
    best = np.argpartition(-score, top - 1, axis=1)[:, :top]
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=index.k ** 2)
    shares = []
    for row, (a, b) in enumerate(zip(*index.near(sample[q]), strict=True)):
        order = np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable")
        seen = np.empty(index.k ** 2)
        seen[order] = np.cumsum(counts[order])
        shares += (seen[cells[best[row]]] / n).tolist()
    return float(np.quantile(shares, recall))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5, recall: float = 0.97, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``top`` nearest rows of ``vectors`` for every row of ``queries``.

    score is the cosine in double precision of the vectors as given; ties go to the smaller
    id, and a row with the query's id is no answer to it.  Vectors that are null, empty or
    zero, or hold nulls or non-finite numbers, take no part, nor do rows with a null id or
    with another dimension than most of the sample has.  Of rows repeating an id each is an
    entry; of queries repeating an id with other vectors each is answered, and a query that
    repeats id and vector is answered once.  Without entries there are no rows.
    """
    spark = vectors.sparkSession
    gathered = vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(_collapse(top), "v binary, ids array<long>")
    distinct = F.slice(F.array_distinct("ids"), 1, top + 1)
    smallest = F.flatten(F.transform(distinct, lambda d: F.array_repeat(
        d, F.least(F.lit(top), F.size(F.filter("ids", lambda x: x == d))))))
    classes = written(gathered.groupBy("v").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
                      .select("v", smallest.alias("ids")), "ann-classes")
    n = classes.count()
    sample = sorted(bytes(r["v"]) for r in spread_sample(classes.select("v"), SAMPLE_ROWS, n, "v").limit(2 * SAMPLE_ROWS).collect())
    out_schema = "query_id long, rank int, id long, score double"
    if not sample:
        return spark.createDataFrame([], out_schema).withColumnRenamed("id", id_col)
    sizes = [len(x) for x in sample]
    size = max(sorted(set(sizes)), key=sizes.count)
    sample = _unit(_matrix([x for x in sample if len(x) == size]))
    index = MultiIndex(sample, n)
    share = needed_share(index, sample, top, recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.cells(_unit(_matrix(b.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int64())], names=["v", "ids", "cell"])

    entries = written(classes.where(F.length("v") == size).mapInArrow(assign, "v binary, ids array<long>, cell long"), "ann-entries")
    counts = np.zeros(index.k ** 2, np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most K x K rows
        counts[r["cell"]] = r["count"]
    enough = max(top + 1, int(np.ceil(share * counts.sum())))
    starts = np.concatenate(([0], np.cumsum(counts)))

    def taking_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            places, vs = _take_part(b.column(1))
            rows = [(ids[i], v) for i, v in zip(places.tolist(), vs, strict=True) if ids[i] is not None and len(v) == size]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())],
                                             names=["id", "v"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the blocks that they visit, and their cells there."""
        for b in batches:
            vs = b.column(1).to_pylist()
            unit = _unit(_matrix(vs)) if vs else np.zeros((0, size // 8))
            visits = [[{"block": k, "cells": c} for k, c in places(visited_cells(index, *near, counts, enough), starts).items()]
                      for near in zip(*index.near(unit), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(visits, pa.list_(pa.struct([("block", pa.int64()), ("cells", pa.list_(pa.int64()))])))],
                names=["id", "v", "visits"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with their block: a cell's entries are spread by hash over the places that the cell has."""
        for b in batches:
            cell, hashed = b.column(2).to_numpy(), b.column(3).to_numpy()
            block = (starts[cell] + hashed % counts[cell]) // ENTRY_BLOCK
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(block, pa.int64())], names=["v", "ids", "cell", "block"])

    # a query given several times is asked once, or its copies would fill the ranks with the same answers
    once = (queries.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(taking_part, "id long, v binary")
            .dropDuplicates(["id", "v"]))
    asked = written(once.mapInArrow(find, "id long, v binary, visits array<struct<block:long,cells:array<long>>>"), "ann-queries")
    asking = asked.select("id", "v", F.xxhash64("id", "v").alias("h"), F.inline("visits"))
    groups = written(asked.select(F.explode("visits.block").alias("block")).groupBy("block")
                     .agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("groups")), "ann-groups")
    given = (entries.select("v", "ids", "cell", F.xxhash64("v").alias("h"))
             .mapInArrow(place, "v binary, ids array<long>, cell long, block long").join(groups, "block")
             .select(F.explode(F.expr("sequence(0L, groups - 1)")).alias("group"), "block", F.lit(None).cast("long").alias("id"), "v",
                     "ids", "cell", F.lit(None).cast("array<long>").alias("cells")))
    salted = groups.select("*", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    asking = (asking.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("long")).join(salted, ["block", "salt"])
              .select(F.pmod(F.floor(F.col("h") / SALTS), F.col("groups")).alias("group"), "block", "id", "v",
                      F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("long").alias("cell"), "cells"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        e, q = pdf[pdf["cell"].notna()], pdf[pdf["cell"].isna()]
        rows = []
        if len(e) and len(q):
            ev, qv = _matrix(e["v"].tolist()), _matrix(q["v"].tolist())
            en, qn = np.sqrt((ev * ev).sum(axis=1)), np.sqrt((qv * qv).sum(axis=1))
            held, inverse = np.unique(e["cell"].to_numpy(np.int64), return_inverse=True)
            lists = e["ids"].tolist()
            n_ids = np.array([len(x) for x in lists])
            first, all_ids = np.cumsum(n_ids) - n_ids, np.concatenate(lists).astype(np.int64)
            for k, (id_, v, cells) in enumerate(zip(q["id"].to_numpy(np.int64).tolist(), q["v"], q["cells"], strict=True)):
                at = np.flatnonzero(np.isin(held, cells)[inverse])
                if not len(at):
                    continue
                # row by row, so that a score does not depend on what else lies in the block
                cosine = np.einsum("ij,j->i", ev[at], qv[k]) / (en[at] * qn[k])
                owner = np.repeat(np.arange(len(at)), n_ids[at])
                ids = all_ids[first[at][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n_ids[at]) - n_ids[at], n_ids[at])]
                owner, ids = owner[ids != id_], ids[ids != id_]
                cosine = cosine[owner]
                if len(ids) > top:
                    best = cosine >= np.partition(cosine, len(ids) - top)[len(ids) - top]
                    ids, cosine = ids[best], cosine[best]
                rows += [(id_, bytes(v), int(ids[i]), float(cosine[i])) for i in np.lexsort((ids, -cosine))[:top]]
        return pd.DataFrame(rows, columns=["query_id", "v", "id", "score"])

    met = given.unionByName(asking).repartition(shuffle_partitions(spark), "group", "block")
    best = met.groupBy("group", "block").applyInPandas(score, "query_id long, v binary, id long, score double")
    order = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
