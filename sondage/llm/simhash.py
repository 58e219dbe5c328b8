"""SimHash near-duplicates, exact within a Hamming radius, by vantage-point trees.

1. Every document gets a 64-bit fingerprint; equal fingerprints collapse to one
   (a group of copies of any size is one point from here on).
2. A vantage-point tree over a bounded sample of fingerprints cuts the Hamming space
   into shards: inside (d <= median) or outside of each vantage point.  A point lives
   in one shard and visits, as a query, the others that its ball of the radius overlaps
   (triangle bounds); of two shards only one sends its visitors to the other.
3. Each shard searches its points with a finer tree: a vantage point splits them into
   shells of equal distance d, and a query at distance q needs the shells q - r .. q + r
   only.  Points within r/2 of the vantage point are linked without comparison.  Small
   nodes are compared bit by bit, skipping what is known to be connected.
4. A shard hands on a spanning star per component, never all pairs of a group; stars of
   all shards are joined by distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, shuffle_partitions, spread_sample, written
from .components import components

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
BLOCK = 1 << 16  # shingles hashed at a time
SAMPLE_ROWS = 1 << 14  # fingerprints that shape the shards; they only balance the work
SHARD_POINTS = 1 << 15  # points of a shard to aim at: larger ones get fewer visitors in all
LEAF = 96  # points of a node that is compared bit by bit


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        parts = [joined[a:b] for a, b in zip(starts[k:k + BLOCK].tolist(), ends[k:k + BLOCK].tolist(), strict=True)]
        h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(42))), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text",
                 also: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, *also) per row; fp is the unsigned fingerprint as a signed long.  A null text has none, hence 0."""
    schema = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["id", "fp", *also])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *also).mapInArrow(run, "id long, fp long" + schema)


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Vantage points that cut the space into shards; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, share: float, seed: int = 0):
        """share: of all points, that a shard should hold at most."""
        self.leaves = 0
        self.root = self._grow(sample, share * len(sample), np.random.default_rng(seed))

    def _grow(self, x, most, rng):
        if len(x) > max(most, 8):
            tries = x[rng.integers(len(x), size=8)]
            spread = [float(distance(x, v).std()) for v in tries]
            v = tries[int(np.argmax(spread))]
            d = distance(x, v)
            cut = int(np.median(d))
            if not (d > cut).any():
                cut -= 1
            if (d <= cut).any() and (d > cut).any():
                return v, cut, self._grow(x[d <= cut], most, rng), self._grow(x[d > cut], most, rng)
        self.leaves += 1
        return self.leaves - 1

    def home(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)

        def down(node, i):
            if isinstance(node, int):
                out[i] = node
            elif len(i):
                inside = distance(x[i], node[0]) <= node[1]
                down(node[2], i[inside])
                down(node[3], i[~inside])
        down(self.root, np.arange(len(x)))
        return out

    def visits(self, x: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places in x) of all points whose ball overlaps the leaf."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, i = todo.pop()
            if isinstance(node, int):
                yield node, i
            elif len(i):
                d = distance(x[i], node[0]).astype(np.int32)
                todo += [(node[2], i[d - radius <= node[1]]), (node[3], i[d + radius > node[1]])]


class Links:
    """Union-find over 0..n-1 on arrays; the root of a component is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while True:
            up = self.parent[r]
            if (up == r).all():
                break
            r = up
        self.parent[i] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _compare(x, p, q, links: Links, radius: int) -> None:
    for i in range(0, len(q), 1024):
        for j in range(0, len(p), 1024):
            qs, ps = q[i:i + 1024], p[j:j + 1024]
            rq, rp = links.roots(qs), links.roots(ps)
            same = rq == rp[0]
            # within one component nothing is left to find
            for qq, pp in ((qs[~same], ps), (qs[same], ps[rp != rp[0]])):
                if len(qq) and len(pp):
                    a, b = np.nonzero(distance(x[qq][:, None], x[pp][None, :]) <= radius)
                    links.join(qq[a], pp[b])


def search(x: np.ndarray, n_points: int, radius: int, seed: int = 0) -> Links:
    """Link all pairs of x within ``radius`` of which one is among the first ``n_points``."""
    links, rng = Links(len(x)), np.random.default_rng(seed)
    todo = [(np.arange(n_points), np.arange(len(x)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            tries = x[p[rng.integers(len(p), size=4)]]
            some = x[p[rng.integers(len(p), size=256)]]
            v = max(tries, key=lambda t: float(distance(some, t).std()))
            dp, dq = distance(x[p], v), distance(x[q], v)
            near = np.concatenate((p[dp <= radius // 2], q[dq <= radius // 2]))
            if len(near):  # within radius / 2 of v, hence within radius of each other
                links.join(near[1:], np.repeat(near[:1], len(near) - 1))
            if dp.min() < dp.max():
                op, oq = np.argsort(dp, kind="stable"), np.argsort(dq, kind="stable")
                sp, sq = dp[op].astype(np.int32), dq[oq].astype(np.int32)
                for d in np.unique(sp).tolist():
                    a, b = np.searchsorted(sp, (d, d + 1))
                    c, e = np.searchsorted(sq, (d - radius, d + radius + 1))
                    todo.append((p[op[a:b]], q[oq[c:e]]))
                continue
        _compare(x, p, q, links, radius)
    return links


def near_links(points: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (column fp) -> (a, b): stars whose components are those of all pairs within radius."""
    spark = points.sparkSession
    n = points.count()
    sample = spread_sample(points, SAMPLE_ROWS, n, "fp").toPandas()["fp"].to_numpy(np.int64)
    tree = Tree(np.sort(sample).view(np.uint64), SHARD_POINTS / max(n, 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            x = fp.view(np.uint64)
            home = tree.home(x)
            for leaf, i in tree.visits(x, radius):
                h = home[i]
                # of leaves i and j one sends its visitors to the other, in turn
                send = (h == leaf) | np.where((h + leaf) % 2 == 0, h < leaf, h > leaf)
                i = i[send]
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), leaf, np.int32)), pa.array(fp[i]), pa.array(home[i] == leaf)],
                        names=["leaf", "fp", "home"])

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home", "fp"], ascending=[False, True])
        fp = pdf["fp"].to_numpy()
        links = search(np.ascontiguousarray(fp).view(np.uint64), int(pdf["home"].sum()), radius)
        roots = links.roots(np.arange(len(fp)))
        linked = roots != np.arange(len(fp))
        return pd.DataFrame({"a": fp[linked], "b": fp[roots[linked]]})

    dealt = points.mapInArrow(deal, "leaf int, fp long, home boolean").repartition(shuffle_partitions(spark), "leaf")
    return dealt.groupBy("leaf").applyInPandas(shard, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
                   text_col: str = "text", also: tuple[str, ...] = (), rooted: bool = False) -> DataFrame:
    """(id, *also, fp, component_id) per row of ``docs``; with ``rooted`` root, too.

    component_id: the smallest id reachable over links of at most ``radius`` differing
    bits, the row's own id included.  A null or blank text has fingerprint 0 and is
    linked like any other; rows with equal ids are rows of their own; a null id names no
    component, so only rows that reach no id get a null.  An empty table gives none.
    root, a fingerprint of the component, tells components apart that share an id.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col, also), "simhash-fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    links = written(near_links(least.select("fp"), radius), "simhash-links")  # read twice below
    roots = components(links)
    joined = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    last = ["component_id", "root"] if rooted else ["component_id"]
    named = written(joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root")
                    .select("fp", *last), "simhash-components")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), *also, "fp", *last)
