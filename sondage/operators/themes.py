"""Themes in open-ended answers: TF-IDF and non-negative matrix factorisation, for all columns in the same jobs.

* Vocabulary: tasks count words and documents per (column, word), Spark sums them, and the
  ``max_features`` most frequent words of each column come to the driver.  A term of two words is
  not more frequent than either, so only pairs of words as frequent as the last of these are
  counted in a second pass; the most frequent of both kinds are the vocabulary.
* TF-IDF rows are made by a map over the documents, without a shuffle.
* Start: the leading singular vectors of each column's matrix X by block Krylov iteration.  A pass
  sums X'(XQ) over the documents for all columns; it ends when the singular values stand still, so
  the random block it begins with leaves no trace.  Positive and negative parts of the vectors give
  the start of H, zeros are filled with the mean of X (non-negative double SVD).
* Factorisation: block coordinate descent.  A pass solves every document's weights for the
  present H and sums W'X and W'W, from which the driver solves H (topics x terms).  Both
  sides are solved by coordinate descent until they stand still.  Columns that have converged
  leave the passes.

Only vocabularies and topic matrices (columns x topics x terms) are held by the driver.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..partitioning import balance
from ..session import scratch_path

TOKEN = re.compile(r"\w\w+")
FLUSH_TERMS = 1 << 19  # terms that a task counts before it hands them on
PAIR_WORDS = 1 << 18  # frequent words that tasks are sent; with more of them, all pairs are counted
TERM_BUCKETS = 64  # first-step choices of a column's terms
OVERSAMPLE = 4  # vectors of a block beyond the topics
SVD_PASSES, SVD_TOL = 20, 1e-8
SWEEPS, SWEEP_TOL = 500, 1e-10
EPS = 1e-6  # entries of the start below this are filled


@dataclass
class Vectoriser:
    """How one column's texts become vectors."""

    ngram: int
    stop: frozenset
    terms: list = field(default_factory=list)
    idf: np.ndarray | None = None
    number: dict = field(default_factory=dict)  # words of the vocabulary, alone or in pairs; stop words: -2
    single: np.ndarray | None = None  # by word number: its place in the vocabulary, or -1
    pairs: np.ndarray | None = None  # pairs of word numbers, ascending
    pair_at: np.ndarray | None = None  # their places in the vocabulary

    def learn(self, terms: list, idf: list) -> None:
        self.terms, self.idf = terms, np.array(idf)
        split = [term.split(" ") for term in terms]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for parts in split for w in parts))}
        self.single = np.full(len(words), -1, np.int64)
        pairs = []
        for i, (a, *b) in enumerate(split):
            if b:
                pairs.append((words[a] * len(words) + words[b[0]], i))
            else:
                self.single[words[a]] = i
        keys = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.pair_at = keys[:, 0], keys[:, 1]
        self.number = words | dict.fromkeys(self.stop, -2)

    def words(self, text: str) -> list:
        return [w for w in TOKEN.findall(text.lower()) if w not in self.stop]

    def grams(self, text: str) -> list:
        words = self.words(text)
        return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] if self.ngram > 1 else words

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of the text's row, of length 1; empty without a term of the vocabulary."""
        at = np.array(list(map(self.number.get, TOKEN.findall(text.lower()), repeat(-1))), np.int64)
        at = at[at != -2]
        found = self.single[at[at >= 0]]
        found = found[found >= 0]
        if len(self.pairs):
            first, second = at[:-1], at[1:]
            known = (first >= 0) & (second >= 0)
            key = first[known] * len(self.single) + second[known]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            found = np.concatenate([found, self.pair_at[place[self.pairs[place] == key]]])
        idx, counts = np.unique(found, return_counts=True)
        idx = idx.astype(np.int32)
        val = counts.astype(np.float64) * self.idf[idx]
        norm = math.sqrt(float(val @ val))
        return idx, val / norm if norm else val


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _term_counts(grams: dict):
    """Counts and documents of the terms that ``grams[col](text)`` lists, as far as a task has seen them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, size = {}, {}, 0

        def flush():
            for c, counts in total.items():
                terms = list(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([c] * len(terms), pa.int32()), pa.array(terms, pa.string()), pa.array(list(counts.values()), pa.int64()),
                    pa.array([docs[c][t] for t in terms], pa.int64())], names=["col", "term", "total", "docs"])

        for batch in batches:
            for c, text in zip(batch.column("col").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms = grams[c](text)
                own = total.setdefault(c, Counter())
                before = len(own)
                own.update(terms)
                docs.setdefault(c, Counter()).update(set(terms))
                size += len(own) - before
                if size > FLUSH_TERMS:
                    yield from flush()
                    total, docs, size = {}, {}, 0
        yield from flush()

    return run


def _pairs(maker: Vectoriser, kept: frozenset | None):
    """Lists a text's terms of two words, both of them in ``kept`` unless that is None."""
    def pairs(text: str) -> list:
        words = maker.words(text)
        if kept is not None:
            words = [w if w in kept else None for w in words]
        return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a and b]

    return pairs


def _summed(docs: DataFrame, grams: dict, min_df: int) -> DataFrame:
    """(col, term, total, docs) of the terms in at least ``min_df`` documents, over the columns in ``grams``."""
    chosen = docs.where(F.col("col").isin(list(grams))).select("col", "text")
    counts = chosen.mapInArrow(_term_counts(grams), "col int, term string, total long, docs long")
    return counts.groupBy("col", "term").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_df)


def _most_frequent(summed: DataFrame, most: int) -> dict:
    """col -> its ``most`` first (term, total, docs) by total, then by term.

    Two steps (per bucket of terms, then per column), so that no column's terms meet in one task.
    """
    order = [F.desc("total"), F.col("term")]
    inside = Window.partitionBy("col", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS))).orderBy(*order)
    first = summed.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= most)
    top = first.withColumn("place", F.row_number().over(Window.partitionBy("col").orderBy(*order))).where(F.col("place") <= most)
    found: dict = {}
    for r in sorted(top.collect(), key=lambda r: (r["col"], r["place"])):  # max_features x columns
        found.setdefault(r["col"], []).append((r["term"], r["total"], r["docs"]))
    return found


def vocabularies(docs: DataFrame, makers: dict, sizes: dict, max_features: int, min_df: int) -> None:
    """Fill the vocabularies of ``makers`` (column -> Vectoriser): at most ``max_features`` terms a column,
    by total count, then in order.  ``docs``: (col, id, text); ``sizes``: documents by column.

    A pair of words has at most the total and the documents of either word.  Where single words fill the
    vocabulary, pairs with a word below the last one's total can't enter, and aren't counted.
    """
    words = _written(_summed(docs, {c: m.words for c, m in makers.items()}, min_df), "theme-words")
    found = _most_frequent(words, max_features)
    grams = {}
    for c, m in makers.items():
        if m.ngram > 1 and c in found:
            least = found[c][-1][1] if len(found[c]) == max_features else 0
            kept = words.where((F.col("col") == c) & (F.col("total") >= least)).select("term").limit(PAIR_WORDS + 1).toArrow()
            grams[c] = _pairs(m, frozenset(kept.column("term").to_pylist()) if kept.num_rows <= PAIR_WORDS else None)
    pairs = _most_frequent(_summed(docs, grams, min_df), max_features) if grams else {}
    for c, terms in found.items():
        best = sorted(terms + pairs.get(c, []), key=lambda t: (-t[1], t[0]))[:max_features]
        best.sort()
        makers[c].learn([t for t, _, _ in best], [math.log((1 + sizes[c]) / (1 + n)) + 1.0 for _, _, n in best])


def _vectors(makers: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, out = [], []
            for c, text in zip(batch.column("col").to_pylist(), batch.column("text").to_pylist(), strict=True):
                idx, val = makers[c].vector(text)
                if len(idx):
                    cols.append(c)
                    out.append((idx, val))
            ends = pa.array(np.cumsum([0, *(len(i) for i, _ in out)]).astype(np.int32))
            idx = np.concatenate([np.zeros(0, np.int32), *(i for i, _ in out)])
            val = np.concatenate([np.zeros(0), *(v for _, v in out)])
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(idx)),
                                              pa.ListArray.from_arrays(ends, pa.array(val))], names=["col", "idx", "val"])

    return run


# ---------------------------------------------------------------------------
# Passes
# ---------------------------------------------------------------------------


class Sparse:
    """Rows of X: their sizes, column indices and values."""

    def __init__(self, sizes: np.ndarray, idx: np.ndarray, val: np.ndarray, width: int):
        self.sizes, self.idx, self.val, self.width = sizes, idx.astype(np.int64), val, width
        self.filled = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.filled]

    def times(self, m: np.ndarray) -> np.ndarray:
        """X m, for m of width x k."""
        out = np.zeros((len(self.sizes), m.shape[1]))
        for t, column in enumerate(np.ascontiguousarray(m.T)):
            if len(self.filled):
                out[self.filled, t] = np.add.reduceat(self.val * column.take(self.idx), self.starts)
        return out

    def back(self, w: np.ndarray) -> np.ndarray:
        """X' w, for w of rows x k."""
        return np.stack([np.bincount(self.idx, self.val * np.repeat(column, self.sizes), self.width) for column in np.ascontiguousarray(w.T)], axis=1)


def _sums(rows: DataFrame, work: dict, widths: dict) -> dict:
    """Sum ``work[col](Sparse) -> matrix`` over all rows of each column in ``work``: col -> matrix.

    A task adds up its own matrices; Spark sums them row by row.
    """
    m = max(k for _, k in widths.values())
    names = [f"v{j}" for j in range(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros(shape) for c, shape in widths.items()}
        for batch in batches:
            cols = batch.column("col").to_numpy()
            sizes = batch.column("idx").value_lengths().to_numpy()
            idx, val = batch.column("idx").flatten().to_numpy(), batch.column("val").flatten().to_numpy()
            for c in np.unique(cols).tolist():
                if c in work:
                    entry = np.repeat(cols == c, sizes)
                    total[c] += work[c](Sparse(sizes[cols == c], idx[entry], val[entry], work[c].width))
        for c, x in total.items():
            at = np.flatnonzero(x.any(axis=1))
            full = np.zeros((len(at), m))
            full[:, : x.shape[1]] = x[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)),
                                              *(pa.array(full[:, j]) for j in range(m))], names=["col", "row", *names])

    part = rows.where(F.col("col").isin(list(work))).mapInArrow(run, "col int, row int, " + ", ".join(f"{n} double" for n in names))
    got = part.groupBy("col", "row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    cols, at = got.column("col").to_numpy(), got.column("row").to_numpy()
    values = np.stack([got.column(n).to_numpy() for n in names], axis=1) if len(cols) else np.zeros((0, m))
    out = {}
    for c, shape in widths.items():
        out[c] = np.zeros(shape)
        out[c][at[cols == c]] = values[cols == c][:, : shape[1]]
    return out


class SubspaceStep:
    """X'(XQ), and below it the squared norms of the positive and negative parts of XQ."""

    def __init__(self, q: np.ndarray):
        self.q, self.width = q, len(q)

    def __call__(self, x: Sparse) -> np.ndarray:
        y = x.times(self.q)
        return np.vstack([x.back(y), (np.maximum(y, 0) ** 2).sum(axis=0), (np.minimum(y, 0) ** 2).sum(axis=0)])


class WeightStep:
    """X'W for the best weights W given H, and below it W'W."""

    def __init__(self, h: np.ndarray):
        self.h, self.width, self.gram = h, h.shape[1], h @ h.T

    def __call__(self, x: Sparse) -> np.ndarray:
        w = solve(x.times(self.h.T), self.gram)
        return np.vstack([x.back(w), w.T @ w])


def solve(b: np.ndarray, gram: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Rows w >= 0 least in w gram w' / 2 - b w', by coordinate descent until they stand still."""
    w = np.zeros_like(b) if start is None else start.copy()
    live = np.arange(len(b))
    for _ in range(SWEEPS):
        change = np.zeros(len(live))
        part = w[live]
        for t in np.flatnonzero(np.diag(gram) > 0):
            new = np.maximum(part[:, t] - (part @ gram[:, t] - b[live, t]) / gram[t, t], 0)
            np.maximum(change, np.abs(new - part[:, t]), out=change)
            part[:, t] = new
        w[live] = part
        live = live[change > SWEEP_TOL * np.maximum(part.max(axis=1, initial=0), 1e-300)]
        if not len(live):
            break
    return w


class Krylov:
    """The leading eigenvectors of C = X'X of one column from products C q with blocks q."""

    def __init__(self, v: int, k: int, seed: Sequence[int]):
        self.k, self.width = k, min(k + OVERSAMPLE, v)
        self.block = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, self.width)))[0]
        self.basis, self.images, self.values, self.vectors = [], [], None, None

    def learn(self, image: np.ndarray) -> bool:
        """``image`` = C block.  True when the leading eigenvalues stand still; else the next block is ready."""
        self.basis.append(self.block)
        self.images.append(image)
        q, z = np.hstack(self.basis), np.hstack(self.images)
        small = q.T @ z
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][: self.k], turn[:, ::-1][:, : self.k]
        still = self.values is not None and np.abs(values - self.values).max() <= SVD_TOL * max(values[0], 1e-300)
        self.values, self.vectors = values, q @ turn
        if still or len(self.basis) == SVD_PASSES or q.shape[1] >= len(q):
            return True
        rest = image - q @ (q.T @ image)
        rest -= q @ (q.T @ rest)
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        self.block = left[:, size > 1e-10 * max(values[0], 1e-300)][:, : len(q) - q.shape[1]]
        return self.block.shape[1] == 0


def leading_vectors(rows: DataFrame, widths: dict, ks: dict, seed: int) -> dict:
    """col -> (singular values, right singular vectors as columns, norms of the positive and negative parts of the left ones)."""
    state = {c: Krylov(v, ks[c], [seed, c]) for c, v in widths.items()}
    out, ready = {}, set()
    while state:
        blocks = {c: s.vectors if c in ready else s.block for c, s in state.items()}
        steps = {c: SubspaceStep(x) for c, x in blocks.items()}
        for c, s in _sums(rows, steps, {c: (widths[c] + 2, x.shape[1]) for c, x in blocks.items()}).items():
            if c in ready:  # a last pass with the vectors themselves, for the signs of the left ones
                values = np.sqrt(np.maximum(state[c].values, 0))
                out[c] = (values, state[c].vectors, np.sqrt(s[-2:]) / np.where(values > 0, values, 1))
                del state[c]
            elif state[c].learn(s[:-2]):
                ready.add(c)
    return out


def nnd_start(values: np.ndarray, v: np.ndarray, norms: np.ndarray, mean: float) -> np.ndarray:
    """H (topics x terms) from the leading vectors: of each, the part (positive or negative) that weighs more; zeros become ``mean``."""
    h = np.zeros(v.shape[::-1])
    for t in range(len(values)):
        if t == 0:
            h[t] = math.sqrt(values[0]) * np.abs(v[:, 0])
            continue
        plus, minus = np.maximum(v[:, t], 0), np.maximum(-v[:, t], 0)
        sizes = [norms[0, t] * np.linalg.norm(plus), norms[1, t] * np.linalg.norm(minus)]
        part, size = (plus, sizes[0]) if sizes[0] > sizes[1] else (minus, sizes[1])
        h[t] = math.sqrt(values[t] * size) * part / (np.linalg.norm(part) or 1.0)
    h[h < EPS] = mean
    return h


def factorise(rows: DataFrame, widths: dict, ks: dict, sizes: dict, max_iter: int = 400, tol: float = 1e-3, seed: int = 42) -> dict:
    """col -> H (topics x terms).  ``rows``: (col, idx, val), written; ``sizes``: rows of X by column, empty ones included.

    Ends per column when the projected gradient of H has fallen to ``tol`` of the first, or after ``max_iter`` passes.
    """
    mean = {r["col"]: r["s"] for r in rows.groupBy("col").agg(F.sum(F.aggregate("val", F.lit(0.0), lambda a, x: a + x)).alias("s")).collect()}
    h = {c: nnd_start(*found, mean[c] / sizes[c] / widths[c]) for c, found in leading_vectors(rows, widths, ks, seed).items()}
    done, first = {}, {}
    for _ in range(max_iter):
        steps = {c: WeightStep(x) for c, x in h.items() if c not in done}
        if not steps:
            break
        for c, s in _sums(rows, steps, {c: (widths[c] + ks[c], ks[c]) for c in steps}).items():
            xw, ww = s[: widths[c]], s[widths[c]:]
            grad = h[c].T @ ww - xw
            off = float(np.abs(np.where(h[c].T > 0, grad, np.minimum(grad, 0))).sum())
            first.setdefault(c, off)
            if off <= max(tol * first[c], 1e-8 * float(np.abs(xw).sum())):  # or nothing but rounding is left
                done[c] = True
            else:
                h[c] = solve(xw, ww, h[c].T).T
    return h


# ---------------------------------------------------------------------------
# The analysis
# ---------------------------------------------------------------------------


def _weighted(makers: dict, h: dict):
    """(col, id, text, verbatim) -> the same with the weights of every topic; all zero without a term of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, texts = batch.column("col").to_pylist(), batch.column("text").to_pylist()
            weights = [[] for _ in cols]
            for c in set(cols) & set(h):
                at = [i for i, x in enumerate(cols) if x == c]
                found = [makers[c].vector(texts[i]) for i in at]
                x = Sparse(np.array([len(idx) for idx, _ in found]), *map(np.concatenate, zip(*found, strict=True)), h[c].shape[1])
                for i, w in zip(at, solve(x.times(h[c].T), h[c] @ h[c].T).tolist(), strict=True):
                    weights[i] = w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.list_(pa.float64()))], names=[*batch.schema.names, "weights"])

    return run


def _documents(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(col, id, verbatim, text) of all cells with a text, in one scan; ``col`` numbers ``columns``."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("verbatim")) for i, c in enumerate(columns)])
    long = df.select(F.col(id_col).alias("id"), F.explode(cells).alias("cell")).select("cell.col", "id", "cell.verbatim")
    # written, as the texts are cleaned by patterns and read by three passes
    cleaned = balance(long.where("verbatim IS NOT NULL").withColumn("text", S.clean_text(F.col("verbatim"))), "id")
    return _written(cleaned, "theme-texts").where("text <> ''")


def theme_analysis(df: DataFrame, id_col: str, columns: Sequence[str], save_name: str = "themes", language: str = "en",
                   n_topics: int | None = None, max_features: int = 5000, top_terms: int = 8, exemplars: int = 3, min_df: int = 2,
                   assign_threshold: float = 0.35, seed: int = 42, outer: int = 400, tol: float = 1e-3,
                   stop_words: Sequence[str] | None = None, labels: Sequence[str] | None = None) -> dict:
    """Themes of all open-ended ``columns`` at once; columns that ``df`` lacks are passed over.

    Returns DataFrames ``themes`` (oe_column, theme, label, top_terms, count, pct, pct_1dp),
    ``assignments`` (oe_column, id, verbatim, assigned, assigned_themes), ``exemplars`` (oe_column,
    theme, rank, id, quote, weight) and ``dictionary`` (json, one row: save_name, language, columns
    with their themes' labels and top terms, meta); and ``models``: column -> (vocabulary, H).

    A column whose terms are all stop words or too rare falls back to single words without
    stop words; one without any term or text has an entry without themes and, if it has texts,
    these are assigned to nothing.  ``stop_words``: Spark's English list unless given.
    ``labels``: names of the columns in the results.
    """
    spark = df.sparkSession
    pairs = [(c, n) for c, n in zip(columns, labels or columns, strict=True) if c in df.columns]
    columns, labels = [c for c, _ in pairs], [n for _, n in pairs]
    id_type = dict(df.dtypes)[id_col]
    docs = _documents(df, id_col, columns) if columns else spark.createDataFrame(
        [], f"col int, id {id_type}, verbatim string, text string")
    counted = docs.groupBy("col").agg(F.count(F.lit(1)).alias("n")).withColumn("topics", S.auto_topics(F.col("n"))).collect()
    sizes, topics = {r["col"]: r["n"] for r in counted}, {r["col"]: n_topics or r["topics"] for r in counted}

    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words)
    makers = {c: Vectoriser(2, stop) for c in sizes}
    if makers:
        vocabularies(docs, makers, sizes, max_features, min_df)
    bare = {c: Vectoriser(1, frozenset()) for c in sizes if not makers[c].terms}
    if bare:
        vocabularies(docs, bare, sizes, max_features, 1)
        makers |= bare
    widths = {c: len(m.terms) for c, m in makers.items() if m.terms}
    ks = {c: min(topics[c], sizes[c], v) for c, v in widths.items()}
    h = {}
    if widths:
        vectors = docs.where(F.col("col").isin(list(widths))).select("col", "text")
        rows = _written(vectors.mapInArrow(_vectors(makers), "col int, idx array<int>, val array<double>"), "theme-vectors")
        h = factorise(rows, widths, ks, sizes, outer, tol, seed)

    found = {c: [[makers[c].terms[j] for j in np.argsort(-x, kind="stable")[:top_terms]] for x in h[c]] for c in h}
    names = {c: [f"Theme {t + 1}: " + ", ".join(terms[:3]) for t, terms in enumerate(found[c])] for c in h}
    rows_of = [(c, labels[c], t + 1, names[c][t], ", ".join(found[c][t]), sizes[c]) for c in sorted(h) for t in range(ks[c])]
    model = spark.createDataFrame(rows_of, "col int, oe_column string, theme int, label string, top_terms string, n long")

    fields = f"col int, id {id_type}, verbatim string, text string"
    weighted = docs.select("col", "id", "verbatim", "text").mapInArrow(_weighted(makers, h), f"{fields}, weights array<double>")
    top = F.array_max("weights")
    bar = F.lit(assign_threshold) * F.when(top == 0, F.lit(1e-9)).otherwise(top)
    over = F.filter(F.transform("weights", lambda w, i: F.when(w >= bar, i + 1)), lambda i: i.isNotNull())
    best = F.when(F.size("weights") > 0, F.array(F.array_position("weights", top).cast("int"))).otherwise(F.array().cast("array<int>"))
    assigned = _written(weighted.withColumn("assigned", F.when(F.size(over) > 0, over).otherwise(best)), "theme-assigned")

    long = assigned.select("col", "id", "text", F.explode("assigned").alias("theme"), "weights")
    counts = long.groupBy("col", "theme").agg(F.count(F.lit(1)).alias("count"))
    pct = F.col("count") * 100.0 / F.col("n")
    summary = (model.join(counts, ["col", "theme"], "left").fillna(0, subset=["count"])
               .select("oe_column", "theme", "label", "top_terms", F.col("count").cast("long").alias("count"),
                       pct.alias("pct"), F.bround(pct, 1).alias("pct_1dp")))
    label_of = F.broadcast(model.groupBy("col", "oe_column").agg(F.map_from_entries(F.collect_list(F.struct("theme", "label"))).alias("label_of")))
    name_of = F.element_at(F.array(*[F.lit(n) for n in labels] or [F.lit("")]), F.col("col") + 1)
    assignments = assigned.join(label_of.drop("oe_column"), "col", "left").select(
        name_of.alias("oe_column"), F.col("id").alias(id_col), "verbatim", "assigned",
        F.coalesce(F.array_join(F.transform("assigned", lambda i: F.col("label_of")[i]), " | "), F.lit("")).alias("assigned_themes"))
    dictionary = {"save_name": save_name, "language": language,
                  "columns": {n: {"themes": [{"label": a, "top_terms": b} for a, b in zip(names.get(c, []), found.get(c, []), strict=True)]}
                              for c, n in enumerate(labels)},
                  "meta": {"method": "TF-IDF + NMF", "assign_threshold": assign_threshold, "min_df": min_df, "max_features": max_features,
                           "top_terms": top_terms, "random_state": seed}}
    return {"themes": summary, "assignments": assignments, "exemplars": _exemplars(long, name_of, id_col, exemplars),
            "dictionary": spark.createDataFrame([(json.dumps(dictionary, ensure_ascii=False, indent=2),)], "json string"),
            "models": {labels[c]: (makers[c].terms, h[c]) for c in h}}


def _exemplars(long: DataFrame, name_of, id_col: str, exemplars: int) -> DataFrame:
    """Of the first documents of each theme, five times ``exemplars``, those with the greatest weights.

    Two steps (per bucket of ids, then per theme), so that no theme lands whole in one task.
    """
    cap = exemplars * 5
    rows = long.select("col", "theme", "id", "text", F.element_at("weights", F.col("theme")).alias("weight"))
    buckets = Window.partitionBy("col", "theme", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id", "text")
    whole = Window.partitionBy("col", "theme")
    first = rows.withColumn("r", F.row_number().over(buckets)).where(F.col("r") <= cap)
    first = first.withColumn("r", F.row_number().over(whole.orderBy("id", "text"))).where(F.col("r") <= cap)
    return (first.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("weight"), "id", "text"))).where(F.col("rank") <= exemplars)
            .select(name_of.alias("oe_column"), "theme", "rank", F.col("id").alias(id_col), F.col("text").alias("quote"), "weight"))


def themes(df: DataFrame, id_col: str, text_col: str, n_topics: int | None = None, max_features: int = 5000, top_terms: int = 8,
           exemplars: int = 3, min_df: int = 2, assign_threshold: float = 0.35, seed: int = 42, outer: int = 400,
           column_label: str | None = None, **options) -> dict:
    """``theme_analysis`` of one column, called ``column_label`` in the results; also ``k``, ``H`` and ``vocab``."""
    options.pop("inner", None)  # both sides are solved until they stand still
    label = column_label or text_col
    out = theme_analysis(df, id_col, [text_col], "themes", "en", n_topics, max_features, top_terms, exemplars, min_df, assign_threshold,
                         seed, outer, labels=[label], **options)
    vocab, h = out["models"].get(label, ([], np.zeros((0, 0))))
    return {**out, "k": len(h), "H": h, "vocab": vocab}
