"""Driver analysis: which attributes drive liking, from one Gram aggregation.

``gram`` is ONE Spark pass over listwise-complete rows for all products: n, means and
centred products of predictors and target.  Tasks merge their batches pairwise, so
the exchange carries one row per product and task no matter how many respondents
there are, and large values lose no digits to cancellation.  Everything the linear methods need
(correlations, standardised OLS, Johnson weights, lasso, condition indices)
is a p x p computation on that row, done per product inside
``applyInPandas`` — the data itself never leaves Spark.

The random forest is in ``forest``; boosted trees and their permutation importance are
in ``boosting``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import _written, boosted_importance
from .forest import forest_importance

# ---------------------------------------------------------------------------
# Gram aggregation
# ---------------------------------------------------------------------------


def valid_predictors(df: DataFrame, predictors: Sequence[str], threshold: float,
                     group: str = "product") -> dict:
    """Per group, the predictors whose null share is <= threshold (one small aggregation)."""
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in predictors]
    rows = df.groupBy(group).agg(*aggs).collect()  # groups x predictors shares, not data
    return {r[group]: [c for c in predictors if r[c] <= threshold] for r in rows}


GRAM_SALTS = 64  # first-step merges of a group


class Moments:
    """Count, means and centred products of rows; two of them merge without the cancellation of raw sums."""

    def __init__(self, n: int, mean: np.ndarray, m2: np.ndarray):
        self.n, self.mean, self.m2 = n, mean, m2

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        c = x - mean
        return cls(len(x), mean, c.T @ c)

    def add(self, other: Moments) -> None:
        n = self.n + other.n
        if not other.n:
            return
        d = other.mean - self.mean
        self.m2 = self.m2 + other.m2 + np.outer(d, d) * (self.n * other.n / n)
        self.mean = self.mean + d * (other.n / n)
        self.n = n


def _moment_rows(states: dict, groups: pa.DataType, salt: int) -> pa.RecordBatch:
    rows = [(g, salt, m.n, m.mean.tolist(), m.m2.ravel().tolist()) for g, m in states.items()]
    kinds = (groups, pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["g", "salt", "n", "mean", "m2"])


def _partial_moments(columns: list, complete: dict | None):
    """Per task: the moments of each group's complete rows, on the columns that must be complete there."""
    everything = np.arange(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], axis=1)
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy()
            for code, g in enumerate(names.dictionary.to_pylist()):
                need = everything if complete is None else np.array([columns.index(c) for c in complete.get(g, [])], int)
                if not len(need):
                    continue
                own = x[codes == code]
                own = own[~np.isnan(own[:, need]).any(axis=1)]
                full = np.zeros_like(own)
                full[:, need] = own[:, need]
                part = Moments.of(full)
                if g in states:
                    states[g].add(part)
                else:
                    states[g] = part
        if states:
            yield _moment_rows(states, kind, TaskContext.get().partitionId() % GRAM_SALTS)

    return run


def _merged_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict = {}
    kind = None
    for batch in batches:
        kind = batch.column("g").type
        for g, n, mean, m2 in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "mean", "m2")), strict=True):
            part = Moments(n, np.array(mean), np.array(m2).reshape(len(mean), len(mean)))
            if g in states:
                states[g].add(part)
            else:
                states[g] = part
    if states:
        yield _moment_rows(states, kind, 0)


def gram(df: DataFrame, columns: Sequence[str], group: str = "product",
         complete: dict | None = None) -> DataFrame:
    """One row per group: n, mean (per column) and m2 (centred products, columns x columns) of its complete rows.

    ``complete`` maps group -> the columns that must be non-null (listwise deletion) and are counted;
    by default all ``columns``.  Groups without a complete row are left out, as are null groups.  Each
    task merges its batches, and tasks merge in two steps, so no task reads a row of every other.
    """
    cols = list(columns)
    x = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    kind = dict(df.dtypes)[group]
    schema = f"g {kind}, salt int, n long, mean array<double>, m2 array<double>"
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = x.mapInArrow(_partial_moments(cols, complete), schema)
    part = part.repartition(tasks, "g", "salt").mapInArrow(_merged_moments, schema)
    whole = part.repartition(tasks, "g").mapInArrow(_merged_moments, schema)
    return whole.where("n > 0").select(F.col("g").alias(group), "n", "mean", "m2")


def gram_long(g: DataFrame, columns: Sequence[str], group: str = "product") -> DataFrame:
    """(group, n, var_i, var_j, s): sums of products, raw, of each pair of columns."""
    cols = list(columns)
    p = len(cols)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("var_i"), F.lit(cols[j]).alias("var_j"))
                      for i in range(p) for j in range(i, p)])
    u = g.withColumn("pair", F.explode(pairs))
    s = F.col("m2")[F.col("pair.i") * p + F.col("pair.j")] + F.col("n") * F.col("mean")[F.col("pair.i")] * F.col("mean")[F.col("pair.j")]
    return u.select(group, "n", "pair.var_i", "pair.var_j", s.alias("s"))


def _moments(row: pd.Series, p: int):
    """(n, mean vector, population covariance) from one Gram row."""
    n = float(row["n"])
    return n, np.array(row["mean"], dtype=float), np.array(row["m2"], dtype=float).reshape(p, p) / n


def _corr(cov: np.ndarray):
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = cov / np.outer(sd, sd)
    return r, sd


def _weights(v: np.ndarray) -> np.ndarray:
    a = np.abs(v)
    tot = a.sum()
    return 100.0 * a / tot if tot > 0 else np.zeros_like(a)


def _lasso_cd(rxx: np.ndarray, rxy: np.ndarray, alpha: float, tol: float = 1e-12, max_iter: int = 100000):
    """Coordinate descent for (1/2n)||y - Xw||^2 + alpha ||w||_1 on standardised data (Gram form)."""
    p = len(rxy)
    w = np.zeros(p)
    for _ in range(max_iter):
        w_max, d_max = 0.0, 0.0
        for j in range(p):
            if rxx[j, j] <= 0:
                continue
            old = w[j]
            rho = rxy[j] - rxx[j] @ w + rxx[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / rxx[j, j]
            d_max = max(d_max, abs(w[j] - old))
            w_max = max(w_max, abs(w[j]))
        if w_max == 0.0 or d_max / w_max < tol:
            break
    return w


def _solve_linear(pdf: pd.DataFrame, group: str, cols: list, target: str, valid: dict,
                  alpha: float) -> pd.DataFrame:
    out = []
    for _, row in pdf.iterrows():
        g = row[group]
        preds = valid.get(g, [])
        if row["n"] is None or row["n"] == 0 or not preds:
            continue
        p_all = len(cols)
        n, m, cov = _moments(row, p_all)
        t = cols.index(target)
        # a constant predictor (or target) has no correlation; it is left out
        preds = [c for c in preds if cov[cols.index(c), cols.index(c)] > 1e-12]
        if not preds or cov[t, t] <= 1e-12:
            continue
        idx = [cols.index(c) for c in preds]
        r, sd = _corr(cov)
        rxx, rxy = r[np.ix_(idx, idx)], r[idx, t]
        # standardised OLS with intercept (min-norm solution when singular)
        beta = np.linalg.pinv(rxx) @ rxy
        # Johnson: raw_j = sum_k q_jk^2 (q_k' c)^2 / lambda_k, c = cov(z_x, y)
        lam, q = np.linalg.eigh(rxx)
        c = cov[idx, t] / sd[idx]
        keep = lam > 1e-12 * max(lam.max(), 1e-300)
        proj = q.T @ c
        raw = (q[:, keep] ** 2) @ (proj[keep] ** 2 / lam[keep])
        jw = 100.0 * raw / raw.sum() if raw.sum() > 0 else np.zeros_like(raw)
        lw = _lasso_cd(rxx, rxy, alpha)
        bw = _weights(beta)
        lsw = _weights(lw)
        for k, v in enumerate(preds):
            out.append((g, v, int(n), float(bw[k]), float(jw[k]), float(lsw[k])))
    return pd.DataFrame(out, columns=[group, "variable", "n_rows", "linear_weight", "johnson_weight",
                                      "lasso_weight"])


def linear_drivers(df: DataFrame, predictors: Sequence[str], target: str, threshold: float = 0.3,
                   group: str = "product", alpha: float = 0.01) -> DataFrame:
    """Linear (|standardised beta|), Johnson relative weights and lasso |coef|, each summing to 100.

    Predictors over the missing-share ``threshold`` are dropped per group, then
    rows incomplete on the kept predictors or the target are deleted.  Predictors that
    do not vary in a group get no row there, nor does a group whose target is constant.
    """
    preds = [c for c in dict.fromkeys(predictors) if c != target]
    valid = valid_predictors(df, preds, threshold, group)
    cols = preds + [target]
    g = gram(df, cols, group, {k: v + [target] for k, v in valid.items()})
    schema = f"{group} string, variable string, n_rows long, linear_weight double, johnson_weight double, " \
             "lasso_weight double"
    return g.groupBy(group).applyInPandas(
        lambda pdf: _solve_linear(pdf, group, cols, target, valid, alpha), schema)


def ols_signed(df: DataFrame, predictors: Sequence[str], target: str, group: str = "product",
               standardize: bool = True) -> DataFrame:
    """Signed OLS coefficients (standardised by default) with R^2 and adjusted R^2 per group."""
    preds = list(dict.fromkeys(predictors))
    missing = [c for c in preds + [target] if c not in df.columns]
    if missing:
        raise KeyError(f"Columns not found: {missing}")
    cols = preds + [target]
    g = gram(df, cols, group)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in pdf.iterrows():
            n, m, cov = _moments(row, len(cols))
            if n < 2:
                continue
            var = np.diag(cov)
            keep = [i for i in range(len(preds)) if var[i] > 1e-12]
            if not keep:
                continue
            t = len(cols) - 1
            sxx, sxy = cov[np.ix_(keep, keep)], cov[keep, t]
            b = np.linalg.pinv(sxx) @ sxy
            r2 = float(sxy @ b / cov[t, t]) if cov[t, t] > 0 else float("nan")
            k = len(keep)
            adj = 1 - (1 - r2) * (n - 1) / (n - k - 1) if n - k - 1 > 0 else float("nan")
            if standardize:
                b = b * np.sqrt(var[keep]) / np.sqrt(cov[t, t])
            for bi, i in zip(b, keep):
                out.append((row[group], preds[i], int(n), float(bi), r2, adj))
        return pd.DataFrame(out, columns=[group, "variable", "n_rows", "ols_coefficient", "r2", "adj_r2"])

    return g.groupBy(group).applyInPandas(
        solve, f"{group} string, variable string, n_rows long, ols_coefficient double, r2 double, adj_r2 double")


def condition_index(df: DataFrame, predictors: Sequence[str], threshold: float,
                    group: str = "product") -> DataFrame:
    """Condition indices and variance-decomposition proportions of the predictor correlation matrix.

    Long output (group, component, eigenvalue, condition_index, variable, vdp):
    components in descending eigenvalue order; vdp normalised per predictor.
    Zero-variance predictors are dropped first (their correlation is undefined).
    """
    preds = list(dict.fromkeys(predictors))
    valid = valid_predictors(df, preds, threshold, group)
    g = gram(df, preds, group, valid)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in pdf.iterrows():
            gv = row[group]
            vp = valid.get(gv, [])
            if not row["n"] or not vp:
                continue
            n, m, cov = _moments(row, len(preds))
            idx = [preds.index(c) for c in vp]
            idx = [i for i in idx if cov[i, i] > 1e-12]
            if not idx:
                continue
            r, _ = _corr(cov[np.ix_(idx, idx)])
            lam, phi = np.linalg.eigh(r)
            order = np.argsort(lam)[::-1]
            lam, phi = lam[order], phi[:, order]
            ci = np.sqrt(lam[0] / lam)
            vd = np.abs(phi ** 2 / lam[None, :])
            vd = vd / vd.sum(axis=1, keepdims=True)
            for k in range(len(lam)):
                for j, i in enumerate(idx):
                    out.append((gv, k + 1, float(lam[k]), float(ci[k]), preds[i], float(vd[j, k])))
        return pd.DataFrame(out, columns=[group, "component", "eigenvalue", "condition_index", "variable", "vdp"])

    return g.groupBy(group).applyInPandas(
        solve, f"{group} string, component int, eigenvalue double, condition_index double, variable string, "
               "vdp double")


# ---------------------------------------------------------------------------
# Tree methods
# ---------------------------------------------------------------------------


def random_forest_importance(df: DataFrame, predictors: Sequence[str], target: str, threshold: float = 0.3,
                             group: str = "product", num_trees: int = 100, seed: int = 42,
                             max_depth: int | None = None) -> DataFrame:
    """Impurity importances of a 100-tree random forest (sqrt features, no depth limit), to 100, per group.

    All trees of all groups grow in the same jobs; see ``forest`` for the method.
    """
    return forest_importance(df, predictors, target, threshold, group, num_trees, seed, max_depth)


def gbt_permutation_importance(df: DataFrame, predictors: Sequence[str], target: str, threshold: float = 0.99,
                               group: str = "product", repeats: int = 5, seed: int = 42,
                               max_iter: int = 100, **options) -> DataFrame:
    """Histogram-boosted trees, permutation importance (MSE increase, clipped at 0, to 100) per group.

    Threshold > 1 is a percentage.  Missing answers stay missing (each split learns their
    side), but for 0/1 predictors, where they become 0; rows with a NULL target are
    dropped.  See ``boosting`` for the method and further options.
    """
    return boosted_importance(df, predictors, target, threshold, group, repeats, seed, max_iter, **options)


def driver_merge(df: DataFrame, predictors: Sequence[str], target: str, threshold: float = 0.3,
                 group: str = "product", run_hgb: bool = True) -> DataFrame:
    """Linear, Johnson, lasso and forest weights (and boosted trees) outer-merged on (group, variable)."""
    # written once, as each method reads the rows several times and they may come from joins
    df = _written(df.select(*dict.fromkeys([group, *predictors, target])), "driver-rows")
    out = linear_drivers(df, predictors, target, threshold, group).drop("n_rows")
    out = out.join(random_forest_importance(df, predictors, target, threshold, group), [group, "variable"], "full_outer")
    if run_hgb:
        hgb = gbt_permutation_importance(df, predictors, target, threshold, group)
        out = out.join(hgb, [group, "variable"], "full_outer")
    return out
