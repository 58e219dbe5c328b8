"""Distribution functions for the significance tests (numpy / math only).

These run inside Arrow-batched pandas UDFs over ALREADY AGGREGATED rows
(one row per question x product pair), never per response.  scipy is not
available, so the pieces are written from their textbook definitions:
normal tail via ``math.erfc``, inverse normal by Acklam's rational
approximation plus one Halley step, regularised incomplete beta by Lentz's
continued fraction, exact Mann-Whitney / signed-rank null distributions by
counting DP, binomial and hypergeometric terms in log space.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Inverse standard normal CDF (Acklam + Halley refinement)."""
    if not (p == p) or p <= 0.0 or p >= 1.0:
        if p == 0.0:
            return -math.inf
        if p == 1.0:
            return math.inf
        return math.nan
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
    lo = 0.02425
    if p < lo:
        q = math.sqrt(-2 * math.log(p))
        x = (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    elif p <= 1 - lo:
        q = p - 0.5
        r = q * q
        x = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / \
            (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    else:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -(((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    for _ in range(2):  # Halley refinement to full double precision
        e = norm_cdf(x) - p
        u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
        x = x - u / (1 + x * u / 2)
    return x


def chi2_sf_df1(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 1e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if not (t == t) or not (df == df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > 1e7:
        # normal limit: the t correction is O(t phi(t) (t^2 + 1) / df) < 1e-8 here, while the
        # continued fraction loses precision for such large parameters
        return 2.0 * norm_sf(abs(t))
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def binom_two_sided_half(k: int, n: int) -> float:
    """McNemar exact: min(1, 2 * P(X <= min(k, n - k))), X ~ Bin(n, 1/2).

    Vectorised log-pmf recurrence summed from 50 standard deviations below the
    mode (earlier terms are below double precision), so n in the billions is cheap.
    """
    if n <= 0:
        return 1.0
    k = min(k, n - k)
    mode = n // 2
    lo = max(0, mode - int(50 * math.sqrt(n) / 2) - 1000)
    if k < lo:
        return 0.0
    xs = np.arange(lo, k, dtype=np.float64)
    steps = np.log(n - xs) - np.log(xs + 1)            # log pmf(x+1) - log pmf(x)
    base = math.lgamma(n + 1) - math.lgamma(lo + 1) - math.lgamma(n - lo + 1) - n * math.log(2.0)
    lp = base + np.concatenate([[0.0], np.cumsum(steps)])
    return float(min(1.0, 2.0 * np.exp(lp).sum()))


def _fisher_loop(a: int, b: int, c: int, d: int) -> float:
    """Reference implementation over the full support (small tables, tests)."""
    r1, c1, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, c1 - (n - r1)), min(r1, c1)

    def logp(x):
        return (math.lgamma(r1 + 1) - math.lgamma(x + 1) - math.lgamma(r1 - x + 1)
                + math.lgamma(n - r1 + 1) - math.lgamma(c1 - x + 1) - math.lgamma(n - r1 - c1 + x + 1)
                - math.lgamma(n + 1) + math.lgamma(c1 + 1) + math.lgamma(n - c1 + 1))
    lp_obs = logp(a)
    return min(1.0, sum(math.exp(logp(x)) for x in range(lo, hi + 1) if logp(x) <= lp_obs + 1e-7))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p for [[a, b], [c, d]]: total probability of the tables
    (same margins) no more likely than the observed one (relative tolerance 1e-7).

    Vectorised: log-probabilities from the pmf ratio recurrence over a window
    of +-50 standard deviations around the mode (beyond it every term is below
    double precision), so counts in the billions cost O(sqrt(n)), not O(n).
    """
    r1, c1, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, c1 - (n - r1)), min(r1, c1)
    if hi == lo:
        return 1.0
    var = r1 * c1 * (n - r1) * (n - c1) / (n * n * max(n - 1, 1))
    mode = int((r1 + 1) * (c1 + 1) // (n + 2))
    w = int(50 * math.sqrt(var)) + 1000
    x0, x1 = max(lo, mode - w), min(hi, mode + w)
    xs = np.arange(x0, x1, dtype=np.float64)
    # log p(x+1) - log p(x) = log((r1-x)(c1-x)) - log((x+1)(n-r1-c1+x+1))
    steps = np.log((r1 - xs) * (c1 - xs)) - np.log((xs + 1) * (n - r1 - c1 + xs + 1))
    lpx = np.concatenate([[0.0], np.cumsum(steps)])
    base = (math.lgamma(r1 + 1) - math.lgamma(x0 + 1) - math.lgamma(r1 - x0 + 1)
            + math.lgamma(n - r1 + 1) - math.lgamma(c1 - x0 + 1) - math.lgamma(n - r1 - c1 + x0 + 1)
            - math.lgamma(n + 1) + math.lgamma(c1 + 1) + math.lgamma(n - c1 + 1))
    lpx = lpx + base
    if not (x0 <= a <= x1):
        return 0.0  # observed table is beyond double precision from the mode
    lp_obs = lpx[a - x0]
    keep = lpx <= lp_obs + 1e-7
    return float(min(1.0, np.exp(lpx[keep]).sum()))


def mwu_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U1 >= u) under H0 without ties.

    The counts of arrangements by U are the coefficients of the Gaussian
    binomial [n1 + n2 choose m]_q = prod_{i=1..m} (1 - q^(M+i)) / (1 - q^i)
    with m = min(n1, n2), M = max(n1, n2): m polynomial steps of length
    m*M + 1, i.e. O(m^2 M) work, fine when the small side has <= 8 values
    however large the other is.  U is symmetric, so the side order is free.
    """
    m, big = min(n1, n2), max(n1, n2)
    size = m * big + 1
    c = np.zeros(size)
    c[0] = 1.0
    for i in range(1, m + 1):
        shift = big + i
        if shift < size:
            c[shift:] -= c[:size - shift].copy()   # times (1 - q^(big+i))
        for r in range(i):                         # divided by (1 - q^i): running sum, stride i
            c[r::i] = np.cumsum(c[r::i])
    c = np.clip(c, 0.0, None)
    k = int(math.ceil(u - 1e-9))
    return float(c[k:].sum() / c.sum()) if k < size else 0.0


def signrank_exact_cdf(t: float, n: int) -> float:
    """P(T <= t) of the signed-rank statistic (no ties, no zeros)."""
    mx = n * (n + 1) // 2
    dist = np.zeros(mx + 1)
    dist[0] = 1.0
    for r in range(1, n + 1):
        dist[r:] = dist[r:] + dist[:-r].copy() if r <= mx else dist[r:]
    k = int(math.floor(t + 1e-9))
    return float(dist[:k + 1].sum() / dist.sum())


# ---------------------------------------------------------------------------
# Arrow-batched UDFs over aggregated rows.
# ---------------------------------------------------------------------------

def _num(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


@F.pandas_udf(T.DoubleType())
def mwu_p_udf(u1: pd.Series, n1: pd.Series, n2: pd.Series, tie: pd.Series) -> pd.Series:
    """Two-sided Mann-Whitney p: exact when a sample has <= 8 values and no ties,
    else normal approximation with tie correction and 0.5 continuity."""
    out = []
    for u, a, b, t in zip(u1, n1, n2, tie):
        if _num(u) is None or not a or not b:
            out.append(None)
            continue
        a, b, n = int(a), int(b), int(a) + int(b)
        umax = max(u, a * b - u)
        if (a <= 8 or b <= 8) and t == 0:
            out.append(min(1.0, 2.0 * mwu_exact_sf(umax, a, b)))
            continue
        var = a * b / 12.0 * ((n + 1) - t / (n * (n - 1)))
        if var <= 0:
            out.append(None)
            continue
        z = (umax - a * b / 2.0 - 0.5) / math.sqrt(var)
        out.append(min(1.0, max(0.0, 2.0 * norm_sf(z))))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def mcnemar_p_udf(b: pd.Series, c: pd.Series, stat: pd.Series) -> pd.Series:
    """p rounded to 4 dp: chi-square(1) of the ROUNDED statistic when b + c >= 25,
    else the exact binomial; NULL when there are no discordant pairs."""
    out = []
    for x, y, s in zip(b, c, stat):
        if _num(x) is None or _num(y) is None or x + y == 0:
            out.append(None)
        elif x + y >= 25:
            out.append(round(chi2_sf_df1(float(s)), 4))
        else:
            out.append(round(binom_two_sided_half(int(min(x, y)), int(x + y)), 4))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def wilcoxon_p_udf(stat: pd.Series, n: pd.Series, var: pd.Series, exact: pd.Series) -> pd.Series:
    """Two-sided signed-rank p; normal branch tie-corrected, no continuity correction."""
    out = []
    for t, m, v, ex in zip(stat, n, var, exact):
        if _num(t) is None or not m:
            out.append(None)
            continue
        m = int(m)
        if ex:
            out.append(min(1.0, 2.0 * signrank_exact_cdf(t, m)))
            continue
        if v is None or v <= 0:
            out.append(None)
            continue
        z = (t - m * (m + 1) / 4.0) / math.sqrt(v)
        out.append(min(1.0, 2.0 * norm_sf(abs(z))))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def norm_isf_half_udf(p: pd.Series) -> pd.Series:
    """|Phi^-1(p / 2)| (the z value reported next to a two-sided p)."""
    return pd.Series([None if _num(x) is None else abs(norm_ppf(x / 2.0)) for x in p], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_p_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if any(_num(v) is None for v in r) else fisher_two_sided(*map(int, r))
                      for r in zip(a, b, c, d)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if _num(x) is None or _num(d) is None else t_two_sided(float(x), float(d))
                      for x, d in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def mcnemar_exact_udf(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact McNemar p (unrounded): min(1, 2 * P(X <= min(b, c))), X ~ Bin(b + c, 1/2)."""
    return pd.Series([None if _num(x) is None or _num(y) is None
                      else binom_two_sided_half(int(min(x, y)), int(x + y)) for x, y in zip(b, c)],
                     dtype="float64")
