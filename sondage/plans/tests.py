"""Registered significance-test queries (statistics + verdicts checked by SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import survey_wide
from ..functions.pvalues import norm_ppf
from ..operators import reshape as R
from ..operators import stats as H
from .registry import query
from .sqlgen import normal_p, unpivot

WIDE = ("survey_wide",)
MW_Q = ["ten_taste", "ten_aroma", "ten_foam", "t2b_store", "liking"]
WX_Q = ["ten_taste", "ten_aroma", "ten_foam", "liking"]
BIN_T4B = ["ten_taste", "ten_aroma"]
BIN_T2B = ["t2b_store", "jar_sweet"]
Z95, Z90 = -norm_ppf(0.025), -norm_ppf(0.05)
REJ, ACC = H.REJECT, H.ACCEPT


def binary_wide(spark, sf):
    """T4B (7-10) and T2B (4-5) dichotomisation in one projection of the wide table."""
    w = survey_wide(spark, sf)
    a = R.dichotomize(w, BIN_T4B, [7, 8, 9, 10], keep=["customer_id", "product", *BIN_T2B])
    return R.dichotomize(a, BIN_T2B, [4, 5], keep=["customer_id", "product", *BIN_T4B])


def _binary_sql():
    t4 = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} IN (7, 8, 9, 10) THEN 1 ELSE 0 END AS {c}"
                   for c in BIN_T4B)
    t2 = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} IN (4, 5) THEN 1 ELSE 0 END AS {c}"
                   for c in BIN_T2B)
    return f"SELECT customer_id, product, {t4}, {t2} FROM survey_wide"


PAIRS_SQL = """pr AS (SELECT a.product AS name1, b.product AS name2
  FROM (SELECT DISTINCT product FROM survey_wide) a JOIN (SELECT DISTINCT product FROM survey_wide) b
  ON a.product < b.product)"""


def _verdict(cond: str) -> str:
    return f"CASE WHEN {cond} THEN '{REJ}' ELSE '{ACC}' END"


def _mw_sql(cols):
    return f"""
WITH l AS ({unpivot('survey_wide', ['product'], cols)}),
fq AS (SELECT product, question, score AS value, COUNT(*) AS n FROM l WHERE score IS NOT NULL
       GROUP BY product, question, score),
{PAIRS_SQL},
f1 AS (SELECT question, name1, name2, value, n AS n1 FROM fq JOIN pr ON fq.product = pr.name1),
f2 AS (SELECT question, name1, name2, value, n AS n2 FROM fq JOIN pr ON fq.product = pr.name2),
c AS (SELECT COALESCE(f1.question, f2.question) AS question, COALESCE(f1.name1, f2.name1) AS name1,
        COALESCE(f1.name2, f2.name2) AS name2, COALESCE(f1.value, f2.value) AS value,
        COALESCE(f1.n1, 0) AS n1, COALESCE(f2.n2, 0) AS n2
      FROM f1 FULL OUTER JOIN f2 ON f1.question = f2.question AND f1.name1 = f2.name1
        AND f1.name2 = f2.name2 AND f1.value = f2.value),
r AS (SELECT *, n1 + n2 AS t, SUM(n1 + n2) OVER (PARTITION BY question, name1, name2 ORDER BY value
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (n1 + n2) + (n1 + n2 + 1) / 2.0 AS midrank FROM c),
a AS (SELECT question, name1, name2, CAST(SUM(n1) AS BIGINT) AS n1, CAST(SUM(n2) AS BIGINT) AS n2,
        SUM(n1 * midrank) AS r1, SUM(CAST(t AS DOUBLE) * t * t - t) AS tie
      FROM r GROUP BY question, name1, name2),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1, CAST(n1 * n2 AS DOUBLE) AS nn, n1 + n2 AS n FROM a),
z AS (SELECT *, (u1 - nn / 2.0) / sqrt(nn * (n + 1) / 12.0) AS z_r,
        (greatest(u1, nn - u1) - nn / 2.0 - 0.5) / sqrt(nn / 12.0 * ((n + 1) - tie / (n * (n - 1.0)))) AS z_c,
        2.0 * u1 / nn - 1.0 AS delta FROM u)
SELECT question, name1, name2, n1, n2, u1 AS u_statistic, delta AS cliffs_delta,
  CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small'
       WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS strength,
  z_r, abs(z_r) / sqrt(n) AS r,
  CASE WHEN abs(z_r) / sqrt(n) < 0.1 THEN 'negligible' WHEN abs(z_r) / sqrt(n) < 0.3 THEN 'small'
       WHEN abs(z_r) / sqrt(n) < 0.5 THEN 'medium' ELSE 'large' END AS r_z_strength,
  z_c AS z_corrected, round(CASE WHEN z_c <= 0 THEN 1.0 ELSE {normal_p('z_c')} END, 6) AS p_value,
  {_verdict(f'z_c > {Z95!r}')} AS hypothesis_95,
  {_verdict(f'z_c > {Z90!r}')} AS hypothesis_90
FROM z"""


MW_SQL = _mw_sql(MW_Q)


def _rounded(df):
    """p-values to 6 decimals, as their SQL series are added up to rounding errors."""
    return df.withColumn("p_value", F.round("p_value", 6))


@query("mann_whitney", MW_SQL, views=WIDE)
def mann_whitney(spark, sf):
    return _rounded(H.mann_whitney(survey_wide(spark, sf), MW_Q))


@query("cliffs_delta", f"WITH m AS ({MW_SQL}) SELECT question, name1, name2, cliffs_delta, strength FROM m",
       views=WIDE)
def cliffs_delta(spark, sf):
    return H.cliffs_delta(survey_wide(spark, sf), MW_Q)


def _mcnemar_sql():
    cols = BIN_T4B + BIN_T2B
    # p rounded to 4 dp < alpha  <=>  p < alpha - 0.00005  <=>  chi2 > critical value
    c95, c90 = (-norm_ppf(0.04995 / 2)) ** 2, (-norm_ppf(0.09995 / 2)) ** 2
    return f"""
WITH bw AS ({_binary_sql()}),
l AS ({unpivot('bw', ['customer_id', 'product'], cols)}),
lens AS (SELECT product, question, COUNT(*) AS len FROM l GROUP BY product, question),
{PAIRS_SQL},
x AS (SELECT question, name1, name2, customer_id, score AS x FROM l JOIN pr ON l.product = pr.name1),
y AS (SELECT question, name1, name2, customer_id, score AS y FROM l JOIN pr ON l.product = pr.name2),
j AS (SELECT x.question, x.name1, x.name2, x.x, y.y FROM x JOIN y USING (question, name1, name2, customer_id)
      WHERE x.x IS NOT NULL AND y.y IS NOT NULL),
a AS (SELECT question, name1, name2, COUNT(*) AS n_pairs,
        COUNT(CASE WHEN x = 0 AND y = 1 THEN 1 END) AS b, COUNT(CASE WHEN x = 1 AND y = 0 THEN 1 END) AS c,
        MIN(x) <> MAX(x) AND MIN(y) <> MAX(y) AS is22
      FROM j GROUP BY question, name1, name2),
k AS (SELECT a.*, l1.len AS len1, l2.len AS len2, b + c AS disc,
        round_even(CAST((b - c) * (b - c) AS DOUBLE) / NULLIF(b + c, 0), 4) AS stat
      FROM a LEFT JOIN lens l1 ON l1.product = a.name1 AND l1.question = a.question
             LEFT JOIN lens l2 ON l2.product = a.name2 AND l2.question = a.question),
e AS (SELECT k.*, CASE WHEN is22 AND disc > 0 AND disc < 25 THEN
        round_even(least(1.0, 2 * (SELECT SUM(exp(lgamma(disc + 1) - lgamma(i + 1) - lgamma(disc - i + 1) - disc * ln(2)))
                       FROM range(0, least(b, c) + 1) t(i))), 4) END AS p_exact FROM k),
s AS (SELECT *, CASE WHEN NOT is22 THEN 'skip (not 2x2)' WHEN disc = 0 THEN 'no discordant pairs' ELSE 'ok' END AS status
      FROM e)
SELECT question, name1, name2, len1, len2, n_pairs,
  CASE WHEN is22 THEN b END AS b, CASE WHEN is22 THEN c END AS c,
  CASE WHEN is22 AND disc = 0 THEN 0.0 WHEN is22 THEN stat END AS chi2,
  CASE WHEN is22 AND disc > 0 AND disc < 25 THEN 'E' ELSE '' END AS e, status,
  CASE WHEN status <> 'ok' THEN NULL WHEN disc < 25 THEN p_exact ELSE round({normal_p('sqrt(stat)')}, 4) END AS p_value,
  CASE WHEN status <> 'ok' THEN status WHEN disc < 25 THEN {_verdict('p_exact < 0.05')}
       ELSE {_verdict(f'stat > {c95!r}')} END AS confidence_95,
  CASE WHEN status <> 'ok' THEN status WHEN disc < 25 THEN {_verdict('p_exact < 0.10')}
       ELSE {_verdict(f'stat > {c90!r}')} END AS confidence_90
FROM s"""


@query("mcnemar", _mcnemar_sql(), views=WIDE)
def mcnemar(spark, sf):
    return H.mcnemar(binary_wide(spark, sf), BIN_T4B + BIN_T2B)


def _wilcoxon_sql(cols):
    return f"""
WITH l AS ({unpivot('survey_wide', ['customer_id', 'product'], cols)}),
{PAIRS_SQL},
x AS (SELECT question, name1, name2, customer_id, score AS x FROM l JOIN pr ON l.product = pr.name1),
y AS (SELECT question, name1, name2, customer_id, score AS y FROM l JOIN pr ON l.product = pr.name2),
j AS (SELECT x.question, x.name1, x.name2, x.x - y.y AS d FROM x JOIN y USING (question, name1, name2, customer_id)
      WHERE x.x IS NOT NULL AND y.y IS NOT NULL),
dd AS (SELECT question, name1, name2, d, COUNT(*) AS nd FROM j GROUP BY question, name1, name2, d),
ad AS (SELECT question, name1, name2, abs(d) AS ad, SUM(nd) AS t FROM dd WHERE d <> 0
       GROUP BY question, name1, name2, abs(d)),
rk AS (SELECT *, SUM(t) OVER (PARTITION BY question, name1, name2 ORDER BY ad
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - t + (t + 1) / 2.0 AS midrank FROM ad),
w AS (SELECT dd.question, dd.name1, dd.name2,
        SUM(CASE WHEN d > 0 THEN nd * midrank ELSE 0.0 END) AS w_plus,
        SUM(CASE WHEN d < 0 THEN nd * midrank ELSE 0.0 END) AS w_minus, SUM(nd) AS n_nonzero
      FROM dd JOIN rk ON dd.question = rk.question AND dd.name1 = rk.name1 AND dd.name2 = rk.name2
        AND abs(dd.d) = rk.ad WHERE dd.d <> 0 GROUP BY dd.question, dd.name1, dd.name2),
ti AS (SELECT question, name1, name2, SUM(t * (t * t - 1)) AS tie, MAX(t) AS max_t FROM rk
       GROUP BY question, name1, name2),
tot AS (SELECT question, name1, name2, SUM(nd) AS n_pairs, SUM(CASE WHEN d = 0 THEN nd ELSE 0 END) AS n_zero
        FROM dd GROUP BY question, name1, name2),
a AS (SELECT tot.*, w.w_plus, w.w_minus, COALESCE(w.n_nonzero, 0) AS n, ti.tie, ti.max_t
      FROM tot LEFT JOIN w USING (question, name1, name2) LEFT JOIN ti USING (question, name1, name2)),
z AS (SELECT *, least(w_plus, w_minus) AS statistic,
        (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * COALESCE(tie, 0)) / 24.0) AS z
      FROM a WHERE n_pairs > 0)
SELECT question, name1, name2, CAST(n_pairs AS BIGINT) AS n_pairs, CAST(n AS BIGINT) AS n_nonzero,
  w_plus, w_minus, statistic, z, round({normal_p('z')}, 6) AS p_value, (n <= 50 AND COALESCE(max_t, 1) <= 1 AND n_zero = 0) AS exact,
  abs(z) AS z_value, abs(z) / sqrt(n_pairs) AS r,
  CASE WHEN abs(z) / sqrt(n_pairs) > 0.5 THEN 'large' WHEN abs(z) / sqrt(n_pairs) > 0.3 THEN 'moderate'
       WHEN abs(z) / sqrt(n_pairs) >= 0.1 THEN 'small' ELSE 'undetermined' END AS intensity,
  {_verdict(f'abs(z) > {Z95!r}')} AS hypothesis_95,
  {_verdict(f'abs(z) > {Z90!r}')} AS hypothesis_90
FROM z"""


@query("wilcoxon", _wilcoxon_sql(WX_Q), views=WIDE)
def wilcoxon(spark, sf):
    return _rounded(H.wilcoxon(survey_wide(spark, sf), WX_Q))


def _fisher_sql():
    cols = BIN_T2B + BIN_T4B
    return f"""
WITH bw AS ({_binary_sql()}),
l AS ({unpivot('bw', ['product'], cols)}),
fq AS (SELECT product, question, score AS value, COUNT(*) AS n FROM l WHERE score IS NOT NULL
       GROUP BY product, question, score),
{PAIRS_SQL},
f1 AS (SELECT question, name1, name2, value, n AS n1 FROM fq JOIN pr ON fq.product = pr.name1),
f2 AS (SELECT question, name1, name2, value, n AS n2 FROM fq JOIN pr ON fq.product = pr.name2),
c AS (SELECT COALESCE(f1.question, f2.question) AS question, COALESCE(f1.name1, f2.name1) AS name1,
        COALESCE(f1.name2, f2.name2) AS name2, COALESCE(f1.value, f2.value) AS value,
        COALESCE(f1.n1, 0) AS n1, COALESCE(f2.n2, 0) AS n2
      FROM f1 FULL OUTER JOIN f2 ON f1.question = f2.question AND f1.name1 = f2.name1
        AND f1.name2 = f2.name2 AND f1.value = f2.value),
g AS (SELECT question, name1, name2, COUNT(*) AS k, arg_min(n1, value) AS a, arg_min(n2, value) AS b,
        arg_max(n1, value) AS c, arg_max(n2, value) AS d FROM c GROUP BY question, name1, name2),
h AS (SELECT g.*, a + b AS r1, a + c AS c1, a + b + c + d AS n FROM g),
lp AS (SELECT h.question, h.name1, h.name2, x,
         lgamma(r1 + 1) - lgamma(x + 1) - lgamma(r1 - x + 1) + lgamma(n - r1 + 1) - lgamma(c1 - x + 1)
         - lgamma(n - r1 - c1 + x + 1) - lgamma(n + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) AS lpx,
         lgamma(r1 + 1) - lgamma(a + 1) - lgamma(r1 - a + 1) + lgamma(n - r1 + 1) - lgamma(c1 - a + 1)
         - lgamma(n - r1 - c1 + a + 1) - lgamma(n + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) AS lpo
       FROM h, range(greatest(0, c1 - (n - r1)), least(r1, c1) + 1) t(x) WHERE k = 2),
p AS (SELECT question, name1, name2, least(1.0, SUM(CASE WHEN lpx <= lpo + 1e-7 THEN exp(lpx) ELSE 0 END)) AS p
      FROM lp GROUP BY question, name1, name2)
SELECT h.question, h.name1, h.name2, CASE WHEN k = 2 THEN a END AS a, CASE WHEN k = 2 THEN b END AS b,
  CASE WHEN k = 2 THEN c END AS c, CASE WHEN k = 2 THEN d END AS d, p.p AS p_value,
  CASE WHEN k <> 2 THEN 'Not a 2x2 table. Fisher Exact not applicable.' END AS error,
  CASE WHEN p.p IS NULL THEN NULL ELSE {_verdict('p.p < 0.05')} END AS hypothesis_95,
  CASE WHEN p.p IS NULL THEN NULL ELSE {_verdict('p.p < 0.10')} END AS hypothesis_90
FROM h LEFT JOIN p USING (question, name1, name2)"""


@query("fisher", _fisher_sql(), views=WIDE)
def fisher(spark, sf):
    return H.fisher(binary_wide(spark, sf), BIN_T2B + BIN_T4B)


@query("pairs", """
SELECT a.product AS name1, b.product AS name2
FROM (SELECT DISTINCT product FROM survey_wide) a JOIN (SELECT DISTINCT product FROM survey_wide) b
  ON a.product < b.product""", views=WIDE)
def pairs(spark, sf):
    return H.product_pairs(survey_wide(spark, sf))


@query("stats_batch", f"""
SELECT question, name1, name2, 'mann_whitney' AS test, u_statistic AS statistic, p_value, hypothesis_95, hypothesis_90 FROM ({MW_SQL}) m
UNION ALL
SELECT question, name1, name2, 'mcnemar', chi2, p_value, confidence_95, confidence_90 FROM ({_mcnemar_sql()}) c
UNION ALL
SELECT question, name1, name2, 'wilcoxon', statistic, p_value, hypothesis_95, hypothesis_90 FROM ({_wilcoxon_sql(WX_Q)}) w""", views=WIDE)
def stats_batch(spark, sf):
    """Mann-Whitney and McNemar p-values on the same columns, plus Wilcoxon (one long table)."""
    w = survey_wide(spark, sf)
    mw = H.mann_whitney(w, MW_Q).select("question", "name1", "name2", F.lit("mann_whitney").alias("test"),
                                        F.col("u_statistic").alias("statistic"), "p_value",
                                        "hypothesis_95", "hypothesis_90")
    mc = H.mcnemar(binary_wide(spark, sf), BIN_T4B + BIN_T2B).select(
        "question", "name1", "name2", F.lit("mcnemar").alias("test"), F.col("chi2").alias("statistic"),
        "p_value", F.col("confidence_95").alias("hypothesis_95"), F.col("confidence_90").alias("hypothesis_90"))
    wx = H.wilcoxon(w, WX_Q).select("question", "name1", "name2", F.lit("wilcoxon").alias("test"),
                                    "statistic", "p_value", "hypothesis_95", "hypothesis_90")
    return _rounded(mw.unionByName(mc).unionByName(wx))
