"""Registered sensory-analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import STUDY, TARGET, survey_wide
from ..operators import reshape as R
from ..operators import sensory as E
from .registry import query
from .sqlgen import t_p, unpivot

WIDE = ("survey_wide",)
JAR = STUDY["JAR"]
ABBREV = {"jar_sweet": "Sweetness", "jar_thick": "Thickness"}
SPEARMAN_COLS = ["ten_taste", "ten_aroma", "ten_foam", "t2b_store", "jar_sweet", "liking"]


@query("cata_dummies", """
SELECT customer_id, product,
  CASE WHEN list_contains(string_split(cata, ','), 'Creamy') THEN 1 ELSE 0 END AS "cata_Creamy",
  CASE WHEN list_contains(string_split(cata, ','), 'Fresh') THEN 1 ELSE 0 END AS "cata_Fresh",
  CASE WHEN list_contains(string_split(cata, ','), 'Sweet') THEN 1 ELSE 0 END AS "cata_Sweet",
  CASE WHEN list_contains(string_split(cata, ','), 'Too Sweet') THEN 1 ELSE 0 END AS "cata_Too Sweet"
FROM survey_wide""", views=WIDE)
def cata_dummies(spark, sf):
    return R.cata_dummies(survey_wide(spark, sf), "cata", ["customer_id", "product"])


@query("cata_mcnemar", """
WITH pr AS (SELECT a.product AS name1, b.product AS name2
  FROM (SELECT DISTINCT product FROM survey_wide) a JOIN (SELECT DISTINCT product FROM survey_wide) b
  ON a.product < b.product),
tok AS (SELECT DISTINCT product, customer_id, token FROM (
  SELECT product, customer_id, unnest(string_split(cata, ',')) AS token FROM survey_wide WHERE cata IS NOT NULL)
  WHERE token <> ''),
vocab AS (SELECT DISTINCT product, token FROM tok),
common AS (SELECT pr.name1, pr.name2, v1.token FROM pr JOIN vocab v1 ON v1.product = pr.name1
  JOIN vocab v2 ON v2.product = pr.name2 AND v2.token = v1.token),
pc AS (SELECT pr.name1, pr.name2, a.customer_id FROM pr
  JOIN (SELECT DISTINCT product, customer_id FROM survey_wide) a ON a.product = pr.name1
  JOIN (SELECT DISTINCT product, customer_id FROM survey_wide) b ON b.product = pr.name2 AND b.customer_id = a.customer_id),
np AS (SELECT name1, name2, COUNT(*) AS n FROM pc GROUP BY name1, name2),
fl AS (SELECT pc.name1, pc.name2, pc.customer_id, cm.token,
         CASE WHEN t1.customer_id IS NOT NULL THEN 1 ELSE 0 END AS x,
         CASE WHEN t2.customer_id IS NOT NULL THEN 1 ELSE 0 END AS y
       FROM pc JOIN common cm ON cm.name1 = pc.name1 AND cm.name2 = pc.name2
       LEFT JOIN tok t1 ON t1.product = pc.name1 AND t1.customer_id = pc.customer_id AND t1.token = cm.token
       LEFT JOIN tok t2 ON t2.product = pc.name2 AND t2.customer_id = pc.customer_id AND t2.token = cm.token),
cnt AS (SELECT name1, name2, token, SUM(x) AS n1, SUM(y) AS n2,
          COUNT(CASE WHEN x = 0 AND y = 1 THEN 1 END) AS b, COUNT(CASE WHEN x = 1 AND y = 0 THEN 1 END) AS c
        FROM fl GROUP BY name1, name2, token),
k AS (SELECT cnt.*, np.n FROM cnt JOIN np USING (name1, name2) WHERE n1 > 0 AND n1 < n AND n2 > 0 AND n2 < n)
SELECT name1, name2, 'cata' AS question, token, string_split('cata_' || token, '_')[-1] AS attribute,
  CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c,
  least(1.0, 2 * (SELECT SUM(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))
                 FROM range(0, least(b, c) + 1) t(i))) AS p_value
FROM k""", views=WIDE)
def cata_mcnemar(spark, sf):
    return E.cata_mcnemar(survey_wide(spark, sf), STUDY["CATA"])


def _cata_penalty_sql(exact: bool) -> str:
    match = "list_contains(r.toks, v.token)" if exact else "strpos(r.cell, v.token) > 0"
    return f"""
WITH r AS (SELECT product, customer_id, cata AS cell, CAST(liking AS DOUBLE) AS y,
             list_transform(string_split(cata, ','), lambda x: trim(x)) AS toks FROM survey_wide),
vocab AS (SELECT DISTINCT product, token FROM (SELECT product, unnest(toks) AS token FROM r WHERE cell IS NOT NULL)
          WHERE token <> ''),
m AS (SELECT v.product, v.token, r.y, CASE WHEN r.cell IS NOT NULL AND {match} THEN 1 ELSE 0 END AS chk
      FROM vocab v JOIN r ON r.product = v.product WHERE r.y IS NOT NULL),
a AS (SELECT product, token, COUNT(CASE WHEN chk = 1 THEN 1 END) AS n_c, COUNT(CASE WHEN chk = 0 THEN 1 END) AS n_u,
        AVG(CASE WHEN chk = 1 THEN y END) AS m_c, AVG(CASE WHEN chk = 0 THEN y END) AS m_u,
        VAR_SAMP(CASE WHEN chk = 1 THEN y END) AS v_c, VAR_SAMP(CASE WHEN chk = 0 THEN y END) AS v_u
      FROM m GROUP BY product, token)
SELECT *, round({t_p('t', 'df')}, 6) AS p_value FROM (
SELECT product, 'cata' AS question, token AS attribute, CAST(n_c AS BIGINT) AS n_checked,
  CAST(n_u AS BIGINT) AS n_not_checked, m_c AS mean_checked, m_u AS mean_not_checked, m_c - m_u AS penalty,
  CASE WHEN n_c > 1 AND n_u > 1 THEN (m_c - m_u) / sqrt(v_c / n_c + v_u / n_u) END AS t,
  CASE WHEN n_c > 1 AND n_u > 1 THEN (v_c / n_c + v_u / n_u) * (v_c / n_c + v_u / n_u)
    / ((v_c / n_c) * (v_c / n_c) / (n_c - 1) + (v_u / n_u) * (v_u / n_u) / (n_u - 1)) END AS df
FROM a) p"""


@query("cata_penalty", _cata_penalty_sql(False), views=WIDE)
def cata_penalty(spark, sf):
    return E.cata_penalty(survey_wide(spark, sf), "cata", TARGET).withColumn("p_value", F.round("p_value", 6))


@query("cata_penalty_exact", _cata_penalty_sql(True), views=WIDE)
def cata_penalty_exact(spark, sf):
    return E.cata_penalty(survey_wide(spark, sf), "cata", TARGET, mode="exact").withColumn("p_value", F.round("p_value", 6))


def _jar_sql(inverted: bool) -> str:
    low, high = ("(4, 5)", "(1, 2)") if inverted else ("(1, 2)", "(4, 5)")
    return f"""
WITH l AS ({unpivot('(SELECT *, CAST(liking AS DOUBLE) AS y FROM survey_wide)', ['product', 'y'], JAR)}),
s AS (SELECT product, question, y, CASE WHEN score IN {low} THEN 'low' WHEN score = 3 THEN 'jar'
        WHEN score IN {high} THEN 'high' END AS side FROM l),
a AS (SELECT product, question, COUNT(*) AS n_rows,
  COUNT(CASE WHEN side = 'low' THEN 1 END) AS c_low, COUNT(CASE WHEN side = 'high' THEN 1 END) AS c_high,
  AVG(CASE WHEN side = 'jar' THEN y END) AS m_jar, AVG(CASE WHEN side = 'low' THEN y END) AS m_low,
  AVG(CASE WHEN side = 'high' THEN y END) AS m_high, STDDEV_SAMP(CASE WHEN side = 'jar' THEN y END) AS sd_jar,
  VAR_SAMP(CASE WHEN side = 'jar' THEN y END) AS v_jar,
  COUNT(CASE WHEN side = 'jar' THEN y END) AS n_jar,
  COUNT(CASE WHEN side IN ('low', 'high') THEN y END) AS n_non,
  AVG(CASE WHEN side IN ('low', 'high') THEN y END) AS m_non,
  VAR_SAMP(CASE WHEN side IN ('low', 'high') THEN y END) AS v_non
  FROM s GROUP BY product, question)
SELECT product, CASE question WHEN 'jar_sweet' THEN 'Sweetness' WHEN 'jar_thick' THEN 'Thickness' END AS attribute,
  m_jar AS mean_jar, m_low AS mean_too_low, c_low * 100.0 / n_rows AS pct_too_low,
  CASE WHEN c_low > 0 THEN m_jar - m_low END AS mean_drop_too_low,
  CASE WHEN sd_jar > 0 AND c_low > 0 THEN (m_jar - m_low) / sd_jar END AS std_mean_drop_too_low,
  m_high AS mean_too_high, c_high * 100.0 / n_rows AS pct_too_high,
  CASE WHEN c_high > 0 THEN m_jar - m_high END AS mean_drop_too_high,
  CASE WHEN sd_jar > 0 AND c_high > 0 THEN (m_jar - m_high) / sd_jar END AS std_mean_drop_too_high,
  m_jar - m_non AS penalty,
  CASE WHEN n_jar > 0 AND n_non > 0 AND n_jar + n_non > 2 THEN (m_jar - m_non)
    / sqrt(((n_jar - 1) * COALESCE(v_jar, 0) + (n_non - 1) * COALESCE(v_non, 0)) / (n_jar + n_non - 2)
           * (1.0 / n_jar + 1.0 / n_non)) END AS t_penalty,
  CASE WHEN n_jar > 0 AND n_non > 0 AND n_jar + n_non > 2 THEN CAST(n_jar + n_non - 2 AS DOUBLE) END AS df_penalty,
  c_low * 100.0 / n_rows >= 20 AS above_threshold_too_low, c_high * 100.0 / n_rows >= 20 AS above_threshold_too_high
FROM a"""


JAR_DROP = ["p_too_low", "p_too_high", "p_penalty", "significant_too_low", "significant_too_high"]


@query("jar_penalty", _jar_sql(True), views=WIDE)
def jar_penalty(spark, sf):
    return E.jar_penalty(survey_wide(spark, sf), JAR, TARGET, ABBREV).drop(*JAR_DROP)


@query("jar_penalty_std", _jar_sql(False), views=WIDE)
def jar_penalty_std(spark, sf):
    return E.jar_penalty(survey_wide(spark, sf), JAR, TARGET, ABBREV, inverted=False).drop(*JAR_DROP)


@query("jar_penalty_tests", views=WIDE)
def jar_penalty_tests(spark, sf):
    """The full penalty table including Mann-Whitney side p-values and the t-test p."""
    return E.jar_penalty(survey_wide(spark, sf), JAR, TARGET, ABBREV)


def _spearman_sql(cols) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    jf = "\nUNION ALL ".join(
        f"SELECT product, '{a}' AS q1, '{b}' AS q2, CAST({a} AS DOUBLE) AS v1, CAST({b} AS DOUBLE) AS v2 "
        f"FROM survey_wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)
    return f"""
WITH e AS ({jf}),
jf AS (SELECT product, q1, q2, v1, v2, COUNT(*) AS n FROM e GROUP BY ALL),
m1 AS (SELECT product, q1, q2, v1, SUM(n) AS t FROM jf GROUP BY ALL),
r1 AS (SELECT product, q1, q2, v1, SUM(t) OVER (PARTITION BY product, q1, q2 ORDER BY v1
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - t + (t + 1) / 2.0 AS r FROM m1),
m2 AS (SELECT product, q1, q2, v2, SUM(n) AS t FROM jf GROUP BY ALL),
r2 AS (SELECT product, q1, q2, v2, SUM(t) OVER (PARTITION BY product, q1, q2 ORDER BY v2
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - t + (t + 1) / 2.0 AS r FROM m2),
j AS (SELECT jf.product, jf.q1, jf.q2, jf.n, r1.r AS a, r2.r AS b FROM jf
  JOIN r1 ON r1.product = jf.product AND r1.q1 = jf.q1 AND r1.q2 = jf.q2 AND r1.v1 = jf.v1
  JOIN r2 ON r2.product = jf.product AND r2.q1 = jf.q1 AND r2.q2 = jf.q2 AND r2.v2 = jf.v2),
s AS (SELECT product, q1, q2, SUM(n) AS nn, SUM(n * a) AS s1, SUM(n * b) AS s2, SUM(n * a * a) AS s11,
        SUM(n * b * b) AS s22, SUM(n * a * b) AS s12 FROM j GROUP BY ALL),
off AS (SELECT product, q1, q2, CASE WHEN s11 - s1 * s1 / nn > 1e-12 AND s22 - s2 * s2 / nn > 1e-12 AND nn > 1
          THEN (s12 - s1 * s2 / nn) / sqrt((s11 - s1 * s1 / nn) * (s22 - s2 * s2 / nn)) END AS rho FROM s),
l AS ({unpivot('survey_wide', ['product'], cols)}),
d AS (SELECT product, question AS q1, question AS q2,
        CASE WHEN COUNT(*) > 1 AND MIN(score) < MAX(score) THEN 1.0 END AS rho
      FROM l WHERE score IS NOT NULL GROUP BY product, question)
SELECT product, q1, q2, rho FROM off
UNION ALL SELECT product, q2, q1, rho FROM off
UNION ALL SELECT product, q1, q2, rho FROM d"""


@query("spearman", _spearman_sql(SPEARMAN_COLS), views=WIDE)
def spearman(spark, sf):
    return E.spearman(survey_wide(spark, sf), SPEARMAN_COLS)
