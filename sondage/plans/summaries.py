"""Registered frequency-summary queries over the wide fixture."""

from __future__ import annotations

from ..fixtures import STUDY, survey_wide
from ..operators import summarise as A
from .registry import query
from .sqlgen import unpivot, values_list

WIDE = ("survey_wide",)
TEN, T2B, JAR, CATA, MD = STUDY["TEN"], STUDY["T2B"], STUDY["JAR"], STUDY["CATA"], STUDY["MD"]
LIKERT_COLS = TEN + T2B
PRODUCTS = ["A", "N", "R"]


def _grid_sql(cols) -> str:
    return f"""
l AS ({unpivot('survey_wide', ['product'], cols)}),
cnt AS (SELECT product, question, score AS value, COUNT(*) AS n FROM l WHERE score IS NOT NULL
        GROUP BY product, question, score),
lv AS (SELECT DISTINCT product, value FROM cnt),
qs AS (SELECT unnest([{values_list(cols)}]) AS question),
g AS (SELECT lv.product, qs.question, lv.value, COALESCE(cnt.n, 0) AS n
      FROM lv CROSS JOIN qs LEFT JOIN cnt
        ON cnt.product = lv.product AND cnt.question = qs.question AND cnt.value = lv.value)"""


@query("likert_counts", f"""
WITH {_grid_sql(LIKERT_COLS)},
t AS (SELECT product, question, SUM(n) AS total FROM g GROUP BY product, question)
SELECT g.product, g.question, CAST(g.value AS VARCHAR) AS level, CAST(g.n AS BIGINT) AS count,
  round_even(CAST(g.n AS DOUBLE) * 100 / t.total, 0) AS percentage
FROM g JOIN t ON g.product = t.product AND g.question = t.question
UNION ALL
SELECT product, question, 'Total', CAST(total AS BIGINT), CASE WHEN total > 0 THEN 100.0 END FROM t""",
       views=WIDE)
def likert_counts(spark, sf):
    return A.likert_counts(survey_wide(spark, sf), LIKERT_COLS)


def _box_sql() -> str:
    boxes = ",\n".join(
        f"SUM(CASE WHEN score IN ({', '.join(str(x) for x in lv)}) THEN 1.0 ELSE 0.0 END) * 100 / "
        f"NULLIF(COUNT(score), 0) AS \"{name}\"" for name, lv in A.BOX_METRICS)
    metric_union = "\nUNION ALL ".join(
        f"SELECT product, question, '{name}' AS metric, \"{name}\" AS value FROM per"
        for name, _ in A.BOX_METRICS)
    return f"""
WITH l AS ({unpivot('survey_wide', ['product'], T2B + TEN)}),
per AS (SELECT product, question, {boxes}, AVG(score) AS mean FROM l GROUP BY product, question)
{metric_union}
UNION ALL SELECT product, question, 'Mean', mean FROM per WHERE question IN ({values_list(TEN)})"""


BOX_SQL = _box_sql()


@query("box_scores", BOX_SQL, views=WIDE)
def box_scores(spark, sf):
    return A.box_scores(survey_wide(spark, sf), T2B, TEN)


@query("one_pager", f"""
WITH b AS ({BOX_SQL})
SELECT question AS comparison,
  MAX(CASE WHEN product = 'A' THEN value END) AS "A",
  MAX(CASE WHEN product = 'N' THEN value END) AS "N",
  MAX(CASE WHEN product = 'R' THEN value END) AS "R"
FROM b WHERE metric = '% T2B' GROUP BY question""", views=WIDE)
def one_pager(spark, sf):
    return A.one_pager(A.box_scores(survey_wide(spark, sf), T2B, TEN), "% T2B", PRODUCTS)


BOX_COLS = list(dict.fromkeys(T2B + TEN))


def _box_appended_sql() -> str:
    piv = ",\n".join(f"MAX(CASE WHEN question = '{c}' THEN v END) AS {c}" for c in BOX_COLS)
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in BOX_COLS)
    return f"""
WITH {_grid_sql(BOX_COLS)},
t AS (SELECT product, question, SUM(n) AS total FROM g GROUP BY product, question),
s AS (
  SELECT product, question, 'Summary_' || CAST(value AS VARCHAR) AS row_label, CAST(n AS DOUBLE) AS v FROM g
  UNION ALL SELECT product, question, 'Summary_Total', CAST(total AS DOUBLE) FROM t
  UNION ALL SELECT g.product, g.question, 'Percentage_' || CAST(g.value AS VARCHAR),
    CAST(g.n AS DOUBLE) * 100 / NULLIF(t.total, 0) FROM g JOIN t ON g.product = t.product AND g.question = t.question
  UNION ALL SELECT product, question, 'Percentage_Total', CASE WHEN total > 0 THEN 100.0 END FROM t
  UNION ALL SELECT product, question, metric, value FROM ({BOX_SQL}) b)
SELECT row_label, product, {piv} FROM s GROUP BY row_label, product
UNION ALL
SELECT CAST(customer_id AS VARCHAR) AS row_label, product, {cols} FROM survey_wide"""


@query("box_appended", _box_appended_sql(), views=WIDE)
def box_appended(spark, sf):
    return A.box_appended(survey_wide(spark, sf), T2B, TEN, ids=["customer_id"])


@query("crosstab", """
SELECT product, 'sweet_by_thick' AS name, jar_sweet AS value1, jar_thick AS value2, COUNT(*) AS n
FROM survey_wide WHERE jar_sweet IS NOT NULL AND jar_thick IS NOT NULL
GROUP BY product, jar_sweet, jar_thick""", views=WIDE)
def crosstab(spark, sf):
    return A.crosstab(survey_wide(spark, sf), STUDY["column_pairs_dict"])


VS_COLS = ["ten_taste", "jar_sweet", "cata"]


@query("value_summary", f"""
WITH l AS ({unpivot('survey_wide', ['product'], VS_COLS, vname='value', cast='VARCHAR')}),
c AS (SELECT product, question, value, COUNT(*) AS count FROM l GROUP BY product, question, value)
SELECT product, question, value, count, CAST(count AS DOUBLE) * 100 / SUM(count) OVER (PARTITION BY product, question) AS pct
FROM c""", views=WIDE)
def value_summary(spark, sf):
    return A.value_summary(survey_wide(spark, sf), VS_COLS)


@query("pooled_summary", f"""
WITH l AS ({unpivot('survey_wide', [], VS_COLS, vname='value', cast='VARCHAR')}),
c AS (SELECT question, value, COUNT(*) AS count FROM l GROUP BY question, value)
SELECT question, value, count, CAST(count AS DOUBLE) / SUM(count) OVER (PARTITION BY question) AS pct FROM c
UNION ALL SELECT question, 'Total', SUM(count), 1.0 FROM c GROUP BY question""", views=WIDE)
def pooled_summary(spark, sf):
    return A.pooled_summary(survey_wide(spark, sf), VS_COLS)


@query("jar_5pt", f"""
WITH {_grid_sql(JAR)}
SELECT product, question, value, CAST(n AS DOUBLE) * 100 / NULLIF(SUM(n) OVER (PARTITION BY product, question), 0) AS pct
FROM g""", views=WIDE)
def jar_5pt(spark, sf):
    return A.jar_5pt(survey_wide(spark, sf), JAR)


ABBREV = {"jar_sweet": "Sweetness", "jar_thick": "Thickness"}


@query("jar_3pt", f"""
WITH l AS ({unpivot('survey_wide', ['product'], JAR)}),
per AS (SELECT product, question,
  SUM(CASE WHEN score IN (1, 2) THEN 1.0 ELSE 0.0 END) * 100 / COUNT(*) AS "Too Little",
  SUM(CASE WHEN score IN (3) THEN 1.0 ELSE 0.0 END) * 100 / COUNT(*) AS "JAR",
  SUM(CASE WHEN score IN (4, 5) THEN 1.0 ELSE 0.0 END) * 100 / COUNT(*) AS "Too Much"
  FROM l GROUP BY product, question),
r AS (SELECT product, question, 'Too Little' AS category, "Too Little" AS pct FROM per
  UNION ALL SELECT product, question, 'JAR', "JAR" FROM per
  UNION ALL SELECT product, question, 'Too Much', "Too Much" FROM per)
SELECT product, CASE question WHEN 'jar_sweet' THEN 'Sweetness' WHEN 'jar_thick' THEN 'Thickness'
  ELSE question END AS attribute, category, pct FROM r""", views=WIDE)
def jar_3pt(spark, sf):
    return A.jar_3pt(survey_wide(spark, sf), JAR, ABBREV)


@query("cata_counts", """
WITH x AS (SELECT product, cata FROM survey_wide WHERE cata IS NOT NULL),
t AS (SELECT product, unnest(string_split(cata, ',')) AS attribute FROM x),
c AS (SELECT product, attribute, COUNT(*) AS count FROM t GROUP BY product, attribute),
b AS (SELECT product, COUNT(*) AS base FROM x GROUP BY product)
SELECT c.product, 'cata' AS question, 'cat' AS sheet, c.attribute, c.count,
  CAST(c.count AS DOUBLE) * 100 / b.base AS percentage
FROM c JOIN b ON c.product = b.product""", views=WIDE)
def cata_counts(spark, sf):
    return A.cata_counts(survey_wide(spark, sf), CATA)


@query("maxdiff", """
WITH t AS (SELECT unnest(string_split(maxdiff, ',')) AS tok FROM survey_wide WHERE maxdiff IS NOT NULL),
p AS (SELECT trim(regexp_extract(tok, '^(.*):([^:]*)$', 1)) AS attribute,
             trim(regexp_extract(tok, '^(.*):([^:]*)$', 2)) AS choice
      FROM t WHERE regexp_matches(tok, '^(.*):([^:]*)$')),
a AS (SELECT attribute, CAST(SUM(CASE WHEN choice = 'M' THEN 1 ELSE 0 END) AS BIGINT) AS most,
             CAST(SUM(CASE WHEN choice = 'L' THEN 1 ELSE 0 END) AS BIGINT) AS least
      FROM p GROUP BY attribute)
SELECT attribute, most, least, most - least AS net_score FROM a WHERE most > 0 OR least > 0
ORDER BY net_score DESC, attribute""", views=WIDE)
def maxdiff(spark, sf):
    return A.maxdiff(survey_wide(spark, sf), MD)


@query("maxdiff_quadrant", """
WITH t AS (SELECT unnest(string_split(maxdiff, ',')) AS tok FROM survey_wide WHERE maxdiff IS NOT NULL),
p AS (SELECT trim(regexp_extract(tok, '^(.*):([^:]*)$', 1)) AS attribute,
             trim(regexp_extract(tok, '^(.*):([^:]*)$', 2)) AS choice
      FROM t WHERE regexp_matches(tok, '^(.*):([^:]*)$')),
a AS (SELECT attribute, CAST(SUM(CASE WHEN choice = 'M' THEN 1 ELSE 0 END) AS BIGINT) AS most,
             CAST(SUM(CASE WHEN choice = 'L' THEN 1 ELSE 0 END) AS BIGINT) AS least
      FROM p GROUP BY attribute),
m AS (SELECT attribute, most, least, most - least AS net_score FROM a WHERE most > 0 OR least > 0),
s AS (SELECT MAX(most) / 2.0 AS hm, MAX(least) / 2.0 AS hl FROM m)
SELECT attribute, most, least, net_score, CAST(hm AS DOUBLE) AS most_split, CAST(hl AS DOUBLE) AS least_split,
  CASE WHEN most >= hm AND least < hl THEN 'High M / Low L'
       WHEN most >= hm AND least >= hl THEN 'High M / High L'
       WHEN most < hm AND least >= hl THEN 'Low M / High L' ELSE 'Low M / Low L' END AS quadrant
FROM m, s""", views=WIDE)
def maxdiff_quadrant(spark, sf):
    return A.maxdiff_quadrant(A.maxdiff(survey_wide(spark, sf), MD))


@query("maxdiff_malformed", """
WITH t AS (SELECT product, unnest(string_split(maxdiff, ',')) AS tok FROM survey_wide WHERE maxdiff IS NOT NULL)
SELECT product, 'maxdiff' AS question, COUNT(*) AS tokens, COUNT(CASE WHEN NOT contains(tok, ':') THEN 1 END) AS malformed
FROM t GROUP BY product""", views=WIDE)
def maxdiff_malformed(spark, sf):
    return A.maxdiff_malformed(survey_wide(spark, sf), MD, ["product"])
