"""Registered driver-analysis queries.

Two-predictor versions have closed forms and so a DuckDB oracle; the full
predictor set is checked by invariants in the tests (weights sum to 100,
planted driver ranking).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import PREDICTORS, SCORED, TARGET, survey_wide
from ..operators import drivers as D
from .registry import query

WIDE = ("survey_wide",)
TWO = ["ten_taste", "ten_aroma"]
GRAM_COLS = SCORED


def _gram_sql() -> str:
    cols = GRAM_COLS
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j >= i:
                parts.append(f"SELECT product, n, '{a}' AS var_i, '{b}' AS var_j, ss_{i}_{j} AS s FROM g")
    sums = ", ".join(f"SUM({a} * {b}) AS ss_{i}_{j}" for i, a in enumerate(cols)
                     for j, b in enumerate(cols) if j >= i)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"""
WITH g AS (SELECT product, COUNT(*) AS n, {sums} FROM survey_wide WHERE {nn} GROUP BY product)
""" + "\nUNION ALL ".join(parts)


@query("gram", _gram_sql(), views=WIDE)
def gram(spark, sf):
    return D.gram_long(D.gram(survey_wide(spark, sf), GRAM_COLS), GRAM_COLS)


CORR2 = """c AS (SELECT product, COUNT(*) AS n, corr(ten_taste, ten_aroma) AS r12, corr(ten_taste, liking) AS r1y,
        corr(ten_aroma, liking) AS r2y FROM survey_wide
      WHERE ten_taste IS NOT NULL AND ten_aroma IS NOT NULL AND liking IS NOT NULL GROUP BY product),
b AS (SELECT *, (r1y - r12 * r2y) / (1 - r12 * r12) AS b1, (r2y - r12 * r1y) / (1 - r12 * r12) AS b2 FROM c)"""


@query("driver_lr", f"""
WITH {CORR2}
SELECT product, 'ten_taste' AS variable, n AS n_rows, 100 * abs(b1) / (abs(b1) + abs(b2)) AS linear_weight,
  50.0 AS johnson_weight FROM b
UNION ALL
SELECT product, 'ten_aroma', n, 100 * abs(b2) / (abs(b1) + abs(b2)), 50.0 FROM b""", views=WIDE)
def driver_lr(spark, sf):
    return D.linear_drivers(survey_wide(spark, sf), TWO, TARGET).drop("lasso_weight")


@query("driver_johnson", views=WIDE)
def driver_johnson(spark, sf):
    return D.linear_drivers(survey_wide(spark, sf), PREDICTORS, TARGET).select(
        "product", "variable", "n_rows", "johnson_weight")


@query("driver_lasso", views=WIDE)
def driver_lasso(spark, sf):
    return D.linear_drivers(survey_wide(spark, sf), PREDICTORS, TARGET).select(
        "product", "variable", "n_rows", "lasso_weight")


@query("ols_signed", f"""
WITH {CORR2}
SELECT product, 'ten_taste' AS variable, n AS n_rows, b1 AS ols_coefficient,
  (r1y * r1y + r2y * r2y - 2 * r1y * r2y * r12) / (1 - r12 * r12) AS r2,
  1 - (1 - (r1y * r1y + r2y * r2y - 2 * r1y * r2y * r12) / (1 - r12 * r12)) * (n - 1) / (n - 3) AS adj_r2 FROM b
UNION ALL
SELECT product, 'ten_aroma', n, b2, (r1y * r1y + r2y * r2y - 2 * r1y * r2y * r12) / (1 - r12 * r12),
  1 - (1 - (r1y * r1y + r2y * r2y - 2 * r1y * r2y * r12) / (1 - r12 * r12)) * (n - 1) / (n - 3) FROM b""",
       views=WIDE)
def ols_signed(spark, sf):
    return D.ols_signed(survey_wide(spark, sf), TWO, TARGET)


@query("ols_signed_full", views=WIDE)
def ols_signed_full(spark, sf):
    return D.ols_signed(survey_wide(spark, sf), PREDICTORS, TARGET)


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in [*PREDICTORS, TARGET])


@query("ols_normal_equations", "\nUNION ALL ".join(
    f"SELECT product, '{c}' AS variable, COUNT(*) AS n_rows, 0.0 AS residual FROM survey_wide WHERE {COMPLETE} GROUP BY product"
    for c in PREDICTORS), views=WIDE)
def ols_normal_equations(spark, sf):
    """Covariance of each predictor with what the fit over all predictors leaves over: zero to six places."""
    wide = survey_wide(spark, sf).select("product", *PREDICTORS, TARGET).dropna(subset=[*PREDICTORS, TARGET])
    fit = D.ols_signed(wide, PREDICTORS, TARGET, standardize=False).groupBy("product").agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "ols_coefficient"))).alias("b"))
    fitted = sum((F.col(c) * F.col("b")[c] for c in PREDICTORS), F.lit(0.0))
    left = wide.join(F.broadcast(fit), "product").withColumn("left", F.col(TARGET) - fitted)  # a row per product
    each = left.groupBy("product").agg(F.count(F.lit(1)).alias("n_rows"), *[F.covar_pop(c, "left").alias(c) for c in PREDICTORS])
    long = each.unpivot(["product", "n_rows"], PREDICTORS, "variable", "residual")
    return long.select("product", "variable", "n_rows", (F.round("residual", 6) + 0.0).alias("residual"))


@query("condition_index", """
WITH c AS (SELECT product, abs(corr(ten_taste, ten_aroma)) AS r FROM survey_wide
           WHERE ten_taste IS NOT NULL AND ten_aroma IS NOT NULL GROUP BY product),
e AS (SELECT product, 1 AS component, 1 + r AS lam, r FROM c UNION ALL SELECT product, 2, 1 - r, r FROM c),
v AS (SELECT unnest(['ten_taste', 'ten_aroma']) AS variable)
SELECT e.product, e.component, e.lam AS eigenvalue, sqrt((1 + e.r) / e.lam) AS condition_index, v.variable,
  (1 / e.lam) / (1 / (1 + e.r) + 1 / (1 - e.r)) AS vdp
FROM e CROSS JOIN v""", views=WIDE)
def condition_index(spark, sf):
    return D.condition_index(survey_wide(spark, sf), TWO, 0.3)


@query("condition_index_full", views=WIDE)
def condition_index_full(spark, sf):
    return D.condition_index(survey_wide(spark, sf), PREDICTORS, 0.3)


@query("driver_rf", views=WIDE)
def driver_rf(spark, sf):
    return D.random_forest_importance(survey_wide(spark, sf), PREDICTORS, TARGET, num_trees=100)


@query("gbt_importance", views=WIDE)
def gbt_importance(spark, sf):
    return D.gbt_permutation_importance(survey_wide(spark, sf), PREDICTORS, TARGET, threshold=0.99)


@query("driver_merge", views=WIDE)
def driver_merge(spark, sf):
    return D.driver_merge(survey_wide(spark, sf), PREDICTORS, TARGET)
