"""The two derived survey views over the TPC-H-like test tables.

The same SQL text runs on Spark and on DuckDB, so every registered query and
its oracle start from byte-identical inputs.  ``survey_eav`` is the
entity-attribute-value response view (one row per respondent x product x
visit x attribute); ``survey_wide`` is the wide per-product response table
(one row per respondent x product).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .partitioning import balance

BASE_TABLES = ("lineitem", "orders", "part")

SURVEY_EAV_SQL = """
SELECT o.o_custkey AS customerid,
  concat('Product_', p.p_type) AS productname,
  concat('Visit ', CAST(2 * CAST(substr(o.o_orderpriority, 1, 1) AS INT) - 1 AS VARCHAR(9))) AS missiondesc,
  CASE l.l_linenumber
    WHEN 1 THEN 'Overall Opinion-Liking-Product'
    WHEN 2 THEN 'Pack-Experience-Easy to Store'
    WHEN 3 THEN 'Benefits-Agreement-Baby will accept'
    WHEN 4 THEN 'Benefits-Agreement-Child would accept'
    WHEN 5 THEN 'Sensory-Experience-Level of foam'
    WHEN 6 THEN 'Sensory-JAR-Sweetness'
    ELSE 'Product-3DigitCode-' END AS attribute,
  CASE WHEN l.l_linenumber = 7 THEN CAST(NULL AS DOUBLE)
    WHEN l.l_linenumber = 6 THEN CAST(1 + CAST(l.l_quantity AS BIGINT) % 5 AS DOUBLE)
    ELSE CAST(1 + CAST(l.l_quantity AS BIGINT) % 10 AS DOUBLE) END AS answerscore,
  CASE WHEN l.l_linenumber = 7 THEN CAST(100 + l.l_suppkey % 900 AS VARCHAR(9))
    WHEN l.l_linenumber = 1 THEN CAST(1 + CAST(l.l_quantity AS BIGINT) % 10 AS VARCHAR(9))
    ELSE NULL END AS answer,
  CAST(l.l_linenumber AS BIGINT) AS questionid,
  concat('Q', CAST(l.l_linenumber AS VARCHAR(9))) AS question,
  CASE WHEN l.l_linenumber = 7 THEN 'TEXT' WHEN l.l_linenumber = 6 THEN 'JAR5' ELSE 'TEN' END AS scaletype,
  l.l_orderkey AS responseid,
  CASE WHEN l.l_linenumber IN (3, 4) THEN 'Benefits' WHEN l.l_linenumber IN (5, 6) THEN 'Sensory' ELSE 'General' END AS questiongroup,
  CASE WHEN l.l_linenumber IN (3, 4) THEN 'Agreement' WHEN l.l_linenumber = 6 THEN 'JAR' ELSE 'Experience' END AS questionsubgroup,
  CASE WHEN l.l_linenumber <= 3 THEN 'S1' ELSE 'S2' END AS questionsubgroup2,
  CAST(EXTRACT(YEAR FROM o.o_orderdate) AS INT) AS year,
  concat('Country_', o.o_orderstatus) AS country,
  concat('Study_', p.p_brand) AS studyname,
  concat('Project_', l.l_returnflag) AS project_name,
  CASE WHEN l.l_linestatus = 'O' THEN 'Own' ELSE 'Competitor' END AS originalsurveytype,
  concat('Visit ', CAST(2 * CAST(substr(o.o_orderpriority, 1, 1) AS INT) - 1 AS VARCHAR(9))) AS daynumber
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

SURVEY_WIDE_SQL = """
WITH b AS (
  SELECT o.o_custkey AS cid, l.l_returnflag AS product, SUM(CAST(l.l_quantity AS BIGINT)) AS q,
    SUM(l.l_suppkey) AS s, SUM(l.l_partkey) AS p, SUM(l.l_linenumber) AS ln
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, l.l_returnflag),
t AS (
  SELECT cid, product, 1 + q % 10 AS t1, 1 + s % 10 AS t2, 1 + p % 10 AS t3, 1 + ln % 5 AS j1,
    1 + (q + s) % 5 AS j2, 1 + (p + ln) % 5 AS b1, q, s, p FROM b)
SELECT cid AS customer_id, product,
  concat(CASE WHEN cid % 2 = 0 THEN '1' ELSE '2' END, 'u', CAST(cid AS VARCHAR(12)), '@example.org') AS email,
  CASE WHEN q % 13 = 0 THEN NULL ELSE CAST(t1 AS DOUBLE) END AS ten_taste,
  CASE WHEN s % 11 = 0 THEN NULL ELSE CAST(t2 AS DOUBLE) END AS ten_aroma,
  CAST(t3 AS DOUBLE) AS ten_foam,
  CAST(b1 AS DOUBLE) AS t2b_store,
  CASE WHEN p % 17 = 0 THEN NULL ELSE CAST(j1 AS DOUBLE) END AS jar_sweet,
  CAST(j2 AS DOUBLE) AS jar_thick,
  CAST(greatest(1, least(10, floor((2 * t1 + t2 + 10 - abs(j1 - 3) * 2) / 4.0))) AS DOUBLE) AS liking,
  CASE WHEN q % 19 = 0 THEN NULL ELSE concat('Creamy', CASE WHEN t1 > 5 THEN ',Sweet' ELSE '' END,
    CASE WHEN t2 > 4 THEN ',Too Sweet' ELSE '' END, CASE WHEN j2 > 3 THEN ',Fresh' ELSE '' END) END AS cata,
  CASE WHEN t3 > 5 THEN 'Price:M,Taste:L' WHEN t3 > 3 THEN 'Taste:M,Pack:L' ELSE 'Pack:M,Price:L' END AS maxdiff
FROM t
"""

VIEW_SQL = {"survey_eav": SURVEY_EAV_SQL, "survey_wide": SURVEY_WIDE_SQL}

# Study configuration of the wide fixture (the JSON the reference reads).
STUDY = {
    "TEN": ["ten_taste", "ten_aroma", "ten_foam"],
    "T2B": ["t2b_store"],
    "JAR": ["jar_sweet", "jar_thick"],
    "T2B_JAR": ["t2b_store", "jar_sweet", "jar_thick"],
    "CATA": ["cata"],
    "MD": ["maxdiff"],
    "SKIP": ["customer_id", "product", "email", "cata", "maxdiff"],
    "OE": ["text"],
    "T2B_TEN": ["t2b_store", "ten_taste", "ten_aroma", "ten_foam"],
    "column_pairs_dict": {"sweet_by_thick": ["jar_sweet", "jar_thick"]},
    "drop_cols": [],
}
SCORED = ["ten_taste", "ten_aroma", "ten_foam", "t2b_store", "jar_sweet", "jar_thick", "liking"]
TARGET = "liking"
PREDICTORS = ["ten_taste", "ten_aroma", "ten_foam", "t2b_store", "jar_sweet", "jar_thick"]


FACT_KEYS = {"lineitem": "l_orderkey"}  # the streamed side; dimension sides are broadcast


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    # fact table: spread a scan with too few input splits over the cores (no-op at scale)
    return balance(df, FACT_KEYS[name]) if name in FACT_KEYS else df


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def survey_eav(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir)
    return spark.sql(SURVEY_EAV_SQL)


def survey_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ("lineitem", "orders"))
    return spark.sql(SURVEY_WIDE_SQL)


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the derived views as CTEs (for the DuckDB oracle)."""
    ctes = [f"{v} AS ({VIEW_SQL[v]})" for v in views]
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
