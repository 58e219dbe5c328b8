"""Registered cleaning and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SCORED, TARGET, read_table, survey_eav, survey_wide
from ..functions import scalar as S
from ..operators import clean as C
from ..operators import reshape as R
from .registry import query

WS = S.PY_WHITESPACE
WIDE = ("survey_wide",)


@query("clean_whitespace", f"""
SELECT doc_id, regexp_replace(text, '\\A{WS}+|{WS}+\\z', '', 'g') AS text, lang, source, n_chars
FROM documents""", views=())
def clean_whitespace(spark, sf):
    return C.whitespace_remover(read_table(spark, sf, "documents"))


@query("to_float", """
SELECT customer_id, product,
  TRY_CAST(regexp_replace(email, '[^0-9.]', '', 'g') AS DOUBLE) AS email,
  TRY_CAST(regexp_replace(cata, '[^0-9.]', '', 'g') AS DOUBLE) AS cata,
  TRY_CAST(regexp_replace(CAST(ten_taste AS VARCHAR), '[^0-9.]', '', 'g') AS DOUBLE) AS ten_taste
FROM survey_wide""", views=WIDE)
def to_float(spark, sf):
    w = survey_wide(spark, sf).select("customer_id", "product", "email", "cata", "ten_taste")
    return C.convert_columns_to_float(w, ["email", "cata", "ten_taste"])


@query("clean_headers", """
SELECT customer_id, product, ten_taste AS taste, ten_aroma AS aroma, ten_foam AS foam,
  jar_sweet AS sweet, jar_thick AS thick FROM survey_wide""", views=WIDE)
def clean_headers(spark, sf):
    w = survey_wide(spark, sf).select("customer_id", "product", "ten_taste", "ten_aroma", "ten_foam",
                                      "jar_sweet", "jar_thick")
    return C.clean_column_headers(w, ["ten_", "jar_"])


@query("replace_if_contains", """
SELECT customer_id, product,
  CASE WHEN regexp_matches(cata, 'Too Sw[a-z]+') THEN 'sweetness complaint' ELSE cata END AS cata
FROM survey_wide""", views=WIDE)
def replace_if_contains(spark, sf):
    w = survey_wide(spark, sf).select("customer_id", "product", "cata")
    return C.replace_if_contains(w, "cata", "Too Sw[a-z]+", "sweetness complaint")


FIND_REPLACE = [(["Price:M,Taste:L", "Taste:M,Pack:L"], "mixed"), (["mixed"], "MIXED")]


@query("find_replace", """
SELECT customer_id, product,
  CASE WHEN maxdiff IN ('Price:M,Taste:L', 'Taste:M,Pack:L') THEN 'MIXED' ELSE maxdiff END AS maxdiff
FROM survey_wide""", views=WIDE)
def find_replace(spark, sf):
    w = survey_wide(spark, sf).select("customer_id", "product", "maxdiff")
    return C.find_and_replace(w, ["maxdiff"], FIND_REPLACE)


@query("fill_zero", """
SELECT customer_id, product, COALESCE(ten_taste, 0) AS ten_taste, COALESCE(ten_aroma, 0) AS ten_aroma,
  COALESCE(jar_sweet, 0) AS jar_sweet FROM survey_wide""", views=WIDE)
def fill_zero(spark, sf):
    w = survey_wide(spark, sf).select("customer_id", "product", "ten_taste", "ten_aroma", "jar_sweet")
    return C.fill_zero(w, ["ten_taste", "ten_aroma", "jar_sweet"])


@query("cast_columns", """
SELECT customer_id, product, CAST(ten_taste AS INTEGER) AS ten_taste, CAST(ten_foam AS INTEGER) AS ten_foam
FROM survey_wide""", views=WIDE)
def cast_columns(spark, sf):
    w = survey_wide(spark, sf).select("customer_id", "product", "ten_taste", "ten_foam")
    return C.cast_columns(w, ["ten_taste", "ten_foam"], "int")


@query("rename_columns", """
SELECT customer_id, product, ten_taste AS "Taste", jar_sweet AS "Sweetness JAR" FROM survey_wide""",
       views=WIDE)
def rename_columns(spark, sf):
    w = survey_wide(spark, sf).select("customer_id", "product", "ten_taste", "jar_sweet")
    return C.rename_columns(w, {"ten_taste": "Taste", "jar_sweet": "Sweetness JAR", "nope": "x"})[0]


@query("split_by_list", """
SELECT 'list1' AS part, a.customer_id, a.email, a.ten_taste FROM survey_wide a
WHERE a.product = 'A' AND a.email IN (SELECT email FROM survey_wide WHERE product = 'N')
UNION ALL
SELECT 'list2' AS part, a.customer_id, a.email, a.ten_taste FROM survey_wide a
WHERE a.product = 'A' AND a.email IN (SELECT email FROM survey_wide WHERE product = 'R' AND liking >= 5)
""", views=WIDE)
def split_by_list(spark, sf):
    w = survey_wide(spark, sf)
    a = w.where(F.col("product") == "A").select("customer_id", "email", "ten_taste")
    l1 = w.where(F.col("product") == "N").select("email")
    l2 = w.where((F.col("product") == "R") & (F.col("liking") >= 5)).select("email")
    d1, d2 = C.split_by_list(a, l1, l2)
    return (d1.select(F.lit("list1").alias("part"), "*")
            .unionByName(d2.select(F.lit("list2").alias("part"), "*")))


@query("split_by_prefix", """
SELECT 'rotation1' AS part, customer_id, product, lower(email) AS email FROM survey_wide
WHERE starts_with(lower(email), '1')
UNION ALL
SELECT 'rotation2' AS part, customer_id, product, lower(email) AS email FROM survey_wide
WHERE starts_with(lower(email), '2')""", views=WIDE)
def split_by_prefix(spark, sf):
    w = survey_wide(spark, sf).select("customer_id", "product", "email")
    d1, d2 = C.split_by_prefix(w, "1", "2", lower=True)
    return (d1.select(F.lit("rotation1").alias("part"), "*")
            .unionByName(d2.select(F.lit("rotation2").alias("part"), "*")))


@query("sort_respondents", "SELECT customer_id, product, liking FROM survey_wide ORDER BY customer_id",
       views=WIDE)
def sort_respondents(spark, sf):
    return C.sort_respondents(survey_wide(spark, sf).select("customer_id", "product", "liking"))


@query("missingness", """
SELECT product, question, null_share, null_share <= 0.05 AS kept FROM (
  SELECT product, 'ten_taste' AS question, AVG(CASE WHEN ten_taste IS NULL THEN 1.0 ELSE 0.0 END) AS null_share
  FROM survey_wide GROUP BY product
  UNION ALL SELECT product, 'ten_aroma', AVG(CASE WHEN ten_aroma IS NULL THEN 1.0 ELSE 0.0 END)
  FROM survey_wide GROUP BY product
  UNION ALL SELECT product, 'jar_sweet', AVG(CASE WHEN jar_sweet IS NULL THEN 1.0 ELSE 0.0 END)
  FROM survey_wide GROUP BY product
  UNION ALL SELECT product, 'cata', AVG(CASE WHEN cata IS NULL THEN 1.0 ELSE 0.0 END)
  FROM survey_wide GROUP BY product)""", views=WIDE)
def missingness(spark, sf):
    return C.missingness(survey_wide(spark, sf), ["ten_taste", "ten_aroma", "jar_sweet", "cata"], 0.05,
                         group=["product"])


@query("pair_alignment_check", """
WITH per AS (SELECT customer_id, product, COUNT(*) AS n FROM survey_wide GROUP BY customer_id, product),
g AS (SELECT COUNT(DISTINCT product) AS k FROM survey_wide)
SELECT customer_id, COUNT(*) AS n_groups_present, MAX(n) AS max_count FROM per
GROUP BY customer_id HAVING COUNT(*) <> (SELECT k FROM g) OR MAX(n) <> 1""", views=WIDE)
def pair_alignment_check(spark, sf):
    return C.pair_alignment_check(survey_wide(spark, sf))


@query("dichotomize", """
SELECT customer_id, product,
  CASE WHEN t2b_store IS NULL THEN NULL WHEN t2b_store IN (4, 5) THEN 1 ELSE 0 END AS t2b_store,
  CASE WHEN jar_sweet IS NULL THEN NULL WHEN jar_sweet IN (4, 5) THEN 1 ELSE 0 END AS jar_sweet,
  CASE WHEN ten_taste IS NULL THEN NULL WHEN ten_taste IN (4, 5) THEN 1 ELSE 0 END AS ten_taste
FROM survey_wide""", views=WIDE)
def dichotomize(spark, sf):
    return R.dichotomize(survey_wide(spark, sf), ["t2b_store", "jar_sweet", "ten_taste", "absent"],
                         [4, 5], keep=["customer_id", "product"])


@query("long_form", """
SELECT customer_id, product, question, score FROM (
  SELECT customer_id, product, 'ten_taste' AS question, ten_taste AS score FROM survey_wide
  UNION ALL SELECT customer_id, product, 'ten_aroma', ten_aroma FROM survey_wide
  UNION ALL SELECT customer_id, product, 'jar_sweet', jar_sweet FROM survey_wide
  UNION ALL SELECT customer_id, product, 'liking', liking FROM survey_wide)""", views=WIDE)
def long_form(spark, sf):
    return R.long_form(survey_wide(spark, sf), ["customer_id", "product"],
                       ["ten_taste", "ten_aroma", "jar_sweet", "liking"])


@query("invert_10pt", """
SELECT customer_id, product, 11 - ten_foam AS ten_foam, 11 - ten_taste AS ten_taste FROM survey_wide""",
       views=WIDE)
def invert_10pt(spark, sf):
    w = survey_wide(spark, sf)
    return w.select("customer_id", "product", S.invert_ten("ten_foam").alias("ten_foam"),
                    S.invert_ten("ten_taste").alias("ten_taste"))


@query("ten_to_five", """
SELECT customer_id, product,
  CASE WHEN ten_taste IN (1,2,3,4,5,6,7,8,9,10) THEN CAST(ceil(ten_taste / 2) AS DOUBLE) ELSE ten_taste END
    AS ten_taste,
  CASE WHEN ten_aroma IN (1,2,3,4,5,6,7,8,9,10) THEN CAST(ceil(ten_aroma / 2) AS DOUBLE) ELSE ten_aroma END
    AS ten_aroma,
  CASE WHEN liking IN (1,2,3,4,5,6,7,8,9,10) THEN CAST(ceil(liking / 2) AS DOUBLE) ELSE liking END AS liking
FROM survey_wide""", views=WIDE)
def ten_to_five(spark, sf):
    w = survey_wide(spark, sf)
    return w.select("customer_id", "product", *[S.ten_to_five(c).alias(c)
                                               for c in ("ten_taste", "ten_aroma", "liking")])


@query("safe_labels", """
SELECT doc_id,
  regexp_replace(text, '[<>:"/\\\\|?*]', '_', 'g') AS filename,
  substr(regexp_replace(text, '[\\\\/*?\\[\\]:]', '_', 'g'), 1, 31) AS sheet,
  CASE WHEN regexp_matches(text, '(.{31})\\?') THEN regexp_extract(text, '(.{31})\\?', 1)
       ELSE substr(text, greatest(length(text) - 31, 0) + 1, greatest(length(text) - greatest(length(text) - 31, 0) - 1, 0))
  END AS cata_sheet
FROM documents""", views=())
def safe_labels(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", S.sanitize_filename("text").alias("filename"),
                    S.clean_sheet_name("text").alias("sheet"), S.cata_sheet_name("text").alias("cata_sheet"))


LEAKY = ["jar_sweet"]


@query("predictor_set", "\nUNION ALL ".join(
    f"SELECT {i + 1} AS place, '{c}' AS variable, product, COUNT({c}) AS answered FROM survey_wide GROUP BY product"
    for i, c in enumerate(["ten_taste", "ten_aroma", "ten_foam", "t2b_store", "jar_thick"])), views=WIDE)
def predictor_set(spark, sf):
    """Predictors without target, excluded and repeated columns, in order, and how often each is answered per product."""
    w = survey_wide(spark, sf)
    kept = C.predictor_set([*SCORED, "ten_taste"], TARGET, LEAKY)
    answered = w.groupBy("product").agg(*[F.count(c).alias(c) for c in kept]).unpivot(["product"], kept, "variable", "answered")
    place = F.array_position(F.array(*[F.lit(c) for c in kept]), F.col("variable")).cast("int")
    return answered.select(place.alias("place"), "variable", "product", "answered")
