"""Registered source / sink queries.  Each writes data derived from the given
tables to the shared scratch folder, then reads it back through the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import survey_eav, survey_wide
from ..operators import clean as C
from ..operators import summarise as A
from ..session import scratch_path
from ..sources import files as SF
from ..sources import sinks as SK
from ..sources.store import TableStore
from ..sources.versions import VersionedStore
from .registry import query

WIDE = ("survey_wide",)

# Fixed values of the fixture's Likert map ('5' is listed twice: first level wins).
FIXTURE_LIKERT = {
    1: ["1", "Strongly disagree"], 2: ["2", "Disagree"], 3: ["3", "Neither"], 4: ["4", "Agree"],
    5: ["5", "Strongly agree"], 6: ["6"], 7: ["7", "5"], 8: ["8"], 9: ["9"], 10: ["10"],
}


def likert_table(spark):
    return spark.createDataFrame([(lvl, lab) for lvl, labs in FIXTURE_LIKERT.items() for lab in labs],
                                 "level int, label string")


@query("likert_map", """
WITH lk AS (SELECT label, CAST(MIN(level) AS DOUBLE) AS level FROM (VALUES
  (1, '1'), (1, 'Strongly disagree'), (2, '2'), (2, 'Disagree'), (3, '3'), (3, 'Neither'), (4, '4'), (4, 'Agree'),
  (5, '5'), (5, 'Strongly agree'), (6, '6'), (7, '7'), (7, '5'), (8, '8'), (9, '9'), (10, '10')) t(level, label)
  GROUP BY label)
SELECT e.customerid, e.productname, e.missiondesc, e.attribute, e.answer, lk.level AS answer_level
FROM survey_eav e LEFT JOIN lk ON trim(e.answer) = lk.label""")
def likert_map(spark, sf):
    e = survey_eav(spark, sf).select("customerid", "productname", "missiondesc", "attribute", "answer")
    return C.likert_map(e, "answer", likert_table(spark), "answer_level")


MESSY = {"customer_id": " customer_id ", "product": "product ", "email": "", "ten_taste": " Taste (10pt)",
         "jar_sweet": "jar_sweet", "maxdiff": "maxdiff"}


@query("csv_clean", """
SELECT CAST(customer_id AS VARCHAR) AS customer_id, product, CAST(ten_taste AS VARCHAR) AS taste,
  CAST(jar_sweet AS VARCHAR) AS jar_sweet FROM survey_wide""", views=WIDE)
def csv_clean(spark, sf):
    src = scratch_path(spark, "raw-export")
    w = survey_wide(spark, sf).select(*[F.col(k).alias(v) for k, v in MESSY.items()])
    w.write.option("header", True).csv(src)
    return SF.csv_clean(spark, src, {"Taste (10pt)": "taste"}, ["maxdiff"])


@query("select_all_columns", """
SELECT attribute AS column_name FROM (SELECT DISTINCT questionid, question, scaletype, attribute FROM survey_eav)
WHERE scaletype = 'TEN'""")
def select_all_columns(spark, sf):
    path = scratch_path(spark, "question-map")
    e = survey_eav(spark, sf)
    qmap = e.select("questionid", "question", F.when(F.col("scaletype") == "TEN", "ALL").otherwise("SOME")
                    .alias("flag"), "attribute").distinct()
    qmap.write.option("header", True).csv(path)
    return SF.select_all_columns(spark, path)


HEADERS = {"A": {"customer_id": "Customer ID", "ten_taste": "Overall taste", "liking": "Liking"},
           "N": {"customer_id": "CustomerID", "ten_taste": "Taste overall", "liking": "Overall liking"},
           "R": {"customer_id": "Customer ID", "ten_taste": "Overall taste"}}
MAPPING = {"Customer ID": "customer_id", "CustomerID": "customer_id", "Overall taste": "taste",
           "Taste overall": "taste", "Liking": "liking", "Overall liking": "liking"}


@query("combine_files", """
SELECT CAST(customer_id AS VARCHAR) AS customer_id, CAST(ten_taste AS VARCHAR) AS taste,
  CASE WHEN product IN ('A', 'N') THEN CAST(liking AS VARCHAR) END AS liking
FROM survey_wide""", views=WIDE)
def combine_files(spark, sf):
    root = scratch_path(spark, "exports")
    w = survey_wide(spark, sf)
    paths = []
    for prod in sorted(r[0] for r in w.select("product").distinct().collect()):  # a file per product
        hdr = HEADERS.get(prod, HEADERS["R"])
        p = f"{root}/{prod}"
        w.where(F.col("product") == prod).select(*[F.col(k).alias(v) for k, v in hdr.items()], "email") \
            .write.option("header", True).csv(p)
        paths.append(p)
    paths.append(f"{root}/missing-file")
    return SF.combine_files(spark, paths, MAPPING)


@query("store_roundtrip", """
SELECT product, COUNT(*) AS n, AVG(liking) AS mean_liking FROM survey_wide GROUP BY product""", views=WIDE)
def store_roundtrip(spark, sf):
    store = TableStore(spark)
    agg = survey_wide(spark, sf).groupBy("product").agg(F.count(F.lit(1)).alias("n"),
                                                         F.avg("liking").alias("mean_liking"))
    store.save(agg, "liking_by_product")
    return store.load("liking_by_product")


@query("store_list", """
SELECT concat('Product ', product) AS key, COUNT(*) AS rows FROM survey_wide GROUP BY product""", views=WIDE)
def store_list(spark, sf):
    store = VersionedStore(spark)
    w = survey_wide(spark, sf)
    store.save_all(w.withColumn("key", F.concat(F.lit("Product "), "product")), "key")  # all products in one job
    store.save(w.limit(0), "scratch")
    store.delete("scratch")
    return store.load_many(store.list()).groupBy(F.col("store_key").alias("key")).agg(F.count(F.lit(1)).alias("rows"))


@query("store_load_many", """
SELECT product AS store_key, COUNT(*) AS rows, SUM(liking) AS liking FROM survey_wide GROUP BY product""", views=WIDE)
def store_load_many(spark, sf):
    store = VersionedStore(spark)
    store.save_all(survey_wide(spark, sf), "product")
    return store.load_many([*store.list(), "absent"]).groupBy("store_key").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("liking").alias("liking"))


@query("likert_map_all", """
SELECT customer_id, product, email, CAST(t2b_store AS DOUBLE) AS t2b_store, CAST(jar_sweet AS DOUBLE) AS jar_sweet,
  CASE CAST(ten_taste AS INT) WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 3.0 WHEN 4 THEN 4.0 WHEN 5 THEN 5.0
    WHEN 6 THEN 6.0 WHEN 7 THEN 7.0 WHEN 8 THEN 8.0 WHEN 9 THEN 9.0 WHEN 10 THEN 10.0 END AS ten_taste FROM survey_wide""", views=WIDE)
def likert_map_all(spark, sf):
    text = [F.concat(F.lit(" "), F.col(c).cast("int").cast("string")).alias(c) for c in ("t2b_store", "jar_sweet", "ten_taste")]
    w = survey_wide(spark, sf).select("customer_id", "product", "email", *text)
    return C.apply_likert_mapping(w, likert_table(spark), ["customer_id", "product"], ["email"])


@query("encoding_audit", views=WIDE)
def encoding_audit(spark, sf):
    root = scratch_path(spark, "encodings")
    w = survey_wide(spark, sf).select("customer_id", "product", "email",
                                      F.concat(F.lit("Crème brûlée "), F.col("cata")).alias("cata"))
    w.write.option("header", True).option("encoding", "UTF-8").csv(f"{root}/utf8")
    w.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{root}/latin1")
    return SF.encoding_audit(spark, f"{root}/*/*.csv")


@query("report_sink", views=WIDE)
def report_sink(spark, sf):
    path = scratch_path(spark, "report")
    box = A.box_scores(survey_wide(spark, sf), ["t2b_store"], ["ten_taste", "ten_aroma", "ten_foam"])
    SK.report_sink(box.withColumn("sheet", F.concat(F.lit("Box: "), "product")), path)
    return spark.read.parquet(path)


@query("study_run", views=WIDE)
def study_run(spark, sf):
    from ..fixtures import STUDY, TARGET
    from .study import run_study
    return run_study(spark, survey_wide(spark, sf), STUDY, TARGET,
                     abbreviations={"jar_sweet": "Sweetness", "jar_thick": "Thickness"}).drop("path")


def _report_sql() -> str:
    """The frequency reports of the study in one long table, from the SQL of the single reports."""
    from . import summaries  # noqa: F401  registers them
    from .registry import REGISTRY
    columns = {
        "likert_counts": ("question", "level", {"count": "count", "percentage": "percentage"}),
        "box_scores": ("question", "metric", {"value": "value"}),
        "jar_5pt": ("question", "CAST(value AS VARCHAR)", {"pct": "pct"}),
        "jar_3pt": ("attribute", "category", {"pct": "pct"}),
        "crosstab": ("name", "CAST(value1 AS VARCHAR) || '|' || CAST(value2 AS VARCHAR)", {"n": "n"}),
        "cata_counts": ("question", "attribute", {"count": "count", "percentage": "percentage"}),
    }
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS report, product, {question} AS question, {item} AS item, '{measure}' AS measure, "
        f"CAST({column} AS DOUBLE) AS value FROM ({REGISTRY[name].oracle}) AS t"
        for name, (question, item, measures) in columns.items() for measure, column in measures.items())


@query("study_reports", _report_sql(), views=WIDE)
def study_reports(spark, sf):
    """The frequency reports that a study run writes, read back into one long table."""
    from ..fixtures import STUDY, TARGET
    from .study import run_study
    shape = {"likert_counts": ("question", "level", ["count", "percentage"]), "box_scores": ("question", "metric", ["value"]),
             "jar_5pt": ("question", "value", ["pct"]), "jar_3pt": ("attribute", "category", ["pct"]),
             "crosstab": ("name", None, ["n"]), "cata_counts": ("question", "attribute", ["count", "percentage"])}
    done = run_study(spark, survey_wide(spark, sf), STUDY, TARGET, only=list(shape),
                     abbreviations={"jar_sweet": "Sweetness", "jar_thick": "Thickness"})
    out = None
    for r in done.collect():  # a row per report
        question, item, measures = shape[r["table"]]
        item = F.col(item).cast("string") if item else F.concat_ws("|", F.col("value1").cast("string"), F.col("value2").cast("string"))
        rows = spark.read.parquet(r["path"]).select(F.lit(r["table"]).alias("report"), "product", F.col(question).alias("question"),
                                                    item.alias("item"), *[F.col(m).cast("double").alias(f"_{m}") for m in measures])
        long = rows.unpivot(["report", "product", "question", "item"], [f"_{m}" for m in measures], "measure", "value")
        long = long.withColumn("measure", F.substring("measure", 2, 20))
        out = long if out is None else out.unionByName(long)
    return out


@query("safe_labels_unique", """
WITH b AS (SELECT attribute, rtrim(substr(trim(regexp_replace(attribute, '[:\\\\/?*\\[\\]]', ' ', 'g')), 1, 23)) || '_Summary' AS base
           FROM (SELECT DISTINCT attribute FROM survey_eav)),
r AS (SELECT attribute, base, row_number() OVER (PARTITION BY base ORDER BY attribute) AS k FROM b)
SELECT attribute, CASE WHEN k = 1 THEN base
  ELSE substr(base, 1, 31 - length('_' || CAST(k AS VARCHAR))) || '_' || CAST(k AS VARCHAR) END AS sheet FROM r""")
def safe_labels_unique(spark, sf):
    from ..functions.scalar import safe_sheet_labels
    e = survey_eav(spark, sf).select("attribute").distinct()
    return safe_sheet_labels(e, "attribute", "_Summary")


def _lists_json(rows, name: str, value: str, path: str) -> None:
    """One JSON object of lists: every ``name`` with the distinct values of ``value``."""
    names = sorted(r[0] for r in rows.select(name).distinct().collect())  # roles or scale levels
    lists = [F.collect_set(F.when(F.col(name) == n, F.col(value))).alias(str(n)) for n in names]
    rows.select(name, value).distinct().agg(*lists).coalesce(1).write.json(path)


@query("config_dim", "SELECT DISTINCT scaletype AS role, attribute AS question FROM survey_eav")
def config_dim(spark, sf):
    """The questions of each scale, as a study configuration written from the responses."""
    path = scratch_path(spark, "study-config")
    _lists_json(survey_eav(spark, sf), "scaletype", "attribute", path)
    return SF.config_dim(spark, path)


@query("likert_dim", """
SELECT DISTINCT CAST(answerscore AS INTEGER) AS level, answer AS label FROM survey_eav
WHERE answerscore IS NOT NULL AND answer IS NOT NULL""")
def likert_dim(spark, sf):
    """The answers given at each score, as a level file written from the responses."""
    path = scratch_path(spark, "likert-levels")
    e = survey_eav(spark, sf).where("answerscore IS NOT NULL AND answer IS NOT NULL")
    _lists_json(e.withColumn("level", F.concat(F.lit("level_"), F.col("answerscore").cast("int"))), "level", "answer", path)
    return SF.likert_dim(spark, path)
