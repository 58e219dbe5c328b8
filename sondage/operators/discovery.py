"""Discovery and data-quality queries over the EAV response view.

Each is one declarative DataFrame query; filters sit directly on the scan so
Catalyst pushes them into parquet, and DISTINCT over GROUP BY is left for the
optimizer to remove.  ``count_distinct`` is exact; pass ``approx=True`` to the
sizing queries for HyperLogLog++ when the exact distinct shuffle is too costly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scored(eav: DataFrame) -> DataFrame:
    return eav.where(F.col("answerscore").isNotNull())


def column_listing(eav: DataFrame) -> list[tuple[int, str, str]]:
    """Columns of the view in ordinal order (metadata only, no job)."""
    return [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(eav.schema.fields)]


def columns_table(eav: DataFrame) -> DataFrame:
    """``column_listing`` as a table: (ordinal, column_name, data_type)."""
    return eav.sparkSession.createDataFrame(column_listing(eav), "ordinal int, column_name string, data_type string")


def sample_rows(eav: DataFrame, year: int, n: int = 50) -> DataFrame:
    """TOP n rows with a text answer in ``year``; a total order makes it repeatable."""
    return (eav.where(F.col("answer").isNotNull() & (F.col("year") == year))
            .select("questionid", "question", "attribute", "answer", "answerscore", "scaletype",
                    "responseid")
            .orderBy("responseid", "questionid").limit(n).drop("responseid"))


def scale_type_counts(eav: DataFrame) -> DataFrame:
    return (_scored(eav).groupBy("scaletype").agg(F.count(F.lit(1)).alias("rowcount"))
            .orderBy(F.desc("rowcount"), "scaletype"))


def _distinct_count(col: str, approx: bool):
    return F.approx_count_distinct(col) if approx else F.count_distinct(col)


def unique_respondents(eav: DataFrame, approx: bool = False) -> DataFrame:
    return eav.agg(_distinct_count("responseid", approx).alias("uniquerespondents"))


def unique_questions(eav: DataFrame, approx: bool = False) -> DataFrame:
    return eav.agg(_distinct_count("questionid", approx).alias("uniquequestions"))


def sample_size(eav: DataFrame, visits: Sequence[str], products: Sequence[str],
                approx: bool = False) -> DataFrame:
    return (_scored(eav).where(F.col("missiondesc").isin(list(visits))
                               & F.col("productname").isin(list(products)))
            .agg(_distinct_count("customerid", approx).alias("uniquerespondents")))


def question_groups(eav: DataFrame) -> DataFrame:
    return (eav.groupBy("questiongroup", "questionsubgroup")
            .agg(F.count(F.lit(1)).alias("numquestions"))
            .orderBy("questiongroup", "questionsubgroup"))


def question_hierarchy(eav: DataFrame, visits: Sequence[str], products: Sequence[str]) -> DataFrame:
    return (_scored(eav).where(F.col("missiondesc").isin(list(visits))
                               & F.col("productname").isin(list(products)))
            .select("questiongroup", "questionsubgroup", "questionsubgroup2", "question", "questionid")
            .distinct().orderBy("questionid", "question"))


def attributes_for(eav: DataFrame, visits: Sequence[str], products: Sequence[str]) -> DataFrame:
    return (_scored(eav).where(F.col("missiondesc").isin(list(visits))
                               & F.col("productname").isin(list(products)))
            .select("question", "attribute").distinct().orderBy("attribute", "question"))


def attribute_answers(eav: DataFrame, visits: Sequence[str]) -> DataFrame:
    return (_scored(eav).where(F.col("missiondesc").isin(list(visits)))
            .select("attribute", "question", "scaletype", "answer").distinct()
            .orderBy("attribute", "question", "scaletype", "answer"))


def attribute_coverage(eav: DataFrame, products: Sequence[str], approx: bool = False) -> DataFrame:
    return (_scored(eav).where(F.col("productname").isin(list(products)))
            .groupBy("missiondesc", "attribute")
            .agg(_distinct_count("customerid", approx).alias("respondentcount"))
            .orderBy("attribute", "missiondesc"))


def study_names(eav: DataFrame, year: int, country: str) -> DataFrame:
    return (_scored(eav).where((F.col("year") == year) & (F.col("country") == country))
            .select("studyname").distinct().orderBy("studyname"))


def project_names(eav: DataFrame, survey_types: Sequence[str], year: int) -> DataFrame:
    return (_scored(eav).where(F.col("originalsurveytype").isin(list(survey_types))
                               & (F.col("year") == year))
            .select("project_name").distinct().orderBy("project_name"))


def products_in_project(eav: DataFrame, survey_types: Sequence[str], project: str,
                        day: str) -> DataFrame:
    return (_scored(eav).where(F.col("originalsurveytype").isin(list(survey_types))
                               & (F.col("project_name") == project) & (F.col("daynumber") == day))
            .select("productname").distinct().orderBy("productname"))


def survey_type_counts(eav: DataFrame, project: str) -> DataFrame:
    return (_scored(eav).where(F.col("project_name") == project)
            .groupBy("originalsurveytype").agg(F.count(F.lit(1)).alias("rowcount"))
            .orderBy(F.desc("rowcount"), "originalsurveytype"))


def synonym_finder(eav: DataFrame, visits: Sequence[str], pattern: str,
                   case_insensitive: bool = False) -> DataFrame:
    """``Attribute LIKE pattern``; binary by default, ``case_insensitive`` uses ILIKE."""
    attr = F.col("attribute")
    cond = attr.ilike(pattern) if case_insensitive else attr.like(pattern)
    return (_scored(eav).where(F.col("missiondesc").isin(list(visits)) & cond)
            .select("productname", "attribute").distinct().orderBy("attribute", "productname"))


def product_disambiguation(eav: DataFrame, products: Sequence[str], study: str, visit: str,
                           suffix: str = "_REF") -> DataFrame:
    return (_scored(eav).where(F.col("productname").isin(list(products))
                               & (F.col("studyname") == study) & (F.col("missiondesc") == visit))
            .select(F.concat(F.rtrim("productname"), F.lit(suffix)).alias("productname_disambiguated"),
                    "studyname", "attribute", "question").distinct())


def answer_population(eav: DataFrame, products: Sequence[str], visits: Sequence[str]) -> DataFrame:
    s, a = F.col("answerscore"), F.col("answer")
    return (eav.where(F.col("productname").isin(list(products)) & F.col("missiondesc").isin(list(visits)))
            .groupBy("attribute")
            .agg(F.count_if(s.isNotNull()).alias("hasanswerscore"),
                 F.count_if(a.isNotNull()).alias("hasanswer"),
                 F.count_if(s.isNull() & a.isNotNull()).alias("textonlyrows"))
            .orderBy(F.desc("textonlyrows"), "attribute"))


def respondent_spot_check(eav: DataFrame, customer_id: int, products: Sequence[str]) -> DataFrame:
    return (_scored(eav).where((F.col("customerid") == customer_id)
                               & F.col("productname").isin(list(products)))
            .select("customerid", "productname", "missiondesc", "attribute", "answer", "answerscore")
            .orderBy("attribute", "missiondesc", "productname"))
