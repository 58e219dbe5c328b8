"""Registered discovery / data-quality queries (parameters fitted to the fixture)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import survey_eav
from ..operators import discovery as D
from .registry import query

YEAR = 1998
COUNTRY = "Country_O"
SURVEY_TYPES = ["Own", "Competitor"]
PROJECT = "Project_A"
PRODUCTS = ["Product_STANDARD", "Product_LARGE"]
STUDY = "Study_Brand#13"


COLUMNS = ("customerid productname missiondesc attribute answerscore answer questionid question scaletype responseid questiongroup "
           "questionsubgroup questionsubgroup2 year country studyname project_name originalsurveytype daynumber").split()


@query("sx_1a_columns", "\nUNION ALL ".join(
    f"SELECT {i + 1} AS ordinal, '{c}' AS column_name, COUNT({c}) AS filled FROM survey_eav" for i, c in enumerate(COLUMNS)))
def sx_1a_columns(spark, sf):
    """The view's columns in order, each with its number of filled cells."""
    eav = survey_eav(spark, sf)
    names = eav.columns
    filled = eav.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column_name", "filled")
    return D.columns_table(eav).join(F.broadcast(filled), "column_name").select("ordinal", "column_name", "filled")


@query("sx_1b_sample", f"""
SELECT questionid, question, attribute, answer, answerscore, scaletype FROM survey_eav
WHERE answer IS NOT NULL AND year = {YEAR} ORDER BY responseid, questionid LIMIT 50""")
def sx_1b_sample(spark, sf):
    return D.sample_rows(survey_eav(spark, sf), YEAR)


@query("sx_1c_scales", """
SELECT scaletype, COUNT(*) AS rowcount FROM survey_eav WHERE answerscore IS NOT NULL
GROUP BY scaletype ORDER BY rowcount DESC""")
def sx_1c_scales(spark, sf):
    return D.scale_type_counts(survey_eav(spark, sf))


@query("sx_2a_resp", "SELECT COUNT(DISTINCT responseid) AS uniquerespondents FROM survey_eav")
def sx_2a_resp(spark, sf):
    return D.unique_respondents(survey_eav(spark, sf))


@query("sx_2b_questions", "SELECT COUNT(DISTINCT questionid) AS uniquequestions FROM survey_eav")
def sx_2b_questions(spark, sf):
    return D.unique_questions(survey_eav(spark, sf))


@query("sx_2c_sample_size", """
SELECT COUNT(DISTINCT customerid) AS uniquerespondents FROM survey_eav
WHERE answerscore IS NOT NULL AND missiondesc IN ('Visit 1', 'Visit 5', 'Visit 9')
  AND productname IN ('Product_STANDARD', 'Product_LARGE')""")
def sx_2c_sample_size(spark, sf):
    return D.sample_size(survey_eav(spark, sf), ["Visit 1", "Visit 5", "Visit 9"], PRODUCTS)


@query("sx_3a_hierarchy", """
SELECT questiongroup, questionsubgroup, COUNT(*) AS numquestions FROM survey_eav
GROUP BY questiongroup, questionsubgroup ORDER BY questiongroup, questionsubgroup""")
def sx_3a_hierarchy(spark, sf):
    return D.question_groups(survey_eav(spark, sf))


@query("sx_3b_hierarchy", """
SELECT DISTINCT questiongroup, questionsubgroup, questionsubgroup2, question, questionid FROM survey_eav
WHERE answerscore IS NOT NULL AND missiondesc IN ('Visit 3', 'Visit 7', 'Visit 11')
  AND productname IN ('Product_STANDARD', 'Product_LARGE') ORDER BY questionid""")
def sx_3b_hierarchy(spark, sf):
    return D.question_hierarchy(survey_eav(spark, sf), ["Visit 3", "Visit 7", "Visit 11"], PRODUCTS)


@query("sx_4a_attributes", """
SELECT DISTINCT question, attribute FROM survey_eav
WHERE answerscore IS NOT NULL AND missiondesc IN ('Visit 1')
  AND productname IN ('Product_STANDARD', 'Product_LARGE') ORDER BY attribute""")
def sx_4a_attributes(spark, sf):
    return D.attributes_for(survey_eav(spark, sf), ["Visit 1"], PRODUCTS)


@query("sx_4b_attributes", """
SELECT DISTINCT attribute, question, scaletype, answer FROM survey_eav
WHERE answerscore IS NOT NULL AND missiondesc IN ('Visit 1', 'Visit 2', 'Visit 3') ORDER BY attribute""")
def sx_4b_attributes(spark, sf):
    return D.attribute_answers(survey_eav(spark, sf), ["Visit 1", "Visit 2", "Visit 3"])


@query("sx_4c_coverage", """
SELECT missiondesc, attribute, COUNT(DISTINCT customerid) AS respondentcount FROM survey_eav
WHERE answerscore IS NOT NULL AND productname IN ('Product_STANDARD', 'Product_LARGE')
GROUP BY missiondesc, attribute ORDER BY attribute, missiondesc""")
def sx_4c_coverage(spark, sf):
    return D.attribute_coverage(survey_eav(spark, sf), PRODUCTS)


@query("sx_5a_studies", f"""
SELECT DISTINCT studyname FROM survey_eav
WHERE answerscore IS NOT NULL AND year = {YEAR} AND country = '{COUNTRY}' ORDER BY studyname""")
def sx_5a_studies(spark, sf):
    return D.study_names(survey_eav(spark, sf), YEAR, COUNTRY)


@query("sx_5b_projects", f"""
SELECT DISTINCT project_name FROM survey_eav
WHERE originalsurveytype IN ('Own', 'Competitor') AND year = {YEAR} AND answerscore IS NOT NULL
ORDER BY project_name""")
def sx_5b_projects(spark, sf):
    return D.project_names(survey_eav(spark, sf), SURVEY_TYPES, YEAR)


@query("sx_5c_products", f"""
SELECT DISTINCT productname FROM survey_eav
WHERE originalsurveytype IN ('Own', 'Competitor') AND project_name = '{PROJECT}'
  AND daynumber = 'Visit 1' AND answerscore IS NOT NULL ORDER BY productname""")
def sx_5c_products(spark, sf):
    return D.products_in_project(survey_eav(spark, sf), SURVEY_TYPES, PROJECT, "Visit 1")


@query("sx_5d_types", f"""
SELECT originalsurveytype, COUNT(*) AS rowcount FROM survey_eav
WHERE project_name = '{PROJECT}' AND answerscore IS NOT NULL
GROUP BY originalsurveytype ORDER BY rowcount DESC""")
def sx_5d_types(spark, sf):
    return D.survey_type_counts(survey_eav(spark, sf), PROJECT)


@query("sx_6a_synonyms", """
SELECT DISTINCT productname, attribute FROM survey_eav
WHERE answerscore IS NOT NULL AND missiondesc IN ('Visit 3', 'Visit 7', 'Visit 11')
  AND attribute LIKE '%accept%' ORDER BY attribute, productname""")
def sx_6a_synonyms(spark, sf):
    return D.synonym_finder(survey_eav(spark, sf), ["Visit 3", "Visit 7", "Visit 11"], "%accept%")


@query("sx_6b_disambig", f"""
SELECT DISTINCT rtrim(productname) || '_REF' AS productname_disambiguated, studyname, attribute, question
FROM survey_eav
WHERE productname IN ('Product_STANDARD', 'Product_LARGE') AND studyname = '{STUDY}'
  AND missiondesc = 'Visit 1' AND answerscore IS NOT NULL""")
def sx_6b_disambig(spark, sf):
    return D.product_disambiguation(survey_eav(spark, sf), PRODUCTS, STUDY, "Visit 1")


@query("sx_6c_population", """
SELECT attribute,
  COUNT(CASE WHEN answerscore IS NOT NULL THEN 1 END) AS hasanswerscore,
  COUNT(CASE WHEN answer IS NOT NULL THEN 1 END) AS hasanswer,
  COUNT(CASE WHEN answerscore IS NULL AND answer IS NOT NULL THEN 1 END) AS textonlyrows
FROM survey_eav
WHERE productname IN ('Product_STANDARD', 'Product_LARGE') AND missiondesc IN ('Visit 1')
GROUP BY attribute ORDER BY textonlyrows DESC, attribute""")
def sx_6c_population(spark, sf):
    return D.answer_population(survey_eav(spark, sf), PRODUCTS, ["Visit 1"])


@query("sx_6d_spot", """
SELECT customerid, productname, missiondesc, attribute, answer, answerscore FROM survey_eav
WHERE customerid = 7 AND productname IN ('Product_STANDARD', 'Product_LARGE') AND answerscore IS NOT NULL
ORDER BY attribute""")
def sx_6d_spot(spark, sf):
    return D.respondent_spot_check(survey_eav(spark, sf), 7, PRODUCTS)
