"""Registered pivot queries over the derived ``survey_eav`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import survey_eav
from ..operators import reshape as R
from .registry import query

# Fixed values of the derived fixture: its attribute names and its one synonym pair.
FIXTURE_V1_ATTRIBUTES = [
    "Overall Opinion-Liking-Product",
    "Pack-Experience-Easy to Store",
    "Sensory-Experience-Level of foam",
]
FIXTURE_SYNONYMS = {
    "Benefits-Agreement-Baby will accept": "Benefits-Agreement-Would accept",
    "Benefits-Agreement-Child would accept": "Benefits-Agreement-Would accept",
}
FIXTURE_V3_ATTRIBUTES = [
    "Overall Opinion-Liking-Product",
    "Pack-Experience-Easy to Store",
    "Benefits-Agreement-Would accept",
    "Sensory-Experience-Level of foam",
    "Sensory-JAR-Sweetness",
]
V1_VISITS = ["Visit 1", "Visit 5", "Visit 9"]
V3_VISITS = ["Visit 3", "Visit 7", "Visit 11"]


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pivot_oracle(attrs, visits, synonyms=None, agg="MAX") -> str:
    unify = "attribute"
    if synonyms:
        whens = " ".join(f"WHEN attribute = '{k}' THEN '{v}'" for k, v in synonyms.items())
        unify = f"CASE {whens} ELSE attribute END"
    cols = ",\n".join(f"MAX(CASE WHEN attribute = '{a}' THEN answerscore END) AS {_q(a)}" for a in attrs)
    outs = ",\n".join(f"s.{_q(a)}" for a in attrs)
    return f"""
WITH base AS (
  SELECT customerid, productname, missiondesc, {unify} AS attribute, answerscore
  FROM survey_eav
  WHERE answerscore IS NOT NULL AND missiondesc IN ({_in(visits)})
    AND attribute <> 'Product-3DigitCode-'),
collapsed AS (
  SELECT customerid, productname, missiondesc, attribute, {agg}(answerscore) AS answerscore
  FROM base GROUP BY customerid, productname, missiondesc, attribute),
sp AS (
  SELECT customerid, productname, missiondesc,
{cols}
  FROM collapsed GROUP BY customerid, productname, missiondesc),
dc AS (
  SELECT customerid, productname, missiondesc, MAX(answer) AS "Product-3DigitCode-"
  FROM survey_eav
  WHERE attribute = 'Product-3DigitCode-' AND missiondesc IN ({_in(visits)})
  GROUP BY customerid, productname, missiondesc)
SELECT COALESCE(s.customerid, d.customerid) AS customerid,
  COALESCE(s.productname, d.productname) AS productname,
  COALESCE(s.missiondesc, d.missiondesc) AS missiondesc,
{outs},
  d."Product-3DigitCode-"
FROM sp s FULL OUTER JOIN dc d
  ON s.customerid = d.customerid AND s.productname = d.productname AND s.missiondesc = d.missiondesc
"""


@query("scan_eav", "SELECT * FROM survey_eav")
def scan_eav(spark, sf_dir):
    return survey_eav(spark, sf_dir)


@query("visit1_wide", _pivot_oracle(FIXTURE_V1_ATTRIBUTES, V1_VISITS))
def visit1_wide(spark, sf_dir):
    return R.pivot_eav(survey_eav(spark, sf_dir), FIXTURE_V1_ATTRIBUTES, visits=V1_VISITS)


@query("visit3_wide", _pivot_oracle(FIXTURE_V3_ATTRIBUTES, V3_VISITS, FIXTURE_SYNONYMS))
def visit3_wide(spark, sf_dir):
    return R.pivot_eav(survey_eav(spark, sf_dir), FIXTURE_V3_ATTRIBUTES, visits=V3_VISITS,
                       synonyms=FIXTURE_SYNONYMS)


@query("visit3_wide_avg", _pivot_oracle(FIXTURE_V3_ATTRIBUTES, V3_VISITS, FIXTURE_SYNONYMS, "AVG"))
def visit3_wide_avg(spark, sf_dir):
    return R.pivot_eav(survey_eav(spark, sf_dir), FIXTURE_V3_ATTRIBUTES, visits=V3_VISITS,
                       synonyms=FIXTURE_SYNONYMS, collapse="avg")


_SYN_CASE = " ".join(f"WHEN attribute = '{k}' THEN '{v}'" for k, v in FIXTURE_SYNONYMS.items())


@query("synonym_map", f"""
SELECT customerid, productname, missiondesc, CASE {_SYN_CASE} ELSE attribute END AS attribute, answerscore
FROM survey_eav
WHERE answerscore IS NOT NULL AND missiondesc IN ({_in(V3_VISITS)}) AND attribute <> 'Product-3DigitCode-'
""")
def synonym_map(spark, sf_dir):
    return R.synonym_map(survey_eav(spark, sf_dir), FIXTURE_SYNONYMS, visits=V3_VISITS)


@query("synonym_collapse", f"""
SELECT customerid, productname, missiondesc, attribute, MAX(answerscore) AS answerscore FROM (
  SELECT customerid, productname, missiondesc, CASE {_SYN_CASE} ELSE attribute END AS attribute, answerscore
  FROM survey_eav
  WHERE answerscore IS NOT NULL AND missiondesc IN ({_in(V3_VISITS)}) AND attribute <> 'Product-3DigitCode-')
GROUP BY customerid, productname, missiondesc, attribute
""")
def synonym_collapse(spark, sf_dir):
    mapped = R.synonym_map(survey_eav(spark, sf_dir), FIXTURE_SYNONYMS, visits=V3_VISITS)
    return R.synonym_collapse(mapped, "max")
