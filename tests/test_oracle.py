"""Every registered query against its DuckDB oracle (sf0.001), and a run check for the rest."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, norm

from .conftest import SF_SMALL

LLM_QUERIES = set(E.LLM_QUERIES)  # tested in tests/llm
ORACLES = {k: v for k, v in E.oracle_sql().items() if k not in LLM_QUERIES}
KEYS = sorted(k for k in E.queries() if k not in LLM_QUERIES)
HEAVY = {"gbt_importance", "driver_merge", "driver_rf", "themes", "theme_assign", "theme_summary", "theme_dictionary",
         "study_run"}  # tests/test_study.py runs its parts; the trees take minutes


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    exp = con.execute(ORACLES[key]).fetchdf()
    assert sorted(got.columns) == sorted(exp.columns)
    assert norm(got) == norm(exp)


@pytest.mark.parametrize("key", [k for k in KEYS if k not in ORACLES and k not in HEAVY])
def test_runs_without_oracle(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    assert df.count() > 0
    assert df.schema == E.queries()[key](spark, SF_SMALL).schema


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
