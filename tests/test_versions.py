"""The versioned keyed store."""

import pytest
from pyspark.sql import functions as F

from sondage.session import scratch_path
from sondage.sources.versions import VersionedStore


def rows(spark, *values):
    return spark.createDataFrame(list(values), "product string, x int")


@pytest.fixture
def store(spark):
    return VersionedStore(spark, scratch_path(spark, "test-versions"))


def values(df):
    return sorted(r["x"] for r in df.collect())


def test_saves_replace_their_keys_only(spark, store):
    assert store.list() == [] and store.load("A") is None and store.load_many(["A"]) is None
    assert store.save_all(rows(spark, ("A", 1), ("A", 2), ("b/c=d e", 3), ("07", 4)), "product") == 1
    assert store.save_all(rows(spark, ("A", 9)), "product", keep_key=True) == 2
    assert store.save(spark.createDataFrame([(5, "z")], "x int, note string"), "B") == 3
    assert store.list() == ["07", "A", "B", "b/c=d e"]
    assert values(store.load("A")) == [9] and store.load("A").columns == ["product", "x"]
    assert values(store.load("b/c=d e")) == [3] and values(store.load("07")) == [4]
    many = {(r["store_key"], r["x"], r["note"], r["product"]) for r in store.load_many(["A", "B", "07", "absent"]).collect()}
    assert many == {("A", 9, None, "A"), ("B", 5, "z", None), ("07", 4, None, None)}


def test_a_reader_stays_on_its_version(spark, store):
    store.save_all(rows(spark, ("A", 1), ("B", 2)), "product")
    before = store.snapshot()
    lazy = before.load("A")
    store.save(spark.createDataFrame([(7,)], "x int"), "A")
    store.delete("B")
    assert values(lazy) == values(before.load("A")) == [1] and before.list() == ["A", "B"]
    assert store.list() == ["A"] and values(store.load("A")) == [7] and store.load("B") is None
    assert store.versions() == [1, 2, 3] and values(store.snapshot(1).load("B")) == [2]
    with pytest.raises(KeyError):
        store.snapshot(9)


def test_a_failed_save_leaves_the_version_before(spark, store):
    store.save_all(rows(spark, ("A", 1)), "product")
    broken = rows(spark, ("A", 2), ("C", 3)).withColumn("x", F.when(F.col("x") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        store.save_all(broken, "product")
    for bad in (rows(spark, (None, 2)), rows(spark, ("", 2))):
        with pytest.raises(Exception, match="without a key"):
            store.save_all(bad, "product")
    with pytest.raises(ValueError):
        store.save(rows(spark), "")
    assert store.versions() == [1] and values(store.load("A")) == [1]


def test_the_second_of_two_saves_fails(spark, store):
    store.save(spark.range(1).selectExpr("cast(id as int) x"), "A")
    base = store.snapshot()
    store.save(spark.range(2).selectExpr("cast(id as int) x"), "A")
    with pytest.raises(Exception, match="(?i)exist"):
        store._write(base, base.manifest())
    assert values(store.load("A")) == [0, 1]


def test_no_rows_and_pruning(spark, store):
    store.save(rows(spark), "none")
    assert store.list() == ["none"] and store.load("none").count() == 0
    store.save_all(rows(spark, *[(f"p{i}", i) for i in range(9)]), "product")
    plan = store.load("p3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "p3" in plan[plan.index("PartitionFilters"):] and store.load("p3").inputFiles()
    assert store.save_all(rows(spark), "product") == 3 and len(store.list()) == 10
