"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

# The six ASCII white-space characters that separate words: space, \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound what one Arrow batch may hold (rows and bytes)."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it again (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread_sample(df: DataFrame, rows: int, n: int, *keys: str) -> DataFrame:
    """About ``rows`` of the ``n`` rows of ``df``, chosen by a hash of ``keys`` (all, if fewer)."""
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(max(n, 1))) < rows)


HEAVY_GROUPS = 4096  # groups with more than this share of all rows are joined by broadcast; there are fewer than that


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "group_size") -> DataFrame:
    """Every row of ``rows`` with the columns of its group (inner join on ``keys``, which hold no null).

    ``groups`` has one row per group, with the number ``n`` of its rows.  A group with more than
    a 4096th of all rows would land in one task; there are fewer than 4096 of those, so they are
    broadcast, and all other groups are joined by a shuffle.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    heavy = F.col(n) * HEAVY_GROUPS > total
    large = F.broadcast(groups.where(heavy))
    rest = rows.join(F.broadcast(groups.where(heavy).select(*keys)), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(groups.where(~heavy), keys))
