"""Partitioning helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def balance(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition by ``key`` when the input has fewer splits than 2x the cores.

    Single-row-group files (and a few very large documents) would otherwise
    leave most cores idle in the scan stage; with many input splits (the
    large-scale case) the data are left where they are and no shuffle is added.
    """
    target = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target, key) if df.rdd.getNumPartitions() < target else df

