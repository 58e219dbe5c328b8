"""Report sinks: one long result table per report, partitioned by sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def report_sink(df: DataFrame, path: str, sheet_col: str = "sheet", fmt: str = "parquet") -> str:
    """Write ``df`` partitioned by a sanitised sheet label (the workbook-per-sheet layout)."""
    out = df.withColumn(sheet_col, S.clean_sheet_name(F.col(sheet_col)))
    out.write.mode("overwrite").partitionBy(sheet_col).format(fmt).option("header", True).save(path)
    return path


def csv_sink(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def json_sink(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
