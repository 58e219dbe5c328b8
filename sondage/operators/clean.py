"""Cleaning operators: whole-table column transforms, renames and splits.

All are narrow (no shuffle) except the membership split, which is a left-semi
join; Spark/AQE picks a broadcast for it only when the runtime size of the
list side is below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S


def _require(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Column(s) not found: {missing}")


def whitespace_remover(df: DataFrame) -> DataFrame:
    """Strip every string cell; other types untouched."""
    return df.select(*[S.strip_whitespace(f.name).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def convert_columns_to_float(df: DataFrame, columns: Sequence[str], keep_sign: bool = False) -> DataFrame:
    """Keep digits and dots, then parse to DOUBLE (NULL when unparsable); absent columns skipped."""
    present = set(c for c in columns if c in df.columns)
    return df.select(*[S.to_float(c, keep_sign).alias(c) if c in present else F.col(f"`{c}`")
                       for c in df.columns])


def clean_column_headers(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """Remove literal substrings from every column name, then strip."""
    if not words:
        return df
    pat = re.compile("|".join(re.escape(w) for w in words))
    return df.toDF(*[pat.sub("", c).strip() for c in df.columns])


def replace_if_contains(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    """Whole cell becomes ``replacement`` when it matches the regex; NULL never matches."""
    if column not in df.columns:
        return df
    c = F.col(column)
    return df.withColumn(column, F.when(c.rlike(pattern), F.lit(replacement)).otherwise(c))


def find_and_replace(df: DataFrame, columns: Sequence[str],
                     replacements: Sequence[tuple[Sequence, object]]) -> DataFrame:
    """Exact-cell replacement; each (values, replacement) in order, each value in order (chains).

    All values are literals, so each chain is followed to its end when planning: the
    plan holds one branch per distinct value, however long the chains are.
    """
    final: dict = {}
    for values, rep in replacements:
        for v in values:
            final.update({k: rep for k, x in final.items() if x == v})
            final.setdefault(v, rep)
    out = {}
    for col in columns:
        if col not in df.columns or not final:
            continue
        case = F
        for v, rep in final.items():
            case = case.when(F.col(col) == F.lit(v), F.lit(rep))
        out[col] = case.otherwise(F.col(col))
    return df.withColumns(out) if out else df


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _require(df, columns)
    return df.fillna(0, subset=list(columns))


def cast_columns(df: DataFrame, columns: Sequence[str], dtype: str) -> DataFrame:
    _require(df, columns)
    return df.withColumns({c: F.col(c).cast(dtype) for c in columns})


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Rename the columns present; also return the new names applied."""
    present = {c: mapping[c] for c in df.columns if c in mapping}
    return df.withColumnsRenamed(present), list(present.values())


def split_by_list(df: DataFrame, list1: DataFrame, list2: DataFrame, column: str = "email"
                  ) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` is in each list (a row may be in both or neither)."""
    def member(lst: DataFrame) -> DataFrame:
        keys = lst.select(F.col(lst.columns[0]).alias(column)).distinct()
        return df.join(keys, column, "left_semi")
    return member(list1), member(list2)


def split_by_prefix(df: DataFrame, c1: str = "1", c2: str = "2", column: str = "email",
                    lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rotation split on the first characters of ``column`` (optionally lower-cased first)."""
    if lower:
        df = df.withColumn(column, F.lower(column))
    return df.where(F.col(column).startswith(c1)), df.where(F.col(column).startswith(c2))


def sort_respondents(df: DataFrame, column: str = "customer_id") -> DataFrame:
    _require(df, [column])
    return df.orderBy(column)


def missingness(df: DataFrame, columns: Sequence[str], threshold: float,
                group: Sequence[str] = ()) -> DataFrame:
    """Null share per column (one pass) and whether it is kept (share <= threshold)."""
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    wide = df.groupBy(*group).agg(*aggs)
    long = wide.unpivot(list(group), list(columns), "question", "null_share")
    return long.withColumn("kept", F.col("null_share") <= F.lit(float(threshold)))


def predictor_set(predictors: Sequence[str], target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Ordered, de-duplicated predictors without the target and excluded columns."""
    seen, out = set(exclude) | {target}, []
    for p in predictors:
        if p not in seen:
            seen.add(p)
            out.append(p)
    return out


def pair_alignment_check(df: DataFrame, key: str = "customer_id", group: str = "product") -> DataFrame:
    """Keys not present exactly once in every group (the positional-alignment validation).

    Returns (key, n_groups_present, max_count) for offending keys; empty means aligned.
    """
    n_groups = df.select(group).distinct().count()
    per = df.groupBy(key, group).agg(F.count(F.lit(1)).alias("_n"))
    agg = per.groupBy(key).agg(F.count(F.lit(1)).alias("n_groups_present"),
                               F.max("_n").alias("max_count"))
    return agg.where((F.col("n_groups_present") != n_groups) | (F.col("max_count") != 1))


# Likert text -> level.  The level table is the questionnaire's Likert map
# (at most 20 levels of a few labels each), so broadcasting it is bounded; the
# bound is still checked before the hint is given.
BROADCAST_MAX_ROWS = 100_000
LIKERT_MAX_LABELS = 2_000


def _maybe_broadcast(dim: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    return F.broadcast(dim) if dim.limit(max_rows + 1).count() <= max_rows else dim


def likert_lookup(likert: DataFrame) -> DataFrame:
    """(label, level): the FIRST level listing each label wins."""
    return likert.groupBy("label").agg(F.min("level").cast("double").alias("level"))


def likert_map(df: DataFrame, column: str, likert: DataFrame, out: str | None = None) -> DataFrame:
    """Trimmed text -> numeric level (NULL when unrecognised), one broadcast join."""
    lk = _maybe_broadcast(likert_lookup(likert).withColumnRenamed("label", "_label")
                          .withColumnRenamed("level", "_level"))
    j = df.join(lk, S.strip_whitespace(F.col(column)) == F.col("_label"), "left")
    return j.drop("_label").withColumnRenamed("_level", out or f"{column}_level")


def apply_likert_mapping(wide: DataFrame, likert: DataFrame, ids: Sequence[str], skip: Sequence[str]) -> DataFrame:
    """Map every column but ``ids`` and ``skip`` by a literal label lookup: narrow, row by row.

    ``likert`` is the questionnaire's level table (at most ``LIKERT_MAX_LABELS`` labels,
    checked); unrecognised text becomes NULL.  Repeated ids stay rows of their own.
    """
    levels = likert_lookup(likert).limit(LIKERT_MAX_LABELS + 1).collect()
    if len(levels) > LIKERT_MAX_LABELS:
        raise ValueError(f"more than {LIKERT_MAX_LABELS} Likert labels")
    lookup = F.create_map(*[F.lit(x) for r in levels if r["label"] is not None for x in (r["label"], r["level"])])
    fixed = {*ids, *skip}
    return wide.select(*[F.col(f"`{c}`") if c in fixed else
                         F.try_element_at(lookup, S.strip_whitespace(F.col(f"`{c}`").cast("string"))).alias(c)
                         for c in wide.columns])
