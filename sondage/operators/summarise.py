"""Frequency summaries: Likert counts, box scores, crosstabs, JAR / CATA / MaxDiff tables.

Every per-column loop of the reference is a grouping key here.  Inputs are the
wide response table with a ``product`` column; each operator unpivots once and
runs ONE aggregation keyed by (product, question[, value]).  Those keys have
low cardinality, so the partial (map-side) aggregate collapses each task's
rows to at most products x questions x levels before the shuffle: a hot product
or question cannot skew the exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .reshape import long_form

# Box-score definitions (levels counted, as percent of answers).
BOX_METRICS = [
    ("Bottom Box", [1]),
    ("% B2B", [1, 2]),
    ("% B4B", [1, 2, 3, 4]),
    ("% Middle", [3]),
    ("% T2B", [4, 5]),
    ("% T3B", [3, 4, 5]),
    ("% T4B", [7, 8, 9, 10]),
    ("Top Box", [5]),
    ("% TT2B", [9, 10]),
    ("% TB2B", [1, 2]),
]
JAR_CATEGORIES = [("Too Little", [1, 2]), ("JAR", [3]), ("Too Much", [4, 5])]


def _long(wide: DataFrame, columns: Sequence[str], group: Sequence[str], ids=()) -> DataFrame:
    return long_form(wide, [*ids, *group], columns)


def freq(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ("product",)) -> DataFrame:
    """(group, question, value, n): answered counts per level, NULL excluded."""
    return (_long(wide, columns, group).where(F.col("score").isNotNull())
            .groupBy(*group, "question", F.col("score").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def answer_counts(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ("product",)) -> DataFrame:
    """(group, question, score, n): rows per answer, missing ones (score NULL) included.

    What the reports of a study share: ``counts=`` of the operators takes it in place of the table.
    """
    return _long(wide, columns, group).groupBy(*group, "question", "score").agg(F.count(F.lit(1)).alias("n"))


def _counts(wide: DataFrame, columns: Sequence[str], group: Sequence[str], counts: DataFrame | None) -> DataFrame:
    return answer_counts(wide, columns, group) if counts is None else counts.where(F.col("question").isin(list(columns)))


def _level_grid(wide: DataFrame, columns: Sequence[str], group: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Counts on the union of levels of all columns, zero-filled: (group, question, value, n).

    Built as a pivot by question (explicit column list) and an unpivot back, so
    the zero cells come from the pivot rather than a cross join.
    """
    answered = _counts(wide, columns, group, counts).where(F.col("score").isNotNull())
    piv = (answered.groupBy(*group, F.col("score").alias("value")).pivot("question", list(columns))
           .agg(F.sum("n")).na.fill(0, subset=list(columns)))
    return piv.unpivot([*group, "value"], list(columns), "question", "n")


def likert_counts(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ("product",),
                  counts: DataFrame | None = None) -> DataFrame:
    """Counts per level plus a Total row; percent of Total rounded half-even to 0 dp."""
    grid = _level_grid(wide, columns, group, counts)
    w = Window.partitionBy(*group, "question")
    grid = grid.withColumn("total", F.sum("n").over(w))
    levels = grid.select(*group, "question", F.col("value").cast("string").alias("level"),
                         F.col("n").alias("count"), "total")
    totals = grid.groupBy(*group, "question").agg(F.sum("n").alias("count")).select(
        *group, "question", F.lit("Total").alias("level"), "count", F.col("count").alias("total"))
    out = levels.unionByName(totals)
    pct = F.bround(F.try_divide(F.col("count") * 100.0, F.col("total")), 0)
    return out.select(*group, "question", "level", F.col("count").cast("long").alias("count"),
                      pct.alias("percentage"))


def box_scores(wide: DataFrame, five: Sequence[str], ten: Sequence[str],
               group: Sequence[str] = ("product",), counts: DataFrame | None = None) -> DataFrame:
    """Long (group, question, metric, value): ten box metrics per column, Mean for 10-point.

    Percent of non-null answers; an all-null column gives NULL, not 0/0.
    """
    cols = list(dict.fromkeys([*five, *ten]))
    s, n = F.col("score"), F.col("n")
    base = F.sum(F.when(s.isNotNull(), n))  # NULL without answers
    aggs = [F.try_divide(F.sum(F.when(s.isin([float(x) for x in lv]), n).otherwise(0)) * 100.0, base)
            .alias(name) for name, lv in BOX_METRICS]
    aggs.append(F.try_divide(F.sum(s * n), base).alias("Mean"))
    per = _counts(wide, cols, group, counts).groupBy(*group, "question").agg(*aggs)
    metrics = [m for m, _ in BOX_METRICS]
    out = per.unpivot([*group, "question"], metrics + ["Mean"], "metric", "value")
    return out.where((F.col("metric") != "Mean") | F.col("question").isin(list(ten)))


def one_pager(box: DataFrame, metric: str, products: Sequence[str]) -> DataFrame:
    """Question x product table of one box metric (the 1-pager comparison)."""
    return (box.where(F.col("metric") == metric).groupBy(F.col("question").alias("comparison"))
            .pivot("product", list(products)).agg(F.first("value")))


def box_appended(wide: DataFrame, five: Sequence[str], ten: Sequence[str], ids: Sequence[str],
                 group: str = "product") -> DataFrame:
    """Detail rows followed by labelled summary rows (counts, percents, boxes, Mean).

    The label lives in ``row_label``; summary rows carry the per-column values
    pivoted back to the wide layout.
    """
    cols = list(dict.fromkeys([*five, *ten]))
    grid = _level_grid(wide, cols, [group])
    tot = grid.groupBy(group, "question").agg(F.sum("n").alias("total"))
    counts = grid.select(group, "question", F.concat(F.lit("Summary_"), F.col("value").cast("string"))
                         .alias("row_label"), F.col("n").cast("double").alias("v"))
    counts_t = tot.select(group, "question", F.lit("Summary_Total").alias("row_label"),
                          F.col("total").cast("double").alias("v"))
    g2 = grid.join(tot, [group, "question"])
    pcts = g2.select(group, "question", F.concat(F.lit("Percentage_"), F.col("value").cast("string"))
                     .alias("row_label"), F.try_divide(F.col("n") * 100.0, F.col("total")).alias("v"))
    pct_t = tot.select(group, "question", F.lit("Percentage_Total").alias("row_label"),
                       F.when(F.col("total") > 0, F.lit(100.0)).alias("v"))
    box = box_scores(wide, five, ten, [group]).select(group, "question", F.col("metric").alias("row_label"),
                                                       F.col("value").alias("v"))
    summ = counts.unionByName(counts_t).unionByName(pcts).unionByName(pct_t).unionByName(box)
    summ_wide = summ.groupBy(group, "row_label").pivot("question", cols).agg(F.first("v"))
    detail = wide.select(F.concat_ws("|", *[F.col(i).cast("string") for i in ids]).alias("row_label"),
                         group, *[F.col(c).cast("double").alias(c) for c in cols])
    return detail.unionByName(summ_wide)


def crosstab(wide: DataFrame, pairs: Mapping[str, Sequence[str]], group: Sequence[str] = ("product",)
             ) -> DataFrame:
    """Long contingency counts (group, name, value1, value2, n); NULL on either side excluded.

    Pairs that do not name exactly two existing columns are skipped; without any other no rows.
    """
    parts = []
    for name, cols in pairs.items():
        if len(cols) != 2 or any(c not in wide.columns for c in cols):
            continue
        a, b = cols
        parts.append(wide.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                     .groupBy(*group, F.col(a).cast("double").alias("value1"),
                              F.col(b).cast("double").alias("value2"))
                     .agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)))
    if not parts:
        empty = wide.where(F.lit(False))
        return empty.select(*group, F.lit("").alias("name"), *[F.lit(0.0).alias(v) for v in ("value1", "value2")], F.lit(0).cast("long").alias("n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*group, "name", "value1", "value2", "n")


def value_summary(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ("product",),
                  fraction: bool = False, total_row: bool = False) -> DataFrame:
    """Value counts INCLUDING NULL; percent of all rows (x100, or a fraction when pooled)."""
    for c in columns:
        if c not in wide.columns:
            raise ValueError(f"Column '{c}' not found.")
    lng = wide.select(*group, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(group), list(columns), "question", "value")
    cnt = lng.groupBy(*group, "question", "value").agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy(*group, "question"))
    scale = 1.0 if fraction else 100.0
    out = cnt.withColumn("pct", F.col("count") * scale / tot)
    if total_row:
        totals = cnt.groupBy(*group, "question").agg(F.sum("count").alias("count")).select(
            *group, "question", F.lit("Total").alias("value"), "count", F.lit(1.0).alias("pct"))
        out = out.unionByName(totals)
    return out.select(*group, "question", "value", F.col("count").cast("long").alias("count"), "pct")


def pooled_summary(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All product tables pooled: counts incl. NULL, fraction of rows, and a Total row."""
    return value_summary(wide, columns, group=(), fraction=True, total_row=True)


def jar_5pt(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ("product",),
            counts: DataFrame | None = None) -> DataFrame:
    """Percent per level (union of levels, zero-filled), denominator = answered rows."""
    grid = _level_grid(wide, columns, group, counts)
    tot = F.sum("n").over(Window.partitionBy(*group, "question"))
    return grid.select(*group, "question", "value",
                       F.try_divide(F.col("n") * 100.0, tot).alias("pct"))


def jar_3pt(wide: DataFrame, columns: Sequence[str], abbreviations: Mapping[str, str] | None = None,
            group: Sequence[str] = ("product",), base: str = "all", counts: DataFrame | None = None) -> DataFrame:
    """Too Little {1,2} / JAR {3} / Too Much {4,5}; denominator = all rows (NULL included)."""
    abbreviations = abbreviations or {}
    s, n = F.col("score"), F.col("n")
    den = F.sum("n") if base == "all" else F.sum(F.when(s.isNotNull(), n))
    aggs = [F.try_divide(F.sum(F.when(s.isin([float(x) for x in lv]), n).otherwise(0)) * 100.0, den)
            .alias(name) for name, lv in JAR_CATEGORIES]
    per = _counts(wide, columns, group, counts).groupBy(*group, "question").agg(*aggs)
    amap = F.create_map(*[F.lit(x) for kv in abbreviations.items() for x in kv]) if abbreviations else None
    label = F.coalesce(amap[F.col("question")], F.col("question")) if amap is not None else F.col("question")
    return per.unpivot([*group, "question"], [n for n, _ in JAR_CATEGORIES], "category", "pct").select(
        *group, label.alias("attribute"), "category", "pct")


def cata_counts(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ("product",),
                trim: bool = False) -> DataFrame:
    """Token counts over comma-split cells (no trim; duplicates count twice); percent of answered rows."""
    parts = []
    for c in columns:
        x = wide.where(F.col(c).isNotNull())
        toks = x.select(*group, F.explode(F.split(F.col(c), ",")).alias("attribute"))
        if trim:
            toks = toks.withColumn("attribute", F.trim("attribute"))
        cnt = toks.groupBy(*group, "attribute").agg(F.count(F.lit(1)).alias("count"))
        if group:
            joined = cnt.join(x.groupBy(*group).agg(F.count(F.lit(1)).alias("_base")), list(group))
        else:
            joined = cnt.withColumn("_base", x.select(F.count(F.lit(1))).scalar())
        parts.append(joined.select(*group, F.lit(c).alias("question"), S.cata_sheet_name(F.lit(c)).alias("sheet"),
                                   "attribute", F.col("count").cast("long").alias("count"),
                                   (F.col("count") * 100.0 / F.col("_base")).alias("percentage")))
    if not parts:
        return wide.where(F.lit(False)).select(*group, *[F.lit("").alias(c) for c in ("question", "sheet", "attribute")],
                                               F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("percentage"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _maxdiff_tokens(wide: DataFrame, columns: Sequence[str], group: Sequence[str]) -> DataFrame:
    lng = wide.select(*group, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(group), list(columns), "question", "cell").where(F.col("cell").isNotNull())
    cells = lng.groupBy(*group, "question", "cell").agg(F.count(F.lit(1)).alias("n"))  # equal cells are cut once
    return cells.select(*group, "question", "n", F.explode(F.split("cell", ",")).alias("tok"))


def maxdiff_malformed(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, question, tokens, malformed): all MaxDiff tokens, and those without a colon, which count nowhere."""
    toks = _maxdiff_tokens(wide, columns, group)
    return toks.groupBy(*group, "question").agg(
        F.sum("n").alias("tokens"), F.sum(F.when(~F.col("tok").contains(":"), F.col("n")).otherwise(0)).alias("malformed"))


def maxdiff(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Most (M) / Least (L) counts per attribute over all MaxDiff cells; Net = M - L.

    Tokens without a colon cannot be split and are skipped (``maxdiff_malformed`` counts them).
    """
    toks = _maxdiff_tokens(wide, columns, group)
    attr, choice = S.rsplit_colon(F.col("tok"))
    toks = toks.select(*group, "n", S.strip_whitespace(attr).alias("attribute"), S.strip_whitespace(choice).alias("choice"))
    agg = (toks.where(F.col("attribute").isNotNull()).groupBy(*group, "attribute")
           .agg(F.sum(F.when(F.col("choice") == "M", F.col("n")).otherwise(0)).cast("long").alias("most"),
                F.sum(F.when(F.col("choice") == "L", F.col("n")).otherwise(0)).cast("long").alias("least")))
    agg = agg.where((F.col("most") > 0) | (F.col("least") > 0))
    return agg.withColumn("net_score", F.col("most") - F.col("least")).orderBy(
        F.desc("net_score"), "attribute")


def maxdiff_quadrant(md: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Quadrant of each attribute, split at half the maximum of each axis."""
    if group:
        w = Window.partitionBy(*group)
        hm, hl = F.max("most").over(w) / 2.0, F.max("least").over(w) / 2.0
    else:  # scalar subqueries: no single-partition window
        hm = md.select(F.max("most")).scalar() / 2.0
        hl = md.select(F.max("least")).scalar() / 2.0
    q = (F.when((F.col("most") >= hm) & (F.col("least") < hl), "High M / Low L")
         .when((F.col("most") >= hm) & (F.col("least") >= hl), "High M / High L")
         .when((F.col("most") < hm) & (F.col("least") >= hl), "Low M / High L")
         .otherwise("Low M / Low L"))
    return md.select("*", hm.alias("most_split"), hl.alias("least_split"), q.alias("quadrant"))
