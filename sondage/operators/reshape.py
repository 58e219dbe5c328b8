"""Reshaping: EAV pivots with synonym normalisation, wide <-> long, dummies.

The reference pivots scores and the blind code in two scans joined by a FULL
OUTER JOIN.  Here both blocks come from ONE scan and ONE hash aggregation on
the composite key (``max(CASE WHEN attribute = a ...)``): one exchange instead
of three.  FULL OUTER JOIN semantics are preserved exactly:

* a key appears if it has any scored row or any code row (T21: a key whose
  scored attributes all fall outside the pivot list still yields an all-null
  row; a code row with a NULL answer still keeps its key);
* rows whose key has a NULL part never match across blocks in a join, so for
  those (rare) keys the two blocks are aggregated separately and unioned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EAV_KEYS = ("customerid", "productname", "missiondesc")
CODE_ATTRIBUTE = "Product-3DigitCode-"

# ---------------------------------------------------------------------------
# The pivot lists and synonym map of the shipped pivot queries.
# ---------------------------------------------------------------------------
VISIT1_VISITS = ["Visit 1", "Visit 5", "Visit 9"]
VISIT1_PRODUCTS = ["Product_A"]
VISIT1_ATTRIBUTES = [
    "Pack functionality-Experience-Tamper evidence reassurance",
    "Pack functionality-Experience-Easy to Store",
    "Pack functionality-Experience-Safety and Hygiene",
]
VISIT3_VISITS = ["Visit 3", "Visit 7", "Visit 11"]
VISIT3_PRODUCTS = [f"Product_{c}" for c in "ABCDEFGHIJKLMNOPQRS"]
VISIT3_ATTRIBUTES = [
    # core attributes
    "Product sensory and consumption-Experience-Overall taste",
    "Overall Opinion-Liking-Product",
    "Overall Opinion-Retrial-Product",
    "Preparation-Experience-Easy to dissolve in water",
    "Product sensory and consumption-Experience-Right level of sweetness",
    "Product sensory and consumption-Experience-Appearance of the powder",
    "Product sensory and consumption-Experience-Colour of the powder",
    "Product sensory and consumption-Experience-Texture of the powder",
    "Product sensory and consumption-Experience-Appearance appeal",
    "Product sensory and consumption-Experience-Aroma appeal powder",
    "Product sensory and consumption-Experience-Aroma appeal liquid",
    "Product sensory and consumption-Experience-Level of foam",
    "Product sensory and consumption-Experience-Amount of lumps",
    "Product sensory and consumption-Experience-Agreeable or pleasant to taste",
    "Product Benefits-Agreement-Good choice for daily use",
    "Product Benefits-Agreement-Acceptable odour after emptying bottle",
    "Product Benefits-Agreement-Leaves the bottle easy to clean",
    "Product Benefits-Agreement-Consume their required volume",
    "Preparation-Retrial-Preparation and mixing experience",
    # study-specific attributes
    "Product Benefits-Agreement-Like Taste",
    "Product sensory and consumption-Experience-Strength of aroma powder",
    "Product sensory and consumption-Experience-Strength of prepared product",
    "Product sensory and consumption-Experience-Thickness",
    "Product Benefits-Agreement-Reassured that my baby gets the nutrition they need",
    "Product Benefits-Agreement-Excellent preparation experience",
    "Product Benefits-Agreement-Fits into daily routine",
    "Product sensory and consumption-Experience-Colour of prepared product",
    "Product Benefits-Agreement-Easy to transfer from regular formula",
    # unified synonym columns
    "Product Benefits-Agreement-Would accept",
    "Product Benefits-Agreement-Enjoyment",
    "Product Benefits-Agreement-Safe for my",
    "Product Benefits-Agreement-Likely to finish a bottle",
]
VISIT3_SYNONYMS = {
    "Product Benefits-Agreement-Baby will accept": "Product Benefits-Agreement-Would accept",
    "Product Benefits-Agreement-Baby would accept": "Product Benefits-Agreement-Would accept",
    "Product Benefits-Agreement-Child would accept": "Product Benefits-Agreement-Would accept",
    "Product Benefits-Agreement-Enjoyment": "Product Benefits-Agreement-Enjoyment",
    "Product Benefits-Agreement-Enjoyed by child": "Product Benefits-Agreement-Enjoyment",
    "Product Benefits-Agreement-Safe for my baby": "Product Benefits-Agreement-Safe for my",
    "Product Benefits-Agreement-Safe for my child": "Product Benefits-Agreement-Safe for my",
    "Product Benefits-Agreement-Child likely to finish a bottle":
        "Product Benefits-Agreement-Likely to finish a bottle",
    "Product Benefits-Agreement-Baby likely to finish a bottle":
        "Product Benefits-Agreement-Likely to finish a bottle",
}


def _scope(eav: DataFrame, visits: Sequence[str] | None, products: Sequence[str] | None) -> DataFrame:
    if visits is not None:
        eav = eav.where(F.col("missiondesc").isin(list(visits)))
    if products is not None:
        eav = eav.where(F.col("productname").isin(list(products)))
    return eav


def unify_attribute(col: Column, synonyms: Mapping[str, str] | None) -> Column:
    """CASE synonym map with pass-through ELSE (a literal map lookup)."""
    if not synonyms:
        return col
    m = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.coalesce(m[col], col)


def synonym_map(eav: DataFrame, synonyms: Mapping[str, str], visits=None, products=None,
                code_attribute: str = CODE_ATTRIBUTE, keys=EAV_KEYS) -> DataFrame:
    """The ``Mapped`` step: scored, non-code rows with the unified attribute."""
    base = _scope(eav, visits, products).where(
        F.col("answerscore").isNotNull() & (F.col("attribute") != code_attribute))
    return base.select(*keys, unify_attribute(F.col("attribute"), synonyms).alias("attribute"),
                       "answerscore")


def synonym_collapse(mapped: DataFrame, agg: str = "max", keys=EAV_KEYS) -> DataFrame:
    """The ``Collapsed`` step: one row per key and unified attribute."""
    fn = {"max": F.max, "avg": F.avg}[agg]
    return mapped.groupBy(*keys, "attribute").agg(fn("answerscore").alias("answerscore"))


def pivot_eav(eav: DataFrame, attributes: Sequence[str], *, visits=None, products=None,
              synonyms: Mapping[str, str] | None = None, collapse: str = "max",
              code_attribute: str | None = CODE_ATTRIBUTE, keys=EAV_KEYS) -> DataFrame:
    """EAV -> wide: scores pivoted by MAX, blind code by string MAX, full-outer semantics.

    ``collapse`` is how synonym rows of one key combine before the pivot
    (``max`` as shipped, ``avg`` the documented alternative); MAX of one value
    per cell makes both a single aggregation.
    """
    keys = list(keys)
    attr = unify_attribute(F.col("attribute"), synonyms)
    scored = F.col("answerscore").isNotNull()
    if code_attribute is not None:
        scored = scored & (F.col("attribute") != code_attribute)
        is_code = F.col("attribute") == code_attribute
    else:
        is_code = F.lit(False)
    fn = {"max": F.max, "avg": F.avg}[collapse]
    src = _scope(eav, visits, products).where(scored | is_code).select(
        *keys, attr.alias("_attr"), "answerscore", "answer",
        scored.alias("_scored"), is_code.alias("_code"))
    score_cols = [fn(F.when(F.col("_scored") & (F.col("_attr") == a), F.col("answerscore"))).alias(a)
                  for a in attributes]
    code_cols = ([F.max(F.when(F.col("_code"), F.col("answer"))).alias(code_attribute)]
                 if code_attribute is not None else [])

    # One grouping for both blocks.  ``_blk`` is 0 for fully non-null keys (the
    # blocks meet, as the join would match them) and 1 / 2 for score / code rows
    # of keys with a NULL part (a join never matches those, so they stay apart).
    nonnull = F.lit(True)
    for k in keys:
        nonnull = nonnull & F.col(k).isNotNull()
    blk = F.when(nonnull, F.lit(0)).when(F.col("_scored"), F.lit(1)).otherwise(F.lit(2))
    out = src.withColumn("_blk", blk).groupBy(*keys, "_blk").agg(*score_cols, *code_cols)
    return out.drop("_blk")


def long_form(wide: DataFrame, ids: Sequence[str], questions: Sequence[str],
              question_col: str = "question", value_col: str = "score",
              drop_nulls: bool = False) -> DataFrame:
    """Wide -> long (``unpivot``); the per-column loops become a group key."""
    out = wide.select(*ids, *[F.col(q).cast("double").alias(q) for q in questions]).unpivot(
        list(ids), list(questions), question_col, value_col)
    return out.where(F.col(value_col).isNotNull()) if drop_nulls else out


def dichotomize(df: DataFrame, columns: Sequence[str], values: Sequence[float],
                keep: Sequence[str] = ()) -> DataFrame:
    """value in list -> 1, other non-null -> 0, null stays null."""
    vals = [float(v) for v in values]
    exprs = [F.when(F.col(c).isNull(), F.lit(None).cast("int"))
             .when(F.col(c).isin(vals), F.lit(1)).otherwise(F.lit(0)).alias(c)
             for c in columns if c in df.columns]
    return df.select(*keep, *exprs)


def explode_tokens(df: DataFrame, column: str, ids: Sequence[str], trim: bool = False,
                   token_col: str = "token") -> DataFrame:
    """Multi-select cell -> one row per comma token (no trim by default; empty tokens kept)."""
    tok = F.explode(F.split(F.col(column), ","))
    out = df.where(F.col(column).isNotNull()).select(*ids, tok.alias(token_col))
    return out.withColumn(token_col, F.trim(token_col)) if trim else out


def cata_dummies(df: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    """Binary indicator column ``<column>_<token>`` per distinct non-empty token.

    Same as splitting on ',' and one-hot encoding: a repeated token is still 1,
    a NULL cell is 0 everywhere, tokens are not trimmed.  One aggregation on the
    row key; the token list is the (small) distinct vocabulary, as Spark's own
    ``pivot`` would compute it.
    """
    ids = list(ids)
    exploded = df.select(*ids, F.explode_outer(F.split(F.col(column), ",")).alias("_tok"))
    vocab = sorted(r[0] for r in exploded.where(F.col("_tok") != "")
                   .select("_tok").distinct().collect())
    wide = (exploded.groupBy(*ids).pivot("_tok", vocab).agg(F.max(F.lit(1)))
            .na.fill(0, subset=vocab) if vocab else exploded.select(*ids).distinct())
    return wide.select(*ids, *[F.col(f"`{t}`").cast("int").alias(f"{column}_{t}") for t in vocab])

