"""Registered text queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import read_table
from ..functions.scalar import PY_WHITESPACE as WS
from ..operators import text as X
from .registry import query

MIN_FREQ = 5  # occurrences that make a word of the documents a dictionary word


def dictionary(spark, sf, min_freq: int = MIN_FREQ):
    """Spelling dictionary: document words seen at least ``min_freq`` times."""
    return X.word_counts(read_table(spark, sf, "documents"), "text").where(F.col("freq") >= min_freq)


@query("spell_summary", views=())
def spell_summary(spark, sf):
    return X.spell_summary(read_table(spark, sf, "conversations"), ["text"], dictionary(spark, sf))


def memory(spark, sf):
    """Translation memory: French documents of sources src0-src4 with their stored translation."""
    d = read_table(spark, sf, "documents")
    return d.where((F.col("lang") == "fr") & (F.col("source") < "src5")).select(
        "lang", "text", F.concat(F.lit("[en] "), F.upper("text")).alias("translated"))


@query("translate_tm", f"""
WITH tm AS (SELECT lang, text, MIN('[en] ' || upper(text)) AS translated FROM documents
            WHERE lang = 'fr' AND source < 'src5' GROUP BY lang, text)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
  CASE WHEN d.text IS NULL OR regexp_replace(d.text, '\\A{WS}+|{WS}+\\z', '', 'g') = '' THEN ''
       WHEN d.lang = 'fr' THEN COALESCE(tm.translated, d.text) ELSE d.text END AS text_translated
FROM documents d LEFT JOIN tm ON tm.lang = d.lang AND tm.text = d.text""", views=())
def translate_tm(spark, sf):
    return X.translate_tm(read_table(spark, sf, "documents"), "text", "lang", "fr", memory(spark, sf))


@query("translate_tm_api", f"""
WITH tm AS (SELECT lang, text, MIN('[en] ' || upper(text)) AS translated FROM documents
            WHERE lang = 'fr' AND source < 'src5' GROUP BY lang, text)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
  CASE WHEN d.text IS NULL THEN NULL
       WHEN lower(regexp_replace(d.text, '\\A{WS}+|{WS}+\\z', '', 'g')) IN ('', 'nan', 'none') THEN d.text
       ELSE COALESCE(tm.translated, d.text) END AS text_translated
FROM documents d LEFT JOIN tm ON tm.text = d.text""", views=())
def translate_tm_api(spark, sf):
    return X.translate_tm(read_table(spark, sf, "documents"), "text", None, "fr", memory(spark, sf),
                          check_language=False)


def _themes(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return X.theme_analysis(docs, "doc_id", ["text"], save_name="documents", labels=["documents.text"])


@query("themes", views=())
def themes(spark, sf):
    return _themes(spark, sf)["themes"]


@query("theme_assign", views=())
def theme_assign(spark, sf):
    return _themes(spark, sf)["assignments"]


@query("theme_summary", views=())
def theme_summary(spark, sf):
    return _themes(spark, sf)["exemplars"]


@query("theme_dictionary", views=())
def theme_dictionary(spark, sf):
    return _themes(spark, sf)["dictionary"]
