"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Rows are joined back to their verdicts by id (null-safe) and a hash of the text, so rows
that repeat an id stand for themselves.  Columns beside those of ``documents`` are dropped
by the first stage; an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, simhash, substring_dedup
from . import quality_rules as quality
from .common import prepare, table, written
from .queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a learned rule rejects go (so do null and blank texts)."""
    prepare(spark)
    d = _hashed(docs)
    counts = written(quality.base_counts(d, also=("text_hash",)), "stage-quality")
    kept = quality.quality_rules(counts, table(spark, sf_dir, "labels")).where("kept").select("doc_id", "text_hash")
    return d.alias("d").join(kept.alias("k"), _same("d", "k"), "left_semi").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: of those with the smallest id the one with the least text hash.

    A row without an id stays only if nothing with an id is in its group.
    """
    prepare(spark)
    d = _hashed(docs)
    groups = simhash.simhash_groups(d, shingle=4, radius=4, also=("text_hash",), rooted=True)
    # by root, as groups that hold the same id have the same component_id
    named = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id")
             .agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash"))
    kept = d.alias("d").join(named.alias("k"), _same("d", "k"), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; texts that lose words become the kept words joined by one space.

    A document that loses all its words goes; one without words stays as it is.
    """
    prepare(spark)
    d = _hashed(docs)
    cut = substring_dedup.substring_dedup(d, window=50).select("doc_id", "text_hash", "n_words", "n_removed", "kept_text")
    cut = cut.where("n_removed > 0").dropDuplicates(["doc_id", "text_hash"])
    joined = d.alias("d").join(cut.alias("c"), _same("d", "c"), "left").where("c.n_words IS NULL OR c.n_removed < c.n_words")
    text = F.coalesce("c.kept_text", "d.text")
    return joined.select("d.doc_id", text.alias("text"), "d.lang", "d.source",
                         F.when(F.col("c.kept_text").isNull(), F.col("d.n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed: a document comes once per epoch, and again if the fraction takes half of it or more."""
    prepare(spark)
    d = _hashed(docs)
    copies = F.col("epochs") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")
    mixed = mixing.mix(d, also=("text_hash",)).select("doc_id", "text_hash", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))
    mixed = mixed.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies")).where("copies > 0")
    once = d.dropDuplicates(["doc_id", "text_hash"])
    return (once.alias("d").join(mixed.alias("m"), _same("d", "m")).select("d.*", F.explode(F.expr("sequence(1L, m.copies)")))
            .select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens are packed; returns the pieces and their places."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]
