"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct text: the SHA-256 of the normalised text,
and the row that brought it first.  It is bucketed and sorted by digest and partitioned
by delivery.  New data goes through three steps, all over fixed-width rows:

1. digests: one scan of the texts; no text takes part in anything after it.
2. new digests are aggregated (map-side first, so a text with any number of copies is one
   row per task) into as many partitions as the index has buckets, and a sort-merge
   anti-join with the index keeps the unknown ones.  The index side is neither shuffled
   nor read beyond its digest column.
3. those are appended as the delivery's partition.  A delivery that failed half way is
   simply added again: its own partition is replaced, and only earlier ones count as known.

Only DataFrame functions are used.  Texts count as equal if their SHA-256 is.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import join_groups, shuffle_partitions, written

SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def digest_rows(docs: DataFrame, deliveries: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row, delivery) of every row, written once: the one pass over the texts.

    ``row`` numbers the rows.  Deliveries are ranges of ascending ids of equal width, rows
    without an id belong to the last one; ids that are no numbers make one delivery.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"),
                               F.monotonically_increasing_id().alias("row")), "dedup-digests")
    number = dict(rows.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    low, high = rows.agg(F.min("id"), F.max("id")).first() if number and deliveries > 1 else (None, None)
    if low is None or low == high:
        return rows.withColumn("delivery", F.lit(0).cast("long"))
    place = F.floor((F.col("id") - F.lit(low)).cast("double") / (high - low) * deliveries).cast("long")
    return rows.withColumn("delivery", F.least(F.coalesce(place, F.lit(deliveries)), F.lit(deliveries - 1)).cast("long"))


class DigestIndex:
    """The persistent index under ``path`` (a folder that all executors share).

    An existing one is opened with the number of buckets it was made with.  ``id_type`` is
    the SQL type of the ids.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.buckets = spark.read.parquet(f"{self.path}/_meta").first()["buckets"]
        except AnalysisException:  # no such folder: a new index
            self.buckets = buckets or shuffle_partitions(spark)
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{self.path}/_meta")
        # the folder of the number of buckets makes the index folder exist; its name is no partition's
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, keep_row BIGINT, delivery BIGINT) USING parquet"
                  f" PARTITIONED BY (delivery) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
                  f" LOCATION '{self.path}'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, "digest")  # as the index is bucketed: it needs no shuffle

    def unknown(self, rows: DataFrame, delivery: int) -> DataFrame:
        """(digest, keep_id, keep_row) of the texts that no earlier delivery brought.

        The smallest id keeps the text, of rows without an id any one; of repeated rows of
        that id, one.
        """
        groups = rows.groupBy("digest").agg(
            F.min("id").alias("keep_id"), F.coalesce(F.min_by("row", "id"), F.min("row")).alias("keep_row"))
        # one row per digest already: grouping again costs no shuffle, but keeps Catalyst from moving the
        # anti-join below the repartition, where the index would have to be shuffled instead
        dealt = self._dealt(groups).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min("keep_row").alias("keep_row"))
        known = self.table().where(F.col("delivery") < delivery).select("digest")
        return dealt.join(known.hint("merge"), "digest", "left_anti")

    def add(self, rows: DataFrame, delivery: int) -> None:
        """Append the texts of a delivery's ``digest_rows`` that the earlier ones lack."""
        fresh = self.unknown(rows, delivery).select("digest", "keep_id", "keep_row", F.lit(delivery).cast("long").alias("delivery"))
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")  # replaces this delivery's partition alone
        try:
            fresh.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """(id, digest, keep_id, group_size, kept) of every row of ``digest_rows``, all of them added before.

        ``keep_id``: the id that keeps the text; ``group_size``: rows of ``rows`` with that text;
        ``kept``: whether this is the row that stays, which holds for one row per text.
        """
        sizes = self._dealt(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")))
        index = self.table().withColumnRenamed("delivery", "keep_delivery")
        groups = written(sizes.join(index.hint("merge"), "digest"), "dedup-groups")
        kept = (F.col("row") == F.col("keep_row")) & (F.col("delivery") == F.col("keep_delivery"))
        return join_groups(rows, groups, ["digest"]).select("id", "digest", "keep_id", "group_size", kept.alias("kept"))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, deliveries: int = 2, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, digest, keep_id, group_size, kept) of every row of ``docs``.

    The rows enter the index (a new one unless given) in ``deliveries`` ranges of ascending ids,
    so that the smallest id keeps a text.  Given an index with earlier deliveries, a text
    known from these is kept by none of ``docs`` and its ``keep_id`` is the earlier one.
    A null text counts as empty, and blank texts are equal to one another (one space) but not to
    the empty text; a null id keeps a text only where no row with that text has an id; of
    rows that repeat both, one stays.  Other columns play no part; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = digest_rows(docs, deliveries, id_col, text_col)
    index = index or DigestIndex(spark, scratch_path(spark, "digest-index"), id_type=dict(rows.dtypes)["id"])
    last = index.table().agg(F.max("delivery")).first()[0]
    first = 0 if last is None else last + 1
    rows = rows.withColumn("delivery", F.col("delivery") + first)
    for delivery in range(first, first + deliveries):
        index.add(rows.where(F.col("delivery") == delivery), delivery)
    return index.resolve(rows).withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows of one id and text, one."""
    stay = exact_duplicates(docs, index, 1, id_col, text_col).where("kept").select(F.col(id_col).alias("_id"), F.col("digest").alias("_d"))
    d = docs.withColumn("_digest", text_digest(F.col(text_col)))
    kept = d.join(stay, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")), "left_semi")
    return kept.dropDuplicates([id_col, "_digest"]).drop("_digest")
