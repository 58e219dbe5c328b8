"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of the corpus size by its weight, stopped at
``max_epochs`` times its own size, the excess going to the others by weight.  A
source is first taken in complete epochs; the rest of its target is drawn without
replacement: each document has an exponential key -ln(u) / quality, with u a hash
of its id, documents are sorted by key within their source and taken while the
prefix sum of sizes stays within the rest; the document at the edge is taken in part.

A source may hold any share of the rows, so its prefix sum is built in two steps:
sums per (source, key bucket) first, their running totals (one small row per
bucket), then sorted running totals inside a bucket.  A bucket is an equal part of
the distribution that the keys of the source have by the weights of its documents
(a mixture of exponentials over a histogram of the weights), so buckets stay even
and small whatever the weights are.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, n_words, written

BUCKET_ROWS = 2000  # documents of a bucket to aim at
WEIGHT_STEPS = 32  # steps of a quality weight in the histogram of a source
SEED = 7


def quality_weight(text: Column) -> Column:
    """0.25 to 1: by the share of characters that are neither symbols nor digits; 0.25 if null or empty."""
    n = F.length(text)
    plain = F.length(F.translate(text, "0123456789#*$%&|<>{}[]\\^~=+_@/", ""))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * plain / F.nullif(n, F.lit(0)), F.lit(0.25))


def key_buckets(sized: DataFrame) -> DataFrame:
    """``sized`` (source, quality, key) with the column ``bucket``, which ascends with the key in a source.

    A key is exponential with the rate ``quality``, so a key k is larger than a share of
    sum(p * (1 - exp(-k * w))) of its source, p being the share of the documents with weight
    w.  Weights are rounded down to steps; from 0.25 on a bucket is expected to hold at
    most 9/8 of ``BUCKET_ROWS``.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    keyed = sized.withColumn("name", name)
    step = F.greatest(F.floor(F.col("quality") * WEIGHT_STEPS), F.lit(1)) / WEIGHT_STEPS
    steps = keyed.groupBy("name", step.alias("w")).agg(F.count("*").alias("n"))
    model = written(steps.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("w", "n"))).alias("steps"), F.sum("n").alias("group_size")),
                    "mix-weights")
    below = F.aggregate("steps", F.lit(0.0), lambda acc, x: acc + x["n"] / F.col("group_size") * (1 - F.exp(-F.col("key") * x["w"])))
    buckets = F.ceil(F.col("group_size") / BUCKET_ROWS)
    return (join_groups(keyed, model, ["name"]).withColumn("bucket", F.floor(below * buckets).cast("long"))
            .drop("name", "steps", "group_size"))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """(source, source_size) -> the same plus ``target``.

    Stopping at the cap and sharing the excess again until none is above has a closed
    form: target = min(cap, level * weight).  With sources sorted by cap / weight, the
    first j are stopped and level = (total - their caps) / (weight of the others).
    One row per source is all that meets here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = (s.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", F.sum("source_size").over(everything).cast("double").alias("total"),
                 F.sum("weight").over(everything).alias("all_weight"),
                 F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps_before"),
                 F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"))
    level = (F.col("total") - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before"))
    s = s.withColumn("level", level)
    # the level of the first source that is not stopped holds for all after it
    open_ = s.withColumn("open", F.col("level") < F.col("ratio"))
    first = F.min(F.when(F.col("open"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    return open_.withColumn("final", first).select(
        "source", "source_size",
        F.when(F.col("final").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``also``, source, size, source_size, target, epochs, part, taken) for every row of ``docs``.

    ``epochs``: complete copies of the row; ``part``: its words taken in the fractional
    epoch (0 to size); ``taken`` = epochs * size + part.  A null source is a source of its
    own, a null or blank text has size 0 and takes nothing, sources without words have
    target 0.  Repeated rows and equal ids are rows of their own.  Reruns agree: a key
    depends on id and text alone, and equal keys differ in nothing that is returned.
    """
    text = F.col(text_col)
    u = (F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col), text), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    sized = written(docs.select(
        F.col(id_col).alias("id"), *also, F.col(source_col).alias("source"), n_words(text).alias("size"),
        quality_weight(text).alias("quality"), u.alias("u")).select("*", (-F.log("u") / F.col("quality")).alias("key")).drop("u"), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, max_epochs)
    targets = targets.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    d = written(key_buckets(sized), "mix-buckets")  # read twice below
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("start"))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    starts = starts.alias("s").join(targets.alias("t"), same).select(
        "s.source", "s.bucket", "s.start", "t.source_size", "t.target", "t.epochs", "t.rest")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
                          & (F.col("d.bucket") == F.col("s.bucket")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("start") - F.col("before"))).cast("long")
    return d.select(F.col("d.id").alias(id_col), *also, F.col("d.source").alias(source_col), "size", "source_size", "target",
                    "epochs", part.alias("part")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
