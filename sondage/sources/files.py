"""File sources: raw CSV exports, question maps, encoding audit, config and Likert dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings the CSV reader accepts for the audit's verdicts.
UTF8 = "UTF-8"
LATIN1 = "ISO-8859-1"
WINDOWS = "windows-1252"


def _csv(spark: SparkSession, multiline: bool, encoding: str = UTF8):
    """A CSV reader with standard quoting: a doubled quote is a quote; ``multiline`` lets cells hold line ends."""
    return (spark.read.option("encoding", encoding).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline))


def read_header(spark: SparkSession, path: str, encoding: str = UTF8, multiline: bool = False) -> list[str]:
    """The raw header fields of a CSV file (BOM removed), parsed with CSV quoting rules."""
    row = (_csv(spark, multiline, encoding).option("header", False).csv(path).limit(1).collect() or [None])[0]
    if row is None:
        return []
    return [(v or "").lstrip("\ufeff").strip('"') if i == 0 else v or "" for i, v in enumerate(row)]


def csv_clean(spark: SparkSession, path: str, headers_to_replace: Mapping[str, str] | None = None,
              columns_to_drop: Sequence[str] = (), output: str | None = None, multiline: bool = False) -> DataFrame:
    """Strip header names, rename by dict, drop blank / listed headers (every matching position).

    Data are read as strings (no inference).  ``multiline`` reads cells that hold line
    breaks (a file is then not split).  When ``output`` is given the cleaned table is
    also written there as CSV with a header.
    """
    headers_to_replace = headers_to_replace or {}
    raw = [h.strip() for h in read_header(spark, path, multiline=multiline)]
    names = [headers_to_replace.get(h, h) for h in raw]
    df = _csv(spark, multiline).option("header", True).csv(path)
    positional = [f"_p{i}" for i in range(len(df.columns))]
    df = df.toDF(*positional)
    keep = [(p, n) for p, n in zip(positional, names) if n and n not in set(columns_to_drop)]
    out = df.select(*[F.col(p).alias(n) for p, n in keep])
    if output:
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(output)
    return out


def select_all_columns(spark: SparkSession, path: str) -> DataFrame:
    """Fourth field of every line whose third field is 'ALL' (plain comma split, header included)."""
    parts = F.split(F.trim(F.col("value")), ",")
    return (spark.read.text(path).where(F.size(parts) >= 4)
            .where(F.element_at(parts, 3) == "ALL").select(F.element_at(parts, 4).alias("column_name")))


def combine_files(spark: SparkSession, paths: Sequence[str], column_mapping: Mapping[str, str],
                  output: str | None = None, multiline: bool = False) -> DataFrame:
    """Stack CSV files keeping only mappable columns, renamed; skip unreadable / unmappable files."""
    frames = []
    for p in paths:
        try:
            df = _csv(spark, multiline).option("header", True).csv(p)
        except Exception:  # noqa: BLE001 - a missing or unreadable file is skipped
            continue
        cols = [c for c in df.columns if c in column_mapping]
        if not cols:
            continue
        frames.append(df.select(*[F.col(f"`{c}`").alias(column_mapping[c]) for c in cols]))
    if not frames:
        return spark.createDataFrame([], "placeholder string").drop("placeholder")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if output:
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(output)
    return out


def encoding_audit(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, n_bytes, encoding) of each plain file from all its bytes, as one Spark job over splits of all files.

    Files are read by line, as bytes: a line end is a byte of its own in UTF-8, so a file is
    valid UTF-8 if its lines are, and any number of splits and tasks may judge it.  A cell holds a line, not a
    file.  In this order: a byte order mark (UTF-8-SIG, UTF-16); a tenth or more NUL bytes (UTF-16LE
    or UTF-16BE, by the place of the first one); valid UTF-8; bytes 80 to 9F, which are
    letters and signs in Windows-1252 only; else ISO-8859-1.  Spark's readers pass over empty files.
    """
    files = spark.read.format("binaryFile").load(path_glob).select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("n_bytes"))
    raw = spark.read.option("lineSep", "\n").text(path_glob)
    size = F.octet_length("value")
    valid = F.is_valid_utf8("value")
    latin = F.decode(F.col("value").cast("binary"), LATIN1)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start"), "value").select(
        "file", F.struct(F.col("file_block_start"), F.monotonically_increasing_id().alias("row"),
                         F.hex(F.substring(F.col("value").cast("binary"), 1, 4)).alias("head")).alias("place"),
        size.alias("size"), (size - F.octet_length(F.replace("value", F.lit("\x00"), F.lit("")))).alias("nul"), valid.alias("valid"),
        (~valid & latin.rlike("[\u0080-\u009f]")).alias("signs"))
    stats = lines.groupBy("file").agg(F.min("place")["head"].alias("head"), (F.sum("size") + F.count(F.lit(1))).alias("seen"), F.sum("nul").alias("nul"),
                                      F.bool_and("valid").alias("valid"), F.bool_or("signs").alias("signs"))
    # the line reader takes off a UTF-8 byte order mark: three bytes are missing (one may be counted for a missing last line end)
    encoding = (F.when(F.col("n_bytes") - F.coalesce("seen", F.lit(0)) >= 2, "UTF-8-SIG")
                .when(F.col("head").startswith("FFFE") | F.col("head").startswith("FEFF"), "UTF-16")
                .when(F.col("nul") * 10 >= F.col("n_bytes"), F.when(F.col("head").startswith("00"), "UTF-16BE").otherwise("UTF-16LE"))
                .when(F.col("valid"), UTF8).when(F.col("signs"), WINDOWS).otherwise(LATIN1))
    return files.join(stats, "file", "left").select("path", "n_bytes", encoding.alias("encoding"))


def config_dim(spark: SparkSession, path: str) -> DataFrame:
    """Study config JSON -> question_dim(role, question): one row per listed column."""
    raw = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in raw.schema.fields if f.dataType.simpleString().startswith("array")]
    if not lists:
        return spark.createDataFrame([], "role string, question string")
    stacked = raw.select(F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.col(f"`{k}`").alias("qs"))
                                             for k in lists])).alias("s"))
    return stacked.select(F.col("s.role").alias("role"), F.explode("s.qs").alias("question"))


def likert_dim(spark: SparkSession, path: str) -> DataFrame:
    """Likert levels JSON {"level_1": [...], ...} -> (level int, label string), first level wins later."""
    raw = spark.read.option("multiLine", True).json(path)
    keys = [f.name for f in raw.schema.fields if f.name.startswith("level_")]
    stacked = raw.select(F.explode(F.array(*[F.struct(F.lit(int(k.split("_")[1])).alias("level"),
                                                      F.col(k).alias("labels")) for k in keys])).alias("s"))
    return stacked.select("s.level", F.explode("s.labels").alias("label"))
