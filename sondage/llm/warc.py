"""WARC archives as a chunked record table.

An archive is a Parquet table of (record_no, record_id, chunk_no, n_chunks, data): the data
of a record's rows in order of chunk_no are the bytes of one WARC/1.1 record, and the rows
of all records in any order of records form a WARC file (``warc_bytes``).  A record that fits
one chunk is one row; a larger payload streams as further rows of at most ``chunk_bytes``.
No step builds a record from its chunks: digests are carried along the chunk rows.

write: digests of all payloads, chunk by chunk; equal payloads elect the smallest id as
       response, the others become revisits without payload; one join, then the rows.
read:  records of one row are read where they lie; rows of larger ones are dealt by record
       and sorted by chunk number, so that a task streams a record of any size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK_BYTES = 1 << 18
END = b"\r\n\r\n"


def chunks(body: str, n: str, chunk_bytes: int) -> Column:
    """Row generator over the chunk numbers of a body of n bytes (an empty one has one chunk)."""
    return F.explode(F.expr(f"sequence(0, cast(greatest(ceil({n} / {chunk_bytes}), 1) - 1 as int))"))


def _piece(body: str, chunk_bytes: int) -> Column:
    return F.expr(f"substring({body}, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, chunk_no, n_chunks, data) in order -> (id, bytes, sha1) at the last chunk of each payload."""
    digest, size = None, 0
    for b in batches:
        out: list[list] = [[], [], []]
        for id_, no, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if no == 0:
                digest, size = hashlib.sha1(), 0
            digest.update(data)
            size += len(data)
            if no == n - 1:
                for column, value in zip(out, (id_, size, digest.hexdigest()), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)],
                                         names=["id", "bytes", "sha1"])


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a digest in hexadecimal: five hexadecimal digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id",
                  url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one WARC record per row of ``pages`` and return the archive (a table in the shared folder).

    A null payload is empty; a null URL leaves its field out, line ends in one are escaped.
    Of equal payloads of at least ``min_bytes`` the row with the smallest id is the
    response (rows repeating that id too); rows with a null id are never referred to.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                     F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("body"))
    p = p.withColumn("n", F.length("body"))
    rows = p.select("id", "body", "n", chunks("body", "n", chunk_bytes).alias("chunk_no"))
    digests = written(rows.select(
        "id", "chunk_no", F.greatest(F.ceil(F.col("n") / chunk_bytes), F.lit(1)).cast("int").alias("n_chunks"),
        _piece("body", chunk_bytes).alias("data")).mapInArrow(_digests, "id long, bytes long, sha1 string"), "warc-digests")
    least = digests.where(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(F.min("id").alias("least"))
    kinds = (digests.distinct().join(written(least, "warc-responses"), ["sha1", "bytes"], "left")
             .select("id", "sha1", F.when(F.col("least") != F.coalesce("id", F.lit(-1)), F.col("least")).alias("refers_to")))

    p = p.withColumn("sha1", F.sha1("body")).alias("p").join(
        kinds.alias("k"), F.col("p.id").eqNullSafe(F.col("k.id")) & (F.col("p.sha1") == F.col("k.sha1"))).select("p.*", "k.refers_to")
    p = p.withColumn("body", F.when(F.col("refers_to").isNull(), F.col("body")).otherwise(F.lit(b"")))
    p = p.withColumn("n", F.length("body"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.when(F.col("refers_to").isNull(), F.lit("WARC-Type: response")).otherwise(F.lit("WARC-Type: revisit")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.when(F.col("refers_to").isNotNull(), F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            name(F.col("refers_to")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.col("n").cast("string")), F.lit("\r\n"))
    n_chunks = F.greatest(F.ceil(F.col("n") / chunk_bytes), F.lit(1)).cast("int")
    # the number tells repeated rows apart; it is written at once, so it is drawn once
    rows = p.select(F.monotonically_increasing_id().alias("record_no"), "id", "sha1", "refers_to", "url", "body", "n",
                    n_chunks.alias("n_chunks")).select("*", chunks("body", "n", chunk_bytes).alias("chunk_no"))
    data = F.concat(F.when(F.col("chunk_no") == 0, F.encode(header, "UTF-8")).otherwise(F.lit(b"")),
                    _piece("body", chunk_bytes),
                    F.when(F.col("chunk_no") == F.col("n_chunks") - 1, F.lit(END)).otherwise(F.lit(b"")))
    return written(rows.select("record_no", F.col("id").alias("record_id"), "chunk_no", "n_chunks", data.alias("data")), "warc-archive")


RECORD = "id long, record_type string, refers_to long, bytes long, digest string"


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_no, n_chunks, data) in order -> parsed records; a damaged one raises."""
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    fields: dict = {}
    digest, size = None, 0
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for no, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if no == 0:
                head, _, data = data.partition(END)
                version, *lines = head.decode().split("\r\n")
                if version != "WARC/1.1":
                    raise ValueError(f"not a WARC record: {version[:40]!r}")
                fields = dict(x.split(": ", 1) for x in lines)
                digest, size = hashlib.sha1(), 0
            if no == n - 1:
                if not data.endswith(END):
                    raise ValueError(f"{fields['WARC-Record-ID']}: no end of record")
                data = data[:-len(END)]
            digest.update(data)
            size += len(data)
            if no < n - 1:
                continue
            named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            response = fields["WARC-Type"] == "response"
            if size != int(fields["Content-Length"]) or response and base64.b32encode(digest.digest()).decode() != named:
                raise ValueError(f"{fields['WARC-Record-ID']}: length or digest differs")
            row = (_number(fields["WARC-Record-ID"]), fields["WARC-Type"], _number(fields.get("WARC-Refers-To")), size, named)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)],
                                         names=["id", "record_type", "refers_to", "bytes", "digest"])


def read_archive(archive: DataFrame) -> DataFrame:
    """Archive -> (id, payload_bytes, payload_digest, record_type, refers_to) per record.

    Lengths and digests are computed from the bytes read and compared with the headers; a
    revisit takes the length of the response that it refers to (an error if there is none).
    """
    small = archive.where("n_chunks = 1").select("chunk_no", "n_chunks", "data").mapInArrow(_records, RECORD)
    large = (archive.where("n_chunks > 1").repartition("record_no").sortWithinPartitions("record_no", "chunk_no")
             .select("chunk_no", "n_chunks", "data").mapInArrow(_records, RECORD))
    records = written(small.unionByName(large), "warc-records")
    responses = records.where("record_type = 'response'").select(
        F.col("id").alias("refers_to"), "digest", F.col("bytes").alias("response_bytes")).distinct()
    size = F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(
        F.coalesce("response_bytes", F.raise_error(F.concat(F.lit("no response "), F.col("refers_to").cast("string"))).cast("long")))
    return records.join(written(responses, "warc-lengths"), ["refers_to", "digest"], "left").select(
        "id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def warc_bytes(archive: DataFrame) -> Iterator[bytes]:
    """The archive as the bytes of one WARC file, a chunk at a time (streamed through the driver)."""
    for row in archive.orderBy("record_id", "record_no", "chunk_no").select("data").toLocalIterator():
        yield bytes(row["data"])
