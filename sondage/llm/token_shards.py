"""Token ids in binary shards, compressed per document with a shared zstandard dictionary.

The dictionary is trained on the serialized ids of a bounded sample of documents; each
document is a frame of its own, so a short one can be read without its neighbours.

shard file   frames in ascending order of id
             index: n times (id int64, tokens int64, end of frame int64), little-endian
             footer: index offset int64, n int64, dictionary SHA-256 (32 bytes), magic (8 bytes)
dictionary   one file; a reader compares its hash with the footer's

Frames are written once, dealt by ranges of id and streamed by each task into a file of
its own name; the manifest (a Parquet table) names the files of the attempts that ended,
so what a lost executor left behind is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .bpe import encoder
from .common import spread_sample, written

MAGIC = b"IDSHARD1"
FOOTER = "<qq32s8s"
SAMPLE_ROWS = 2000  # documents that train the dictionary
SAMPLE_BYTES = 1 << 14  # serialized bytes of one of them that take part
DICTIONARY_BYTES = 1 << 16
SHARD_BYTES = 1 << 25  # frames of a shard to aim at
LEVEL = 3


def _ids(tokenizer: str, end_id: int, width: str):
    def run(texts: list[str | None]) -> list[bytes]:
        """Serialized ids with the end id."""
        end = np.array([end_id], width).tobytes()
        return [np.frombuffer(x, "<u4").astype(width).tobytes() + end for x in encoder(tokenizer).encode([t or "" for t in texts])]
    return run


def train_dictionary(docs: DataFrame, ids, text_col: str) -> bytes:
    """A dictionary from a sample of documents; empty if they are too few or too short to train one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in ids(b.column(0).to_pylist())], pa.binary())], names=["ids"])
    d = docs.select(text_col)
    rows = spread_sample(d, SAMPLE_ROWS, d.count(), text_col).limit(2 * SAMPLE_ROWS).mapInArrow(run, "ids binary").collect()
    samples = sorted(bytes(r["ids"]) for r in rows)
    try:
        size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
        return zstandard.train_dictionary(size, samples).as_bytes() if size >= 256 else b""
    except zstandard.ZstdError:
        return b""


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system, name


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", width: str = "<u2") -> tuple[DataFrame, str]:
    """Write the ids of every row of ``docs``; return the manifest and the dictionary's path.

    manifest: (path, first_id, n_docs, n_tokens, start), with start the tokens in all shards
    before.  ``width`` must hold the tokenizer's ids.  A null text has the end id only;
    rows with equal ids follow each other in order of their frames; null ids come first.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    ids = _ids(tokenizer, end_id, width)
    dictionary = train_dictionary(docs, ids, text_col)
    system, name = _open(path)
    system.create_dir(name)
    with system.open_output_stream(f"{name}/dictionary") as f:
        f.write(dictionary)
    sha = hashlib.sha256(dictionary).digest()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        size = np.dtype(width).itemsize
        for b in batches:
            raw = ids(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // size for x in raw], pa.int64()), pa.array([packer.compress(x) for x in raw], pa.binary())],
                names=["id", "n_tokens", "frame"])

    frames = written(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        compress, "id long, n_tokens long, frame binary"), "token-frames")
    total = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    shards = max(1, total // SHARD_BYTES, min(spark.sparkContext.defaultParallelism, total // (1 << 20)))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, index, file = None, 0, [], ""
        for b in batches:
            for id_, n, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    file = f"{path}/{uuid.uuid4().hex}.ids"
                    where, full = _open(file)
                    out = where.open_output_stream(full)
                out.write(frame)
                at += len(frame)
                index.append((-(1 << 63) if id_ is None else id_, n, at))
        if out is not None:
            rows = np.array(index, "<i8")
            out.write(rows.tobytes())
            out.write(struct.pack(FOOTER, at, len(rows), sha, MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array(rows[:1, 0]), pa.array(rows[-1:, 0]), pa.array([len(rows)], pa.int64()),
                 pa.array([int(rows[:, 1].sum())], pa.int64())], names=["path", "first_id", "last_id", "n_docs", "n_tokens"])

    manifest = written(frames.repartitionByRange(int(shards), "id", "frame").sortWithinPartitions("id", "frame")
                       .mapInArrow(store, "path string, first_id long, last_id long, n_docs long, n_tokens long"), "token-manifest")
    # an id may fill whole shards and begin the next one, which ends with a larger id; one row per shard meets here
    before = Window.orderBy("first_id", "last_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), f"{path}/dictionary"


class Shard:
    """Random access to a shard file."""

    def __init__(self, path: str, dictionary: bytes, width: str = "<u2"):
        system, name = _open(path)
        self.file, self.width = system.open_input_file(name), width
        size = self.file.size()
        self.file.seek(size - struct.calcsize(FOOTER))
        at, n, sha, magic = struct.unpack(FOOTER, self.file.read(struct.calcsize(FOOTER)))
        if magic != MAGIC or sha != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: no shard, or written with another dictionary")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(24 * n), "<i8").reshape(n, 3)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.reader = zstandard.ZstdDecompressor(dict_data=shared)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the shard."""
        start = int(self.index[k - 1, 2]) if k else 0
        self.file.seek(start)
        return np.frombuffer(self.reader.decompress(self.file.read(int(self.index[k, 2]) - start)), self.width)

    def find(self, id_: int) -> np.ndarray | None:
        """The ids of a document by its id, read alone."""
        k = int(np.searchsorted(self.index[:, 0], id_))
        return self.document(k) if k < len(self.index) and self.index[k, 0] == id_ else None


def read_bytes(path: str) -> bytes:
    system, name = _open(path)
    with system.open_input_file(name) as f:
        return f.read()


def read_shards(manifest: DataFrame, dictionary_path: str, width: str = "<u2") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files; the crc is over 32-bit ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = Shard(path, read_bytes(dictionary_path), width)
                for i in range(0, len(shard.index), 4096):
                    part = shard.index[i:i + 4096]
                    crcs = []
                    for k in range(i, i + len(part)):
                        ids = shard.document(k)
                        if len(ids) != shard.index[k, 1]:
                            raise ValueError(f"{path}: document {shard.index[k, 0]} has {len(ids)} ids")
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    starts = start + np.cumsum(part[:, 1]) - part[:, 1]
                    start += int(part[:, 1].sum())
                    none = part[:, 0] == -(1 << 63)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[:, 0], mask=none), pa.array(starts), pa.array(part[:, 1]), pa.array(crcs, pa.int64())],
                        names=["id", "start", "n_tokens", "ids_crc32"])
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of ``docs`` under the shared folder and read them back."""
    manifest, dictionary = write_shards(docs, tokenizer, end_id, None, id_col, text_col)
    return read_shards(written(manifest, "token-manifest-starts"), dictionary).withColumnRenamed("id", id_col)
