"""Packing token sequences by minimum bin slack.

A piece's place depends on its length alone, so the corpus is reduced to a histogram of
lengths (at most ``capacity`` rows) by one aggregation.  On it the driver fills bin after
bin: the longest piece left comes first, and a subset-sum over the lengths left (a bitset
of reachable sums, with as many of each length as remain) finds the fullest combination.
The combination is taken as often as the counts allow before the next one is sought, which
gives the bins that filling them singly would give, in at most a few thousand steps.

Pieces then find their own place: the rank of a piece within its length says which use of
which combination it is.  Ranks are running counts over (length, bucket) plus a row number
within the bucket, so a length that a third of all pieces share is cut like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import written

BUCKET_ROWS = 400  # pieces of a bucket to aim at

Combination = tuple[int, list[tuple[int, int]]]  # how often, [(length, how many in a bin)]


def fullest(left: dict[int, int], room: int, slack: int = 0) -> list[tuple[int, int]]:
    """The lengths (and how many of each) with the largest sum of at most ``room``, longer ones first.

    Shorter lengths are not tried once the longer ones reach a sum within ``slack`` of the room.
    """
    reach, steps, within = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in left if 0 < x <= room), reverse=True):
        most, k = min(left[length], room // length), 1
        while most > 0:  # 1, 2, 4, ... of this length at a time
            k = min(k, most)
            steps.append((length, k, reach))
            reach = (reach | reach << k * length) & within
            most, k = most - k, 2 * k
        if reach >> max(room - slack, 0):
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= k * length
            used[length] = used.get(length, 0) + k
    return sorted(used.items(), reverse=True)


def combinations(counts: dict[int, int], capacity: int) -> list[Combination]:
    """Minimum bin slack over a histogram of lengths from 1 to capacity.

    Filling every bin to the brim uses up the short pieces that later bins would need, so
    plans that are content with a slack of 0, 1, 2, 4 ... are made, and the one with the
    fewest bins is taken (of equal ones that of the least slack).
    """
    plans = [_combinations(counts, capacity, slack) for slack in (0, *(1 << k for k in range((capacity // 8).bit_length())))]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def _combinations(counts: dict[int, int], capacity: int, slack: int) -> list[Combination]:
    left = {length: n for length, n in counts.items() if n}
    out: list[Combination] = []
    while left:
        longest = max(left)
        left[longest] -= 1
        uses = dict(fullest(left, capacity - longest, slack))
        left[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        times = min(left[length] // n for length, n in uses.items())
        for length, n in uses.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
        out.append((times, sorted(uses.items(), reverse=True)))
    return out


def places(plan: list[Combination]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, how many in a bin, first sequence, first offset), by rank."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for times, uses in plan:
        offset = 0
        for length, n in uses:
            first = taken.get(length, 0)
            rows.setdefault(length, []).append((first, n, sequence, offset))
            taken[length] = first + times * n
            offset += n * length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with id, piece, length, crc, which order equal lengths) plus sequence_id and offset.

    Every length must be from 1 to ``capacity``.  ``pieces`` is read twice: pass a written table.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(combinations(counts, capacity))
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(buckets)))
    sums = p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "crc")
    ranked = (p.withColumn("row", F.row_number().over(inside)).join(starts, ["length", "bucket"])
              .withColumn("rank", F.col("before") + F.col("row") - 1)
              .select(*pieces.columns, "rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                t = table[int(length[i[0]])]
                first, n, seq, off = t[np.searchsorted(t[:, 0], rank[i], side="right") - 1].T
                sequence[i] = seq + (rank[i] - first) // n
                offset[i] = off + (rank[i] - first) % n * length[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             names=[*b.schema.names[:-1], "sequence_id", "offset"])

    out = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, out)


PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc) of each document's ids and ``end_id``, cut into pieces.

    Only a document over ``capacity`` is cut; its first piece is the shorter one, if any.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows = []
            for id_, ids in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(id_, k, s, e - s, zlib.crc32(ids[4 * s:4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE.types, strict=True)], schema=PIECE)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, piece int, start long, length long, crc long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece of every row of ``docs``.

    A null or empty text is the end id alone.  Repeated rows and ids, and null ids, are
    packed row by row; which of equal pieces takes which place is no matter.  No rows give none.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "packing-pieces")
    return pack(pieces, capacity).withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})
