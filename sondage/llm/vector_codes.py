"""Vector code compression: product codes with codebooks fitted by active-entry Lloyd rounds.

Vectors become integers and are cut into equal parts; every part position has a codebook
of up to 256 entries that starts as the parts of the smallest ids.  A round assigns
every part to its nearest entry and moves each entry to the floored mean of its parts.

A row keeps, per part, its entry and the exact distance to it.  In the next round a part
whose entry stayed where it was compares that distance with the moved entries alone: all
others were no nearer before and are where they were.  A part whose entry moved rescans the
whole codebook.  Ties go to the lower index in both cases, so the result is that of a full scan.

A round is one pass over the rows, written under the shared checkpoint folder; tasks hand
on sums and counts per entry, and the codebooks (parts x entries x width integers) are all
that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

EXACT = 1 << 53  # doubles hold all integers up to here
LONG = (1 << 63) - 1
BLOCK = 1 << 14  # parts compared with a codebook at a time


def _exact(x: np.ndarray, entries: np.ndarray) -> type:
    """A number type in which all squared distances are exact."""
    most = sum(int(max(a.max(initial=0), -a.min(initial=0))) for a in (x, entries))
    bound = max(x.shape[1], 1) * most * most
    return np.float64 if 4 * bound < EXACT else np.int64 if bound < LONG else object


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``entries`` for every row of ``x`` (ties to the lower), and its squared distance."""
    kind = _exact(x, entries)
    out, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    e = entries.astype(kind)
    squares = (e * e).sum(axis=1)
    for at in range(0, len(x), BLOCK):
        b = x[at:at + BLOCK].astype(kind)
        d = (b * b).sum(axis=1)[:, None] - 2 * (b @ e.T) + squares[None, :]
        best = d.argmin(axis=1)
        least = d[np.arange(len(b)), best]
        if kind is object and len(b) and least.max() > LONG:
            raise ValueError("a squared distance is beyond a long; scale the vectors down")
        out[at:at + BLOCK], far[at:at + BLOCK] = best, least
    return out, far


def reassign(x: np.ndarray, entry: np.ndarray, far: np.ndarray, entries: np.ndarray, moved: np.ndarray):
    """(entry, distance, parts that were rescanned) of parts ``x`` after the entries in ``moved`` have moved.

    ``entry`` and ``far`` are right for the codebook before.
    """
    entry, far = entry.copy(), far.copy()
    lost = moved[entry]
    if lost.any():
        entry[lost], far[lost] = nearest(x[lost], entries)
    active, stay = np.flatnonzero(moved), np.flatnonzero(~lost)
    if len(active) and len(stay):
        near, d = nearest(x[stay], entries[active])
        near = active[near]
        better = (d < far[stay]) | ((d == far[stay]) & (near < entry[stay]))
        entry[stay[better]], far[stay[better]] = near[better], d[better]
    return entry, far, int(lost.sum())


class Rows:
    """The rows of an Arrow batch as numpy arrays.  Vectors are stored as 2, 4 or 8 byte
    integers, or as decimal text where a component needs more."""

    def __init__(self, batch: pa.RecordBatch, dim: int, parts: int):
        self.batch, n = batch, batch.num_rows
        width = -(-dim // parts)
        kinds, raws = batch.column("kind").to_pylist(), batch.column("v").to_pylist()
        x = np.zeros((n, parts * width), object if "text" in kinds else np.int64)
        if len(set(kinds)) == 1 and kinds[0] != "text":
            x[:, :dim] = np.frombuffer(b"".join(raws), kinds[0]).reshape(n, dim)
        else:
            for i, (kind, raw) in enumerate(zip(kinds, raws, strict=True)):
                x[i, :dim] = _decoded(kind, raw)
        self.x = [x[:, k * width:(k + 1) * width] for k in range(parts)]

    def state(self, name: str, parts: int) -> list[np.ndarray]:
        values = self.batch.column(name).flatten().to_numpy(zero_copy_only=False)
        return list(values.reshape(-1, parts).T.astype(np.int64)) if len(values) else [np.zeros(0, np.int64)] * parts


def _stored(v: list, scale: int) -> tuple[str, bytes] | None:
    """Kind and bytes of floor(scale * component); None if a component is null or not finite."""
    if any(c is None for c in v):
        return None
    x = np.array(v, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    most = np.abs(y).max(initial=0)
    if scale & (scale - 1) or most >= EXACT:  # the product may be rounded
        whole = [scale * a // b for a, b in (c.as_integer_ratio() for c in x.tolist())]
        if max(map(abs, whole), default=0) >= EXACT:
            return "text", " ".join(map(str, whole)).encode()
        y = np.array(whole, np.int64)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, y.astype(kind).tobytes()


def _integers(scale: int):
    """Batches of (id, label, vector) -> the kept rows' integer components, as short as they fit."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            stored = [None if v is None else _stored(v, scale) for v in vectors]
            kept = [i for i, s in enumerate(stored) if s]
            taken = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                taken.column(0), taken.column(1), pa.array([len(vectors[i]) for i in kept], pa.int32()),
                pa.array([stored[i][0] for i in kept], pa.string()), pa.array([stored[i][1] for i in kept], pa.binary())],
                names=["id", "label", "dim", "kind", "v"])

    return convert


def integer_rows(rows: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, dim, kind, v): floor(scale * component) of every vector without null or non-finite components."""
    d = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vector"))
    kinds = dict(d.dtypes)
    return written(d.mapInArrow(_integers(scale), f"id {kinds['id']}, label {kinds['label']}, dim int, kind string, v binary"), "codes-integers")


def _decoded(kind: str, raw: bytes) -> list[int]:
    return [int(c) for c in raw.split()] if kind == "text" else np.frombuffer(raw, kind).tolist()


def _as_array(values: list, shape: tuple) -> np.ndarray:
    big = any(abs(v) > LONG for v in values)
    return np.array(values, object if big else np.int64).reshape(shape)


def first_codebooks(ints: DataFrame, parts: int, entries: int) -> tuple[int, list[np.ndarray]]:
    """The vectors' dimension and a codebook per part: the parts of the vectors with the smallest ids.

    ``entries`` rows are sent to the driver.  Equal ids go by the stored vector.
    """
    first = ints.orderBy(F.col("id").asc_nulls_last(), "kind", "v")
    least = first.select("dim").first()
    if least is None:
        return 0, []
    dim = least["dim"]
    top = first.where(F.col("dim") == dim).limit(entries).select("kind", "v").collect()
    width = -(-dim // parts)
    vectors = [_decoded(r["kind"], r["v"]) + [0] * (parts * width - dim) for r in top]
    whole = _as_array([c for v in vectors for c in v], (len(vectors), parts * width))
    return dim, [whole[:, k * width:(k + 1) * width].copy() for k in range(parts)]


def _assign(books: list, moved: list | None, dim: int):
    """A pass: every part's entry and exact distance for ``books``; ``moved`` is None in the first one."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(batch, dim, parts)
            if moved is None:
                found = [nearest(x, book) for x, book in zip(rows.x, books, strict=True)]
                scanned = [batch.num_rows] * parts
            else:
                state = zip(rows.x, rows.state("entry", parts), rows.state("far", parts), books, moved, strict=True)
                both = [reassign(*s) for s in state]
                found, scanned = [b[:2] for b in both], [b[2] for b in both]
            entry = np.stack([e for e, _ in found], axis=1)
            far = np.stack([d for _, d in found], axis=1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, parts, dtype=np.int32)), pa.array(a.ravel()))
                     for a in (entry, far)]
            scans = pa.array(np.full(batch.num_rows, sum(scanned) / max(batch.num_rows, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "label", "dim", "kind", "v")] + [*lists, scans],
                                             names=["id", "label", "dim", "kind", "v", "entry", "far", "rescanned"])

    return run


def _sums(parts: int, dim: int, entries: int):
    """Per task: (part, entry, number of parts, their sum as decimal numbers) of the entries in use."""
    width = -(-dim // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows = Rows(batch, dim, parts)
            for k, (x, entry) in enumerate(zip(rows.x, rows.state("entry", parts), strict=True)):
                if sums.dtype != object and (x.dtype == object or np.abs(x).max(initial=0) > 1 << 31):
                    sums = sums.astype(object)  # long sums of such components could overflow
                counts[k] += np.bincount(entry, minlength=entries)
                np.add.at(sums[k], entry, x)
        k, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(k, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)),
            pa.array(np.tile(np.arange(width, dtype=np.int32), len(k))), pa.array(np.repeat(counts[k, e], width)),
            pa.array([str(s) for s in sums[k, e].ravel().tolist()], pa.string())], names=["part", "entry", "at", "n", "total"])

    return run


def moved_codebooks(state: DataFrame, books: list, dim: int) -> tuple[list, list]:
    """The codebooks after the entries moved to the floored means of their parts, and which of them moved."""
    parts, entries = len(books), len(books[0])
    task = state.mapInArrow(_sums(parts, dim, entries), "part int, entry int, at int, n long, total string")
    sums = task.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    after = [b.astype(object) for b in books]
    for r in sums.collect():  # parts x entries x width numbers at most
        after[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    after = [_as_array(b.ravel().tolist(), b.shape) for b in after]
    return after, [(a != b).any(axis=1) if a.shape[1] else np.zeros(len(a), bool) for a, b in zip(after, books, strict=True)]


def codebooks_sha256(books: list) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list]:
    """(id, label, codes array<int>, error long, rescanned double) per kept row, and the codebooks.

    Rows whose vector is null, or holds null or non-finite components, are dropped, and so are
    those of another dimension than the kept row with the smallest id has.  A dimension that
    ``parts`` doesn't divide is filled up with zeros.  Fewer rows than ``entries`` make
    smaller codebooks; equal entries: the lower index.  Repeated rows and ids count each;
    null ids come last.  No kept rows: no rows, no codebooks.  ``rescanned``: parts of a row, on average
    over its batch, that the last pass compared with the whole codebook.  A squared distance
    beyond a long is an error that says so.
    """
    ints = integer_rows(rows, scale, id_col, vec_col, label_col)
    dim, books = first_codebooks(ints, parts, entries)
    kind = ", ".join(f"{n} {t}" for n, t in ints.dtypes)
    schema = f"{kind}, entry array<long>, far array<long>, rescanned double"
    if not books:
        state = ints.select("*", F.expr("array(0L) AS entry"), F.expr("array(0L) AS far"), F.lit(0.0).alias("rescanned"))
    else:
        state = written(ints.where(F.col("dim") == dim).mapInArrow(_assign(books, None, dim), schema), "codes-round-0")
    for i in range(rounds if books else 0):
        books, moved = moved_codebooks(state, books, dim)
        state = written(state.drop("rescanned").mapInArrow(_assign(books, moved, dim), schema), f"codes-round-{i + 1}")
    error = F.aggregate("far", F.lit(0).cast("long"), lambda a, d: a + d)
    return state.select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.col("entry").cast("array<int>").alias("codes"),
                        error.alias("error"), "rescanned"), books


def label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """``codes`` with ``label_error``: the error summed over the rows of the same label, nulls together."""
    keyed = codes.withColumns({"_null": F.col(label_col).isNull(), "_label": F.coalesce(F.col(label_col).cast("string"), F.lit(""))})
    on = ["_null", "_label"]
    sums = written(keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("group_size"), F.sum("error").alias("label_error")), "codes-labels")
    return join_groups(keyed, sums, on).drop("_null", "_label", "group_size")
