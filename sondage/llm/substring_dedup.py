"""Substring dedup: suffix automata of reference shards, matched against documents.

A window is ``window`` consecutive words.  A word goes if a window covering it also
starts in a document with a smaller id.  One automaton over the corpus would fit no
machine and streaming every document past every shard would be quadratic, so both
sides are dealt by content first:

1. Every window has a minimizer, the least hash among its K-word runs; equal windows
   have equal minimizers.  Documents keep their distinct minimizers (about one per 20
   words) and those that occur in one document only are dropped.  Equal documents
   collapse to the one with the smallest id beforehand.
2. A piece is a run of windows of one document with the same shared minimizer.  Equal
   pieces collapse, and a piece is trimmed to the windows whose hash occurs in several
   documents; then equal ones collapse again.  So a passage that a third of all
   documents share becomes one row, whatever surrounds it.
3. Trimmed pieces are dealt to shards by minimizer.  A shard builds one suffix automaton
   over its pieces in order of their smallest document id, with the first document on
   every state, and streams the pieces past it.  Where the matching statistic reaches the
   window length, the state names the first document that holds the window.  Hashes only
   choose what is compared; the automaton reads the words.
   Pieces of one minimizer always meet, so a minimizer with more words than a shard should
   hold goes to no shard: its windows are dealt singly, by a 128-bit digest of their words,
   and the first document of each is a partial aggregate, of bounded size for any window.
4. Windows that start in a smaller document join to maximal spans, which are cut out.

Texts are shuffled once (and those with a shared piece once more); all else is hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

K = 10  # words of a run that may be a minimizer
SHARD_WORDS = 1 << 16  # words of a shard's pieces to aim at
BLOCK = 1 << 20  # bytes of text that are hashed at a time
BASE = 0x9E3779B97F4A7C15  # odd


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


POWERS, INVERSE = _powers(BASE, 2 * BLOCK), _powers(pow(BASE, -1, 1 << 64), 2 * BLOCK)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _run_hashes(joined: bytes, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size: a hash of every run of so many words of ``joined`` (words joined by one space).

    Long texts are hashed in blocks, as the powers table is bounded.
    """
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(data)]))
    out = []
    n = len(starts)
    for size in sizes:
        parts, i = [], 0
        while i + size <= n:
            # runs that start in this block; at least one, however long its words are
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
            j = min(j, n - size + 1)
            first, last = starts[i], ends[j + size - 2]
            m = last - first
            powers, inverse = POWERS, INVERSE
            if m >= len(powers):  # a single run of words longer than the tables
                powers, inverse = _powers(BASE, m), _powers(pow(BASE, -1, 1 << 64), m)
            sums = np.zeros(m + 1, np.uint64)
            np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * powers[:m], out=sums[1:])
            s, e = starts[i:j] - first, ends[i + size - 1:j + size - 1] - first
            parts.append(_mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
            i = j
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
    return out


def _minimizers(run_hashes: np.ndarray, window: int) -> np.ndarray:
    """The least run hash of every window (a sliding minimum by doubling)."""
    need = window - K + 1
    m, width = run_hashes, 1
    while 2 * width <= need:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[:len(m) - (need - width)], m[need - width:]) if width < need else m


def _scan(window: int):
    """(id, text, hash) -> id, hash, n_words, sha (of the words joined by one space), the distinct minimizers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, marks = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").split()
                joined = b" ".join(words)
                counts.append(len(words))
                shas.append(hashlib.sha256(joined).digest())
                found = np.zeros(0, np.uint64)
                if len(words) >= window:
                    found = np.unique(_minimizers(_run_hashes(joined, (K,))[0], window))
                marks.append(found.view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(m) for m in marks]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(shas, pa.binary()), lists],
                names=["id", "text_hash", "n_words", "sha", "marks"])
    return run


PIECE = pa.schema([("id", pa.int64()), ("sha", pa.binary()), ("start", pa.int64()), ("mark", pa.int64()),
                   ("digest", pa.binary()), ("words", pa.binary()), ("hashes", pa.list_(pa.int64()))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, sha, body): the words joined by one space, compressed for the shuffle."""
    for b in batches:
        joined = [b" ".join((t or b"").split()) for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([hashlib.sha256(j).digest() for j in joined], pa.binary()),
             pa.array([zstandard.compress(j) for j in joined], pa.binary())], names=["id", "sha", "body"])


def _unpacked(body: bytes) -> bytes:
    return zstandard.decompress(body)


def _pieces(window: int):
    """(id, sha, body, shared minimizers) -> one row per run of windows with one shared minimizer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for id_, sha, body, shared in zip(*(c.to_pylist() for c in b.columns), strict=True):
                joined = _unpacked(body)
                words = joined.split(b" ")
                runs, wins = _run_hashes(joined, (K, window))
                m = _minimizers(runs, window)
                wanted = np.isin(m, np.array(shared, np.int64).view(np.uint64))
                edges = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]))
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if wanted[i]:
                        part = b" ".join(words[i:j - 1 + window])
                        rows.append((id_, sha, i, int(m[i:i + 1].view(np.int64)[0]), xxhash.xxh3_128_digest(part), part,
                                     wins[i:j].view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE.types, strict=True)], schema=PIECE)
    return run


def _trim(window: int):
    """(digest, mark, words, first_doc, shared places) -> one row per run of consecutive shared windows."""
    schema = pa.schema([("digest", pa.binary()), ("at", pa.int64()), ("mark", pa.int64()), ("trimmed", pa.binary()),
                        ("words", pa.binary()), ("n", pa.int64()), ("first_doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, mark, text, first_doc, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, places = text.split(), np.sort(np.array(places, np.int64))
                for run_ in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                    part = words[run_[0]:run_[-1] + window]
                    joined = b" ".join(part)
                    rows.append((digest, int(run_[0]), mark, xxhash.xxh3_128_digest(joined), joined, len(part), first_doc))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
    return run


class Automaton:
    """Suffix automaton of word sequences, added in ascending order of document.

    ``first[v]`` is the first document that holds the words of state v: a state is made
    by the document being added, and a clone takes over what its original had.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.first = [-1], [0], [-1]

    def _state(self, length: int, next_: dict, link: int, first: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.len.append(length)
        self.first.append(first)
        return len(self.len) - 1

    def _clone(self, p: int, c, q: int) -> int:
        """Split state q, reached from p by c, at the length of p plus one."""
        v = self._state(self.len[p] + 1, self.next[q].copy(), self.link[q], self.first[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = v
            p = self.link[p]
        self.link[q] = v
        return v

    def add(self, words: list, doc: int) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:  # these words were seen before
                last = q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
                continue
            cur = self._state(self.len[last] + 1, {}, 0, doc)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
            last = cur

    def first_documents(self, words: list, window: int) -> Iterator[int]:
        """For every window of ``words``: the first document that holds it, -1 if none."""
        v = length = 0
        for i, c in enumerate(words):
            while v and c not in self.next[v]:
                v = self.link[v]
                length = self.len[v]
            if c in self.next[v]:
                v, length = self.next[v][c], length + 1
            while v and self.len[self.link[v]] >= window:  # words before the window don't matter
                v = self.link[v]
                length = self.len[v]
            if i + 1 >= window:
                yield self.first[v] if length >= window else -1


def _match(window: int):
    """A shard's trimmed pieces -> runs of windows (at, n) of a piece with the same first document."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first_doc", "trimmed"])
        number: dict[bytes, int] = {}
        texts = [[number.setdefault(w, len(number)) for w in t.split()] for t in pdf["words"]]
        automaton = Automaton()
        for words, doc in zip(texts, pdf["first_doc"].tolist(), strict=True):
            automaton.add(words, doc)
        rows = []
        for mark, key, words in zip(pdf["mark"], pdf["trimmed"], texts, strict=True):
            first = np.fromiter(automaton.first_documents(words, window), np.int64)
            edges = np.concatenate(([0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]))
            rows += [(mark, key, i, j - i, int(first[i])) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["mark", "trimmed", "win", "n_win", "first_doc"])
    return run


def _digests(window: int):
    """(mark, trimmed, words, first_doc) -> one row per window of a piece, with the digest of its words."""
    schema = pa.schema([("mark", pa.int64()), ("trimmed", pa.binary()), ("win", pa.int64()), ("key", pa.binary()), ("first_doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for mark, trimmed, joined, doc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
                n = len(starts) - window + 1
                for k in range(0, n, BLOCK >> 4):
                    m = min(n, k + (BLOCK >> 4))
                    keys = [xxhash.xxh3_128_digest(joined[i:j]) for i, j in
                            zip(starts[k:m].tolist(), ends[k + window - 1:m + window - 1].tolist(), strict=True)]
                    columns = [mark] * (m - k), [trimmed] * (m - k), range(k, m), keys, [doc] * (m - k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
    return run


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, trimmed, windows with their first document) -> runs of windows, as of a shard."""
    schema = pa.schema([("mark", pa.int64()), ("trimmed", pa.binary()), ("win", pa.int64()), ("n_win", pa.int64()), ("first_doc", pa.int64())])
    for b in batches:
        rows = []
        for mark, trimmed, wins in zip(*(c.to_pylist() for c in b.columns), strict=True):
            first = np.array([w["first_doc"] for w in sorted(wins, key=lambda w: w["win"])], np.int64)
            edges = np.concatenate(([0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]))
            rows += [(mark, trimmed, i, j - i, int(first[i])) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _crowded(pieces: DataFrame, window: int) -> DataFrame:
    """The spans of trimmed pieces whose minimizers have too many words for a shard."""
    schema = "mark long, trimmed binary, win long, key binary, first_doc long"
    least = pieces.groupBy("mark", "trimmed").agg(F.min("first_doc").alias("first_doc"), F.first("words").alias("words"))
    windows = written(least.select("mark", "trimmed", "words", "first_doc").mapInArrow(_digests(window), schema), "substring-crowded")
    # written: joined with plain exchanges on both sides, of which a hot window can be split
    first = written(windows.groupBy("key").agg(F.min("first_doc").alias("first_doc")), "substring-crowded-first")
    named = windows.drop("first_doc").join(first, "key").groupBy("mark", "trimmed").agg(
        F.collect_list(F.struct("win", "first_doc")).alias("wins"))
    return named.mapInArrow(_joined_runs, "mark long, trimmed binary, win long, n_win long, first_doc long")


def _cut(window: int):
    """(id, sha, body, starts and lengths of runs of repeated windows) -> what is kept."""
    schema = pa.schema([("id", pa.int64()), ("sha", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                        ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, sha, body, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = _unpacked(body).split(b" ")
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [r["at"] for r in runs], 1)
                np.add.at(change, [r["at"] + r["n"] + window - 1 for r in runs], -1)
                gone = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                spans = [{"at": i, "n": j - i} for i, j in edges.reshape(-1, 2).tolist()]
                rows.append((id_, sha, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), spans))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
    return run


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_words, n_removed, kept_sha256, kept_text, spans) for every row of ``docs``.

    text_hash (xxhash64 of the text) tells rows of an equal id apart when joining back.
    kept_text: the kept words joined by one space, null where nothing was removed; spans:
    the removed (at, n) in words.  A null or blank text has no words and nothing to remove.
    Windows of rows with equal ids do not count against each other, so of repeated rows
    all are kept.  A row with a null id is neither cut nor a reference for others.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scanned = written(src.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _scan(window), "id long, text_hash long, n_words long, sha binary, marks array<long>"), "substring-scan")

    # equal texts: only the one with the smallest id is matched, the others go altogether
    owners = scanned.where("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("owner"))
    firsts = scanned.where("size(marks) > 0").join(owners, "sha").where("id = owner").dropDuplicates(["id", "sha"])
    marks = firsts.select("id", "sha", F.explode("marks").alias("mark"))
    shared = marks.groupBy("mark").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("mark")
    wanted = marks.join(shared, "mark").groupBy("id", "sha").agg(F.collect_list("mark").alias("shared"))
    packed = src.mapInArrow(_packed, "id long, sha binary, body binary")
    texts = written(packed.join(wanted, ["id", "sha"]).dropDuplicates(["id", "sha"]), "substring-texts")

    pieces = written(texts.select("id", "sha", "body", "shared").mapInArrow(_pieces(window), "id long, sha binary, start long, mark long, digest binary,"
                                      " words binary, hashes array<long>"), "substring-pieces")
    distinct = written(pieces.groupBy("mark", "digest").agg(
        F.min("id").alias("first_doc"), F.max("id").alias("last_doc"), F.first("words").alias("words"),
        F.first("hashes").alias("hashes")), "substring-distinct")
    windows = distinct.select("mark", "digest", "first_doc", "last_doc", F.posexplode("hashes").alias("place", "hash"))
    # written: joined with plain exchanges on both sides, of which a hot hash can be split
    repeated = written(windows.groupBy("hash").agg(F.min("first_doc").alias("a"), F.max("last_doc").alias("b"))
                       .where("a < b").select("hash"), "substring-hashes")
    # of a piece that several documents have, every window is repeated
    many = distinct.where("first_doc < last_doc").withColumn("places", F.expr("transform(hashes, (h, i) -> i)"))
    places = (windows.where("first_doc = last_doc").join(repeated, "hash").groupBy("mark", "digest")
              .agg(F.collect_list("place").alias("places")))
    few = distinct.join(places, ["mark", "digest"])
    names = ["digest", "mark", "words", "first_doc", "places"]
    trimmed = written(many.select(names).unionByName(few.select(names)).mapInArrow(
        _trim(window), "digest binary, at long, mark long, trimmed binary, words binary, n long, first_doc long"), "substring-trimmed")

    # minimizers with more words than a shard should hold; of them there are few
    crowded = written(trimmed.groupBy("mark", "trimmed").agg(F.first("n").alias("n")).groupBy("mark").agg(F.sum("n").alias("n"))
                      .where(F.col("n") > SHARD_WORDS).select("mark"), "substring-marks")
    some = crowded.limit(1).count() > 0
    dealt = trimmed.join(crowded, "mark", "left_anti") if some else trimmed
    classes = dealt.groupBy("mark", "trimmed").agg(F.min("first_doc").alias("first_doc"), F.first("words").alias("words"),
                                                   F.first("n").alias("n"))
    total = trimmed.agg(F.sum("n")).first()[0] or 0
    shards = max(1, total // SHARD_WORDS)
    spans = (classes.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)))
             .repartition(max(shuffle_partitions(spark), 1), "shard").groupBy("shard")
             .applyInPandas(_match(window), "mark long, trimmed binary, win long, n_win long, first_doc long"))
    if some:
        spans = spans.unionByName(_crowded(trimmed.join(crowded, "mark", "left_semi"), window))
    spans = written(spans, "substring-spans")

    # back to the pieces that collapsed, and to their documents
    found = trimmed.select("mark", "trimmed", "digest", "at").join(spans, ["mark", "trimmed"]).select(
        "mark", "digest", (F.col("at") + F.col("win")).alias("at"), "n_win", "first_doc")
    hits = pieces.select("id", "sha", "start", "mark", "digest").join(found, ["mark", "digest"]).where("first_doc < id")
    runs = hits.groupBy("id", "sha").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("at")).alias("at"), F.col("n_win").alias("n"))).alias("runs"))
    cut = texts.select("id", "sha", "body").join(runs, ["id", "sha"]).mapInArrow(
        _cut(window), "id long, sha binary, n_removed long, kept_sha256 string, kept_text string,"
        " spans array<struct<at:long,n:long>>")
    # written, so that the joins below meet plain exchanges, whose hot keys can be split
    cut, owners = written(cut, "substring-cut"), written(owners, "substring-owners")

    copy = (F.col("id") > F.col("owner")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n_words").alias("n")))
    return (scanned.select("id", "text_hash", "n_words", "sha").join(owners, "sha", "left").join(cut, ["id", "sha"], "left").select(
        F.col("id").alias(id_col), "text_hash", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<at:bigint,n:bigint>>"))).alias("spans")))
