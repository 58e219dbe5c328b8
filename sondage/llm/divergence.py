"""Source divergence audit: how the term frequencies of a language's sources differ.

Terms are counted per (language, source); only fixed-width digests of them are shuffled,
and text is joined back for what is returned:

1. Each task adds up its own documents and writes two kinds of rows: the digest, text and
   number of documents of each term it met in a language, and the counts of a group's
   digests, packed by bucket of digests.  The jobs below read the columns they need.
2. Documents per (language, digest) are summed, without strings; the digests in enough
   documents may belong to kept terms.  The packed counts are shuffled by bucket and added up.
3. For those digests alone, the smallest and largest term are looked up.  Where the two
   differ, several terms share the digest: the texts are counted again by term for it.
4. Counts per source become integer frequencies.  Distances between sources are summed in
   blocks of terms: a block is a dense matrix sources x terms, and hands on one number per
   pair of sources.  The terms that stand out are ranked by value first; strings come
   back only for the candidates, to break ties and to be shown.

All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, shuffle_partitions, written

# A-Z lower-cased; a-z and all bytes of non-ASCII characters stay; everything else separates terms
TERM_BYTES = bytes(b + 32 if chr(b) in UPPER else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
FLUSH_TERMS = 1 << 20  # counts that a task holds before it hands them on, about 100 MB
PIECE = 1 << 20  # bytes of a text split at a time
CELLS = 1 << 16  # sources x terms of a block to aim at
TILE = 1024  # sources of a block at most
SMALL_ROWS = 1 << 19  # a table of up to so many rows of a few numbers is broadcast
SCALE, SMOOTH = 1_000_000_000, 5


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded number of bytes."""
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + PIECE)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


def _digests(terms: list[bytes], bits: int) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))
    return (h >> np.uint64(64 - bits)).view(np.int64)


def _numbers(counter: Counter) -> np.ndarray:
    return np.fromiter(counter.values(), np.int64, len(counter))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
    """Occurrences by (language, group) and documents by language, every ``FLUSH_TERMS`` counts."""
    tf: dict = {}
    df: dict = {}
    size = 0
    for batch in batches:
        lids, gids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lid, gid, text in zip(lids, gids, batch.column(2).cast(pa.binary()), strict=True):
            own = tf.setdefault((lid, gid), Counter())
            before, seen = len(own), set()
            for terms in pieces(text.as_py()):
                own.update(terms)
                seen.update(terms)
            df.setdefault(lid, Counter()).update(seen)
            size += len(own) - before
            if size > FLUSH_TERMS:
                yield tf, df
                tf, df, size = {}, {}, 0
    yield tf, df


PARTIALS = "lid long, digest long, term string, docs long, bucket int, gid long, digests array<long>, n array<long>"


def _partials(buckets: int, bits: int):
    """Two kinds of rows: a term's digest, text and documents in a language; and a group's
    digests of one bucket with their counts.  A task repeats a term's text once per language."""
    names = [f.split()[0] for f in PARTIALS.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tf, df in _tallied(batches):
            for lid, counts in df.items():
                terms = list(counts)
                m = len(terms)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, lid, np.int64)), pa.array(_digests(terms, bits)), pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(_numbers(counts)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()),
                    pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))], names=names)
            for (lid, gid), counts in tf.items():
                h = _digests(list(counts), bits)
                bucket = np.uint64(buckets) * (h.view(np.uint64) >> np.uint64(max(bits - 24, 0))) >> np.uint64(min(bits, 24))
                order = np.argsort(bucket, kind="stable")
                used, starts = np.unique(bucket[order], return_index=True)
                ends = pa.array(np.append(starts, len(h)).astype(np.int32))
                m = len(used)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, lid, np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()),
                    pa.array(used.astype(np.int32)), pa.array(np.full(m, gid, np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(h[order])), pa.ListArray.from_arrays(ends, pa.array(_numbers(counts)[order]))],
                    names=names)

    return count


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, lid, gid, digests, n) -> (lid, gid, digest, n), summed over the partition."""
    lang: dict = {}
    held, size = [], 0

    def add_up() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, d, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((d, g))
        g, d, n = g[order], d[order], n[order]
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        return g[first], d[first], np.add.reduceat(n, first)

    distinct = 0
    for batch in batches:
        gids = batch.column("gid").to_numpy()
        lang.update(zip(gids.tolist(), batch.column("lid").to_pylist(), strict=True))
        lists = batch.column("digests")
        sizes = lists.value_lengths().to_numpy()
        held.append((np.repeat(gids, sizes), lists.flatten().to_numpy(), batch.column("n").flatten().to_numpy()))
        size += int(sizes.sum())
        if size > max(FLUSH_TERMS, 2 * distinct):
            held = [add_up()]
            size = distinct = len(held[0][0])
    if not held:
        return
    g, d, n = add_up()
    for at in range(0, len(g), 1 << 16):
        part = slice(at, at + (1 << 16))
        lids = np.fromiter((lang[x] for x in g[part].tolist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lids, g[part], d[part], n[part])], names=["lid", "gid", "digest", "n"])


def _by_term(bits: int):
    """(lid, gid, digest, term, n, docs) rows: counts with the terms themselves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # documents of a term by group: a batch at a time
            for gid in set(batch.column(1).to_pylist()):
                own = batch.filter(pc.equal(batch.column(1), gid))
                for tf, df in _tallied([own]):
                    for (lid, _), counts in tf.items():
                        terms, m = list(counts), len(counts)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(m, lid, np.int64)), pa.array(np.full(m, gid, np.int64)), pa.array(_digests(terms, bits)),
                            pa.array(terms, pa.binary()).cast(pa.string()), pa.array(_numbers(counts)),
                            pa.array(np.fromiter((df[lid][t] for t in terms), np.int64, m))],
                            names=["lid", "gid", "digest", "term", "n", "docs"])

    return count


def _checked(df: DataFrame) -> DataFrame:
    """With a broadcast hint if ``df``, a written table, is small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _groups(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, lid, gid) of every group, and the seed that gives each language and group a hash of its own."""
    names = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    seed = 0
    while True:
        groups = written(names.withColumns(_ids(seed)), "divergence-groups")
        n = groups.agg(F.count(F.lit(1)), F.countDistinct("gid"), F.countDistinct("lang"), F.countDistinct("lid")).first()
        if n[0] == n[1] and n[2] == n[3]:
            return groups, seed
        seed += 1


def _ids(seed: int) -> dict:
    return {"lid": F.xxhash64(F.lit(seed), "lang"), "gid": F.xxhash64(F.lit(seed), "lang", "source")}


def kept_terms(docs: DataFrame, seed: int, min_docs: int, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts (lid, gid, digest, sub, n) of kept terms per group, and their texts (lid, digest, sub, term).

    ``sub`` is 0, or numbers the terms that share a digest.  ``docs``: (lang, source, text), without nulls.
    """
    rows = docs.select(*[c.alias(k) for k, c in _ids(seed).items()], "text")
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    partials = written(rows.mapInArrow(_partials(buckets, digest_bits), PARTIALS), "divergence-partials")
    texts = partials.where("bucket IS NULL")
    often = F.sum("docs") >= min_docs
    kept = written(texts.groupBy("lid", "digest").agg(often.alias("often")).where("often").select("lid", "digest"),
                   "divergence-kept")
    names = written(texts.join(_checked(kept), ["lid", "digest"], "left_semi").groupBy("lid", "digest")
                    .agg(F.min("term").alias("term"), F.max("term").alias("last")), "divergence-names")
    packed = partials.where("bucket IS NOT NULL").select("bucket", "lid", "gid", "digests", "n")
    merged = packed.repartition(shuffle_partitions(docs.sparkSession), "bucket").mapInArrow(_merged, "lid long, gid long, digest long, n long")
    counts = merged.join(_checked(kept), ["lid", "digest"], "left_semi").select("lid", "gid", "digest", "n", F.lit(0).alias("sub"))
    terms = names.where("term = last").select("lid", "digest", F.lit(0).alias("sub"), "term")
    shared = names.where("term <> last").select("lid", "digest")
    if shared.isEmpty():
        return written(counts, "divergence-counts"), terms
    # several terms share these digests: the texts are read again, and their rows are counted by term
    each = rows.mapInArrow(_by_term(digest_bits), "lid long, gid long, digest long, term string, n long, docs long")
    each = written(each.join(shared, ["lid", "digest"], "left_semi").groupBy("lid", "gid", "digest", "term")
                   .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-shared")
    split = (each.groupBy("lid", "digest", "term").agg(often.alias("often")).where("often").drop("often")
             .withColumn("sub", F.row_number().over(Window.partitionBy("lid", "digest").orderBy("term"))))
    split = written(split, "divergence-split")
    counts = counts.join(shared, ["lid", "digest"], "left_anti").unionByName(
        each.drop("docs").join(split, ["lid", "digest", "term"]).drop("term"))
    return written(counts, "divergence-counts"), terms.unionByName(split)


def _share(n: str, all_: str) -> str:
    """1 + floor(SCALE * (n + SMOOTH) / (all + SMOOTH * terms)), exactly."""
    return f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({n} + {SMOOTH})) div ({all_} + {SMOOTH} * terms)"


def group_stats(groups: DataFrame, counts: DataFrame, terms: DataFrame) -> DataFrame:
    """A row per group: names, its place among the language's sources, kept terms of the language,
    occurrences in the group and the language, the frequency ``zero`` of a term it lacks, blocks of terms.

    Terms of a block: enough for ``CELLS`` with the language's sources, and as many as there
    are sources, so that a block hands on fewer numbers than it holds.
    """
    n = counts.groupBy("lid", "gid").agg(F.sum("n").alias("total"))
    n_lang = counts.groupBy("lid").agg(F.sum("n").alias("lang_total"))
    v = terms.groupBy("lid").agg(F.count(F.lit(1)).alias("terms"))
    sources = groups.groupBy("lid").agg(F.count(F.lit(1)).alias("sources"))
    s = groups.join(sources, "lid").join(n, ["lid", "gid"], "left").join(n_lang, "lid", "left").join(v, "lid", "left")
    s = s.fillna(0, ["total", "lang_total", "terms"])
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("lid").orderBy("source")) - 1)
    s = s.withColumn("zero", F.expr(f"IF(terms = 0, 0L, {_share('0', 'total')})"))
    width = F.greatest(F.expr(f"{CELLS} div sources"), F.least("sources", F.lit(TILE)))
    s = s.withColumn("blocks", F.greatest(F.ceil(F.col("terms") / width), F.lit(1)).cast("long"))
    return written(s, "divergence-groups-stats")


def _distances(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block and pair of tiles: the summed differences of every pair of sources (places a < b)."""
    marks = pdf["mark"].to_numpy()
    places, zero = pdf["place"].to_numpy()[marks], pdf["p"].to_numpy()[marks]
    order = np.argsort(places)
    places, zero = places[order], zero[order]
    cells = pdf[~marks]
    at = np.searchsorted(places, cells["place"].to_numpy())
    term = cells.groupby(["digest", "sub"], sort=False).ngroup().to_numpy()
    p = np.repeat(zero[:, None], term.max(initial=-1) + 1, axis=1)
    p[at, term] = cells["p"].to_numpy()
    first, second = (np.flatnonzero(places // TILE == pdf[t].iloc[0]) for t in ("tile", "other"))
    out = []
    for i in first:
        j = second[second > i]
        out.append(pd.DataFrame({"a": places[i], "b": places[j], "value": np.abs(p[j] - p[i]).sum(axis=1)}))
    return pd.concat(out).assign(lid=pdf["lid"].iloc[0]) if out else pd.DataFrame({"a": [], "b": [], "value": [], "lid": []})


def _pairs(k: DataFrame, stats: DataFrame) -> DataFrame:
    """(lid, a, b, value) for all pairs a <> b of a language's sources."""
    block = F.pmod(F.xxhash64("digest", "sub"), F.col("blocks"))
    cells = k.select("lid", "place", "sources", block.alias("block"), F.lit(False).alias("mark"), "digest", "sub", "p")
    # every source is in every block, with its frequency of terms that it lacks
    marks = stats.select("lid", "place", "sources", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                         F.lit(True).alias("mark"), F.lit(0).cast("long").alias("digest"), F.lit(0).alias("sub"), F.col("zero").alias("p"))
    # pairs of tiles that need a row: one, unless a language has over TILE sources
    tile = F.floor(F.col("place") / TILE).cast("int")
    last = F.floor((F.col("sources") - 1) / TILE).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), last), lambda t: F.struct(F.least(t, tile).alias("tile"), F.greatest(t, tile).alias("other")))
    dealt = cells.unionByName(marks).withColumn("pair", F.explode(pairs)).select(
        "lid", "block", "pair.tile", "pair.other", "place", "mark", "digest", "sub", "p")
    parts = dealt.groupBy("lid", "block", "tile", "other").applyInPandas(_distances, "a int, b int, value long, lid long")
    half = parts.groupBy("lid", "a", "b").agg(F.sum("value").alias("value"))
    return half.unionByName(half.select("lid", F.col("b").alias("a"), F.col("a").alias("b"), "value"))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source", digest_bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources, and the terms that stand out.

    A term is a run of letters A-Z, a-z and non-ASCII characters, A-Z in lower case; each
    language keeps the terms in at least ``min_docs`` of its rows.  Part ``pair``: for every
    other source the absolute differences of the frequencies of kept terms, summed.  Part
    ``term``: the ``top`` kept terms that the source has more often than its language.
    Null text, language and source count as ''.  A repeated row is a document of its own;
    a group without terms still has its pairs; a language of one source has no pairs; no
    rows give no rows.  Equal values rank by item.  A task holds the distinct terms of one
    text and up to ``FLUSH_TERMS`` counts besides, later the distinct digests of a few buckets.  ``digest_bits``: fewer than 64 make terms
    share digests (for tests); the result is the same.
    """
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                      for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups, seed = _groups(d)
    counts, terms = kept_terms(d, seed, min_docs, digest_bits)
    stats = group_stats(groups, counts, terms)
    in_lang = Window.partitionBy("lid", "digest", "sub")
    k = counts.withColumn("lang_n", F.sum("n").over(in_lang))
    k = k.join(_checked(stats).drop("zero"), ["lid", "gid"]).withColumns({"p": F.expr(_share("n", "total")), "q": F.expr(_share("lang_n", "lang_total"))})
    k = written(k.select("lid", "gid", "place", "sources", "blocks", "digest", "sub", "p", "q"), "divergence-shares")

    by_value = Window.partitionBy("lid", "gid").orderBy(F.desc("value"))
    more = k.where("p > q").select("lid", "gid", "digest", "sub", (F.col("p") - F.col("q")).alias("value"))
    # all that tie with the last are kept until their texts decide
    candidates = more.withColumn("r", F.rank().over(by_value)).where(F.col("r") <= top).drop("r")
    names = _checked(stats.select("lid", "gid", "lang", "source"))
    shown = candidates.join(terms, ["lid", "digest", "sub"]).join(names, ["lid", "gid"])
    shown = shown.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    a = _checked(stats.select("lid", F.col("place").alias("a"), "lang", "source"))
    b = _checked(stats.select("lid", F.col("place").alias("b"), F.col("source").alias("item")))
    pairs = _pairs(k, stats).join(a, ["lid", "a"]).join(b, ["lid", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = shown.unionByName(pairs).withColumn("rank", F.row_number().over(ranked))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= top))
