"""URL filters by a sort-merge range join.

A rule names a host and a path prefix.  It fits its host and all sub-domains
whose path starts with the prefix; the longest fitting rule decides.

Reversing the labels of a host (``blog.example.net`` -> ``net.example.blog.``)
makes "this host and its sub-domains" a prefix, hence an interval of sorted keys.
URLs and rules are dealt to the same key ranges (cut at quantiles of a bounded
sample of (key, path, id), so even one host with a third of the rows is cut), a
rule going to every range its interval overlaps.  Each range is sorted and swept
once; a stack holds the rule hosts whose interval covers the current key, nested
ones on top, and each of them its path prefixes with a link to the next shorter
prefix.  URLs are shuffled once, and neither side is collected or broadcast.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, shuffle_partitions, spread_sample

SAMPLE_ROWS = 8192  # rows that place the cuts between ranges; they only balance the work


def split_url(url) -> tuple:
    """(host, path) columns: host after the first ``://``, A-Z lower-cased; both empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), path


def reversed_host(host):
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


class _Paths:
    """Path prefixes of one rule host: the longest that starts a given path."""

    def __init__(self):
        self.known: dict[str, tuple] = {}
        self.sorted: list[str] | None = None
        self.shorter: list[int] = []

    def add(self, path: str, rule: tuple) -> None:
        # equal rules: the smaller (rule, action) stands, so "allow" wins over "block"
        self.known[path] = min(rule, self.known.get(path, rule))
        self.sorted = None

    def longest(self, path: str) -> tuple | None:
        if self.sorted is None:
            self.sorted, self.shorter, stack = sorted(self.known), [], []
            for i, p in enumerate(self.sorted):
                while stack and not p.startswith(self.sorted[stack[-1]]):
                    stack.pop()
                self.shorter.append(stack[-1] if stack else -1)
                stack.append(i)
        i = bisect_right(self.sorted, path) - 1
        while i >= 0 and not path.startswith(self.sorted[i]):
            i = self.shorter[i]
        return self.known[self.sorted[i]] if i >= 0 else None


OUT = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()),
                 ("rule", pa.string()), ("verdict", pa.string())])


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, _Paths]] = []
        part = None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for pid, key, path, id_, host, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pid != part:
                    stack, part = [], pid
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if action is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, _Paths()))
                    stack[-1][1].add(path, (host + path, action))
                    continue
                fits = [r for _, paths in stack if (r := paths.longest(path))]
                # the longest; of equally long ones that of the longer host (further up the stack)
                best = max(reversed(fits), key=lambda r: len(r[0]), default=(None, default))
                for column, value in zip(out, (id_, host, path, *best), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, OUT.types, strict=True)], schema=OUT)
    return run


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Judge every row of ``pages``: (id, host, path, rule, verdict).

    ``rules``: (host, path, action); rows with a null in any of them are no rules.
    A null URL or one without ``://`` has an empty host and path and gets
    ``default`` (as does any URL that no rule fits).  Equal URLs and equal ids are
    judged row by row; other columns of ``pages`` are not read.  Of two rules with
    equal host and path the action that sorts first stands.  An empty table gives none.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    points = (pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
              .withColumn("key", reversed_host(F.col("host"))))
    sample = (spread_sample(points, SAMPLE_ROWS, pages.count(), "id", "key", "path")
              .select("key", "path", F.coalesce("id", F.lit(-1)).alias("id")).collect())
    n = 4 * shuffle_partitions(spark)
    sample = sorted(tuple(r) for r in sample)
    cuts = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []

    fields = "pid int, key string, path string, id long, host string, action string"
    schema = pa.schema([("pid", pa.int32()), ("key", pa.string()), ("path", pa.string()), ("id", pa.int64()),
                        ("host", pa.string()), ("action", pa.string())])

    def deal_points(batches):
        for b in batches:
            id_, host, path, key = (c.to_pylist() for c in b.columns)
            pid = [bisect_right(cuts, (k, p, -1 if i is None else i)) for i, p, k in zip(id_, path, key, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pid, pa.int32()), pa.array(key, pa.string()), pa.array(path, pa.string()),
                 pa.array(id_, pa.int64()), pa.array(host, pa.string()), pa.nulls(len(pid), pa.string())], schema=schema)

    def deal_rules(batches):
        for b in batches:
            rows = []
            for host, path, action, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # the interval of keys that start with ``key`` ends before its last "." turned into "/"
                first, last = bisect_right(cuts, (key, "", -2)), bisect_right(cuts, (key[:-1] + "/", "", -2))
                rows += [(pid, key, path, None, host, action) for pid in range(first, last + 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    keyed = (rules.select("host", "path", F.col("action")).dropna()
             .withColumn("host", F.translate("host", UPPER, UPPER.lower()))
             .withColumn("key", reversed_host(F.col("host"))))
    events = points.select("id", "host", "path", "key").mapInArrow(deal_points, fields).unionByName(
        keyed.mapInArrow(deal_rules, fields))
    # rules (action not null) come before the URLs of an equal key
    return (events.repartition(shuffle_partitions(spark), "pid")
            .sortWithinPartitions("pid", "key", F.col("action").isNull(), "path", "id")
            .select("pid", "key", "path", "id", "host", "action")
            .mapInArrow(_sweep(default), "id long, host string, path string, rule string, verdict string")
            .withColumnRenamed("id", id_col))
