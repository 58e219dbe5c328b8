"""URL filter, quality rules and mixing against brute force on small tables."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from sondage.llm import mixing, quality_rules, url_filter
from sondage.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_filter(spark):
    rules = [*URL_RULES, ("example.net", "/en/a/", "block"), ("blog.example.net", "/en", "block"), ("net", "/en/a/bbbbbbbbb", "allow")]
    urls = ["http://a.example.net/en/1", "http://example.net/en/a/2?x", "https://BLOG.example.net/en#y", "http://xexample.net/en/",
            "net", None, "", "://", "http://net", "http://net/", "ftp://q.org/fr/z", "http://org/fr", "http://example.com/de/1://q.net/",
            "http://a.example.com:80/de/", "http://b.net/en/a/bbbbbbbbbb", "http://..net/", "http://é.ÉNET.net/Ü\n/x"] * 3
    urls += [f"http://h{i % 7}.example.net/{'en' if i % 2 else 'de'}/{i}" for i in range(200)]
    df = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_filter(df, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(urls)}
    assert url_filter.url_filter(df.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0
    none = url_filter.url_filter(df, spark.createDataFrame([], "host string, path string, action string"))
    assert none.where("verdict <> 'allow' or rule is not null").count() == 0 and none.count() == len(urls)


def brute_counts(text):
    text = text or ""
    words, dup, seen, cover = WORD.findall(text), 0, set(), set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    often = collections.Counter(grams)
    for i, g in enumerate(grams):
        if often[g] > 1:
            cover.update((i, i + 1, i + 2))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


TEXTS = [None, "", " \n\t", "one", "a b c a b c a b c", "x y\nx y\n\n\nx y\r\n", "# * $%&|<> é ü 中 🙂", "a a a a a", "w " * 5000,
         "the cat sat on the cat sat on a mat\x0bend\x0cend"]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*TEXTS, *TEXTS])], DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.base_counts(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate([*TEXTS, *TEXTS])}
    assert quality_rules.base_counts(df.limit(0)).count() == 0


def test_quality_rules_learn_and_apply(spark):
    def text(i):
        words = [f"w{i}x{k}" for k in range(60 + i % 40)]
        return " ".join(f"{w}#$" if i % 4 == 0 else w for w in words)
    df = spark.createDataFrame([(i, text(i), "s") for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 300)] + [(None, 0), (9999, 0), (1, None)], "doc_id long, quality int")
    counts = quality_rules.base_counts(df).cache()
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(counts, labels).collect()}
    held_out = [got[i]["kept"] == (i % 4 != 0) for i in range(300, 400)]
    assert sum(held_out) >= 98 and not any(r["base_failed"] for r in got.values())
    rules = quality_rules.learn(counts.join(labels.dropna(), "doc_id"))
    assert rules and all(c.feature in quality_rules.FEATURES for rule in rules for c in rule)
    # the first rule that fits is named, and the list is one ordered expression
    assert all((r["rule"] is None) == r["kept"] for r in got.values())
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert quality_rules.quality_rules(counts, none).where("not kept").count() == 0


def brute_targets(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        share = rest / sum(w[s] for s in open_) if open_ else 0
        target = {s: cap * sizes[s] if s in stopped else share * w[s] for s in names}
        over = {s for s in open_ if target[s] > cap * sizes[s]}
        if not over:
            return target
        stopped |= over


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 50), ["a", "b", None, "c", "tiny"][0 if i < 500 else i % 5 if i % 5 < 4 else 3]) for i in range(1200)]
    rows += [(2000 + i, "x y z", "tiny") for i in range(4)] + [(1, "w w", "a")] * 3 + [(3000, None, "void"), (None, " ", "a"), (3001, "", "void")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes), (5, 2, 1), 3)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] + r["part"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert key(mixing.mix(df.repartition(5)).collect()) == key(got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.where("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_heavier_documents_are_drawn_more_often(spark):
    df = spark.createDataFrame([(i, "plain words here" if i % 2 else "### $$$ ***", "s") for i in range(4000)]
                               + [(9000 + i, "one two three", "t") for i in range(8000)], DOCS)
    got = mixing.mix(df, weights=(1, 9)).where("source = 's'").groupBy((F.col("doc_id") % 2).alias("plain")).agg(F.sum("part").alias("n"))
    n = {r["plain"]: r["n"] for r in got.collect()}
    assert n[1] > 1.5 * n[0]


def test_buckets_stay_even_at_any_weight(spark):
    # three sources: all weights low, all high, and mixed; the largest bucket stays near the aim
    n = 60_000
    quality = F.expr("case id % 3 when 0 then 0.25 when 1 then 1.0 else 0.25 + 0.75 * (id % 101) / 100 end")
    sized = spark.range(n).withColumn("source", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string"))).withColumn("quality", quality)
    sized = sized.withColumn("key", -F.log((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))) / F.col("quality"))
    got = mixing.key_buckets(sized).cache()
    assert got.count() == n
    sizes = got.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
    assert max(r["n"] for r in sizes) < 1.3 * mixing.BUCKET_ROWS and len(sizes) >= 30
    for source in (None, "1", "2"):
        spans = sorted((r["bucket"], r["a"], r["b"]) for r in sizes if r["source"] == source)
        assert all(x[2] < y[1] for x, y in zip(spans, spans[1:], strict=False))
    got.unpersist()
