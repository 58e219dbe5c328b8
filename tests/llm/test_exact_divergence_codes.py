"""Exact dedup, source divergence and vector codes against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import divergence, exact_dedup, vector_codes
from sondage.llm.common import join_groups
from sondage.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, kept string, digest int, keep_id string"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)  # with clashing names


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a b", " a b", "A b", "a b ", "é ü", "x" * 200_000, "w " * 50_000]
    return [(rnd.choice([None, *range(n // 2)]), rnd.choice(texts) if rnd.random() < 0.5 else "hot\ncopy", rnd.choice([None, "", "en"]), "s") for _ in range(n)]


def brute_groups(rows):
    """text -> (keep_id, rows)"""
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[GAP.sub(" ", text or "")].append(doc_id)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("deliveries", [1, 3])
def test_exact_dedup(spark, deliveries):
    rows = odd_texts(300)
    got = exact_dedup.exact_duplicates(table(spark, rows), deliveries=deliveries).collect()
    want = {sha(t): v for t, v in brute_groups(rows).items()}
    assert len(got) == len(rows)
    assert {r["digest"].hex(): (r["keep_id"], r["group_size"]) for r in got} == want
    stays = collections.Counter(r["digest"].hex() for r in got if r["kept"])
    assert stays == dict.fromkeys(want, 1)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    by_text = collections.Counter((r["doc_id"], r["digest"].hex()) for r in got)
    assert by_text == collections.Counter((i, sha(GAP.sub(" ", t or ""))) for i, t, *_ in rows)


def test_exact_dedup_keeps_rows_and_takes_no_rows(spark):
    rows = odd_texts(80)
    docs = table(spark, rows)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute_groups(rows))
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0 == exact_dedup.deduplicate(docs.limit(0)).count()


def test_exact_dedup_with_text_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y"), (None, "x")], "doc_id string, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {("b", "a", 3, False), ("a", "a", 3, True), (None, "a", 3, False), ("c", "c", 1, True)}


def test_index_is_persistent_and_deliveries_can_be_repeated(spark):
    path = scratch_path(spark, "index")
    first = table(spark, [(5, "a", "", ""), (6, "b", "", "")])
    later = table(spark, [(1, "a", "", ""), (2, "c", "", ""), (3, "c ", "", ""), (4, "c", "", "")])
    exact_dedup.exact_duplicates(first, exact_dedup.DigestIndex(spark, path, 4), deliveries=1)
    index = exact_dedup.DigestIndex(spark, path, 16)  # opened anew: the number of buckets is the one it was made with
    assert index.buckets == 4 and index.table().count() == 2
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(later, index, deliveries=1).collect()}
    assert got == {(1, 5, 1, False), (2, 2, 2, True), (4, 2, 2, False), (3, 3, 1, True)}
    # a delivery that is added again replaces itself
    rows = exact_dedup.digest_rows(later).withColumn("delivery", F.lit(1).cast("long"))
    index.add(rows, 1)
    assert index.table().count() == 4
    assert sorted(r[0] for r in index.resolve(rows).where("kept").select("id").collect()) == [2, 3]


def test_index_side_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), 4)
    rows = exact_dedup.digest_rows(table(spark, odd_texts(40)))
    index.add(rows, 0)
    plan = index.unknown(rows, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = plan[plan.index("SortMergeJoin"):plan.index("Bucketed: true")]
    assert "LeftAnti" in plan
    index_side = plan[plan.rindex("+- Sort ["):]
    assert "digest_index" in index_side and "Exchange" not in index_side


def test_join_groups_splits_off_hot_groups(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 9000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("id").alias("group_size"))
    got = join_groups(rows, groups, ["k"])
    assert got.count() == 20_000 and got.where("group_size = 9000").count() == 9000


TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, min_docs, top):
    tf, df, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        tf[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        others = sorted(s for la, s in groups if la == lang)

        def share(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = share(tf[lang, source]), share(sum((tf[lang, s] for s in others), collections.Counter()))
        pair = [(sum(abs(p[t] - x[t]) for t in kept), s) for s in others if s != source for x in [share(tf[lang, s])]]
        term = [(p[t] - q[t], t) for t in kept if tf[lang, source][t] and p[t] > q[t]]
        for part, items, limit in (("pair", pair, None), ("term", term, top)):
            items = sorted(items, key=lambda i: (-i[0], i[1].encode()))[:limit]
            out |= {(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(items)}
    return out


def audit_rows(n=260, seed=5):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "abé" for b in "xyzuvw"] + ["Don't", "中文", "A_b", "x1y"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s1", "s2", "ü", None])) for i in range(n)]
    return [*rows, (1, None, "fr", "s1"), (1, "", "fr", "s2"), (2, "only one", "it", "s"), (3, "ax " * 300_000, "en", "s2"), (4, "!!!", "en", "quiet")]


@pytest.mark.parametrize("bits", [64, 3])
def test_divergence(spark, bits):
    rows = audit_rows()
    got = divergence.divergence(table(spark, rows).repartition(5), min_docs=9, top=6, digest_bits=bits).collect()
    assert {tuple(r) for r in got} == brute_divergence(rows, 9, 6) and len(got) == len(set(got))


def test_divergence_in_small_blocks(spark, monkeypatch):
    """Several tiles and blocks, flushes within a document and pieces of a text."""
    rows = [(i, t, "en", f"s{i % 11:02d}") for i, (_, t, *_) in enumerate(audit_rows())]
    want = brute_divergence(rows, 9, 6)
    monkeypatch.setattr(divergence, "SMALL_ROWS", 0)
    plain = divergence.divergence(table(spark, rows), min_docs=9, top=6)
    assert {tuple(r) for r in plain.collect()} == want
    monkeypatch.setattr(divergence, "CELLS", 1)
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 3)
    assert {tuple(r) for r in divergence.divergence(table(spark, rows), min_docs=9, top=6).collect()} == want
    text = ("aB c1d " * 1000).encode()
    monkeypatch.setattr(divergence, "PIECE", 10)
    assert [t for p in divergence.pieces(text) for t in p] == [b"ab", b"c", b"d"] * 1000


def test_distances_between_tiles():
    import pandas as pd

    rnd = np.random.default_rng(1)
    p = rnd.integers(1, 100, (divergence.TILE + 5, 3))
    marks = [(i, True, 0, 0, 1) for i in range(len(p))]
    cells = [(i, False, t - 10**18, 1, p[i, t]) for i in range(len(p)) for t in range(3)]
    pdf = pd.DataFrame(marks + cells, columns=["place", "mark", "digest", "sub", "p"]).assign(lid=1, tile=0, other=1)
    got = divergence._distances(pdf)
    assert len(got) == divergence.TILE * 5
    assert (got["value"].to_numpy() == np.abs(p[got["a"]] - p[got["b"]]).sum(axis=1)).all()


def test_divergence_takes_no_rows(spark):
    assert divergence.divergence(table(spark, audit_rows(5)).limit(0)).count() == 0
    nothing = divergence.divergence(table(spark, [(1, "a", "en", "x"), (1, "a", "en", "y")]), min_docs=3).collect()
    assert {tuple(r) for r in nothing} == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


VECTORS = "vec_id long, embedding array<float>, label int, codes string, error string, dim int"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "c", "e", 1) for r in rows], VECTORS)


def brute_codes(vectors, parts, entries, rounds, scale):
    """Full scans with Python integers; ``vectors`` in id order."""
    whole = [[math.floor(scale * c) for c in np.array(v, np.float32).tolist()] for v in vectors]
    w = len(whole[0]) // parts
    cut = [[v[k * w:(k + 1) * w] for v in whole] for k in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for i in range(rounds + 1):
        found = [[nearest(x, book) for x in c] for c, book in zip(cut, books, strict=True)]
        if i == rounds:
            break
        for k in range(parts):
            for e in range(len(books[k])):
                mine = [x for x, (_, f) in zip(cut[k], found[k], strict=True) if f == e]
                if mine:
                    books[k][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [([f[k][i][1] for k in range(parts)], sum(f[k][i][0] for k in range(parts))) for f in [found] for i in range(len(whole))], books


@pytest.mark.parametrize("grain", [4, 1000])
def test_vector_codes(spark, grain):
    """A coarse grain makes many ties and equal entries."""
    rnd = random.Random(grain)
    rows = [(i, [rnd.randint(-grain, grain) / grain for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(400)]
    rows += [(3, rows[3][1], 1), (500, None, 1), (501, [0.0] * 7 + [float("nan")], 1), (502, [0.0, None] * 4, 1), (503, [float("-inf")] * 8, 2),
             (504, [0.5] * 6, 2), (None, [0.25] * 8, None)]
    codes, books = vector_codes.vector_codes(vector_table(spark, rows).repartition(7), parts=4, entries=16, rounds=4, scale=64)
    kept = sorted((r for r in rows if r[0] is None or r[0] < 500), key=lambda r: (r[0] is None, r[0] or 0))
    want, want_books = brute_codes([r[1] for r in kept], 4, 16, 4, 64)
    assert [b.tolist() for b in books] == want_books
    got = codes.collect()
    assert sorted((r["vec_id"] or -1, list(r["codes"]), r["error"]) for r in got) == sorted(
        (k[0] or -1, c, e) for k, (c, e) in zip(kept, want, strict=True))
    by_label = collections.Counter()
    for k, (_, e) in zip(kept, want, strict=True):
        by_label[k[2]] += e
    assert {(r["label"], r["label_error"]) for r in vector_codes.label_errors(codes).collect()} == set(by_label.items())


def test_reassign_equals_a_full_scan():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        book = rnd.integers(-3, 4, (12, 2))
        x = rnd.integers(-4, 5, (100, 2))
        entry, far = vector_codes.nearest(x, book)
        after = book.copy()
        change = rnd.random(12) < rnd.choice([0.0, 0.2, 0.9])
        after[change] += rnd.integers(-1, 2, (change.sum(), 2))
        moved = (after != book).any(axis=1)
        e, d, scanned = vector_codes.reassign(x, entry, far, after, moved)
        full, distance = vector_codes.nearest(x, after)
        assert (e == full).all() and (d == distance).all() and scanned == moved[entry].sum()


def test_large_components_stay_exact(spark):
    rows = [(i, [v, -v, 1e5, 0.1], 1) for i, v in enumerate([1e4, 1e4 + 1, 1e5, 3e5, 2.5e5, 1.0])]
    codes, books = vector_codes.vector_codes(vector_table(spark, rows), parts=2, entries=3, rounds=2, scale=1000)
    want, want_books = brute_codes([r[1] for r in rows], 2, 3, 2, 1000)
    assert [b.tolist() for b in books] == want_books
    assert [(list(r["codes"]), r["error"]) for r in codes.orderBy("vec_id").collect()] == want
    far = vector_table(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 0.0], 1)])
    same, book = vector_codes.vector_codes(far, parts=2, entries=2, rounds=1)
    assert [r["error"] for r in same.collect()] == [0, 0] and book[0][0, 0] == int(np.float32(1e30)) * 1024
    with pytest.raises(Exception, match="beyond a long"):
        vector_codes.vector_codes(far, parts=2, entries=1, rounds=1)


def test_vector_codes_take_few_or_no_rows(spark):
    none, books = vector_codes.vector_codes(vector_table(spark, [(1, None, 1)]))
    assert none.count() == 0 == vector_codes.label_errors(none).count() and books == []
    assert vector_codes.vector_codes(vector_table(spark, [(1, [0.0], 1)]).limit(0))[0].count() == 0
    odd, books = vector_codes.vector_codes(vector_table(spark, [(1, [0.1] * 5, 1), (2, [0.3] * 5, None), (3, [], 1)]))
    assert [b.shape for b in books] == [(2, 2)] * 4 and sorted(r["error"] for r in odd.collect()) == [0, 0]
    assert vector_codes.vector_codes(vector_table(spark, [(1, [], 1)]))[0].first()["error"] == 0


def test_counts_handed_on_in_parts(monkeypatch):
    """Within one process: a task that hands on its counts every few terms, and adds up packed rows in parts."""
    import pyarrow as pa

    rnd = random.Random(8)
    texts = [" ".join(rnd.choices(["aa", "bb", "cc", "dd", "ee"], k=6)) for _ in range(60)]
    gids = [rnd.choice([10, 20, 21]) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([g // 10 for g in gids]), pa.array(gids), pa.array(texts)], names=["lid", "gid", "text"])
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 4)
    rows = list(divergence._partials(3, 64)([batch, batch]))
    packed = [r.filter(pa.compute.is_valid(r.column("bucket"))) for r in rows]
    got = {(r["gid"], r["digest"]): (r["lid"], r["n"]) for b in divergence._merged(iter(packed)) for r in b.to_pylist()}
    want, docs = collections.Counter(), collections.Counter()
    for g, t in zip(gids * 2, texts * 2, strict=True):
        want.update((g, w) for w in t.split())
        docs.update((g // 10, w) for w in set(t.split()))
    digest = {t: int(divergence._digests([t.encode()], 64)[0]) for t in ("aa", "bb", "cc", "dd", "ee")}
    assert got == {(g, digest[t]): (g // 10, n) for (g, t), n in want.items()}
    terms = collections.Counter()
    for b in rows:
        for r in b.to_pylist():
            if r["term"] is not None:
                assert r["digest"] == digest[r["term"]]
                terms[r["lid"], r["term"]] += r["docs"]
    assert terms == docs
