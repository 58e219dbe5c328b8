"""WARC archives, nearest neighbours and the corpus pipeline."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sondage.llm import multi_index, pipeline, warc

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark):
    big = "".join(random.Random(1).choices("abc é中\r\n\r\nWARC/1.1", k=5000))
    rows = [(1, "http://a/", "x"), (2, None, None), (3, "u\r\nv", ""), (5, "http://b/", "x"), (4, "http://c/", big), (9, "q", big), (9, "q", big),
            (8, "r", big + "!"), (None, "s", "x"), (None, "t", "only here"), (7, "w", "\r\n\r\n"), (7, "w", "\r\n\r\n")] * 2
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, n string")
    for chunk in (64, 1 << 18):
        archive = warc.write_archive(df, chunk_bytes=chunk)
        got = warc.read_archive(archive).collect()
        least = {}
        for i, _, h in rows:
            least[h or ""] = min((x for x in (i, least.get(h or "")) if x is not None), default=None)
        want = []
        for i, _, h in rows:
            body, m = (h or "").encode(), least[h or ""]
            revisit = m is not None and i != m
            want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", m if revisit else None))
        key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
        assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
        assert archive.agg(F.max(F.length("data"))).first()[0] < chunk + 700

    # the bytes are WARC records one after the other, by a plain parser
    data, n = b"".join(warc.warc_bytes(archive)), 0
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        body, end, data = data[:size], data[size:size + 4], data[size + 4:]
        assert head.startswith(b"WARC/1.1\r\n") and end == b"\r\n\r\n"
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        n += 1
    assert n == len(rows)
    assert warc.read_archive(warc.write_archive(df.limit(0))).count() == 0
    assert warc.read_archive(warc.write_archive(df, min_bytes=10**6)).where("record_type = 'revisit'").count() == 0


def test_warc_damage_is_found(spark):
    df = spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string")
    bad = warc.write_archive(df).withColumn("data", F.encode(F.regexp_replace(F.decode("data", "UTF-8"), "payload", "payloaf"), "UTF-8"))
    with pytest.raises(Exception, match="length or digest differs"):
        warc.read_archive(bad)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[700:1100] = x[3]  # a large group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [math.nan] * 16), (5004, [math.inf] + [1.0] * 15), (None, x[0].tolist()),
             (5005, [1.0, None] + [0.0] * 14), (5006, [1.0, 2.0]), (5, x[5].tolist())]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "vec_id long, embedding array<double>, score double")
    got = multi_index.nearest(df, df.where("vec_id % 50 = 0"), top=5, recall=0.97).collect()
    ids = np.array([*range(1500), 5])
    every = np.vstack([x, x[5]])
    norm = np.sqrt((every * every).sum(axis=1))
    hit = 0
    for q in range(0, 1500, 50):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and q not in [m[1] for m in mine]
        cosine = every @ every[q] / (norm * norm[q])
        best = [int(ids[i]) for i in np.lexsort((ids, -np.round(cosine, 12))) if ids[i] != q][:5]
        hit += len(set(best) & {m[1] for m in mine})
        for _, i, s in mine:
            assert s == pytest.approx(cosine[i], abs=1e-12)
        if q in range(700, 1100):  # ties go to the smaller ids
            assert [m[1] for m in mine] == best
    assert hit >= 0.9 * 150 and len(got) == 150
    few = df.where("vec_id in (0, 1, 2)")
    assert multi_index.nearest(few, few.where("vec_id = 0")).count() == 2
    assert multi_index.nearest(df.limit(0), df).count() == 0 and multi_index.nearest(df, df.limit(0)).count() == 0


def test_repeated_queries_are_answered_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[50]] * 4 + [rows[100], (150, (-x[150]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = multi_index.nearest(df, df.where("vec_id % 50 = 0"), top=5, recall=1.0).collect()
    norm = np.sqrt((x * x).sum(axis=1))
    for q in (50, 100):
        cosine = x @ x[q] / (norm * norm[q])
        cosine[q] = -2
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [k for k, _ in mine] == [1, 2, 3, 4, 5]
        assert len({i for _, i in mine}) == 5 and len({i for _, i in mine} & set(np.argsort(-cosine)[:5].tolist())) >= 4
    assert sorted(r["rank"] for r in got if r["query_id"] == 150) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_a_repeated_id_leaves_room_for_equal_vectors(spark):
    # id 0 fills its class seven times over; the answer to it is the other rows of that class
    v, w = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [(0, v)] * 7 + [(i, v) for i in (9, 4, 7, 3, 8, 8, 8)] + [(1, w)] * 8
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r["rank"]: r["vec_id"] for r in multi_index.nearest(df, df.where("vec_id = 0"), top=5).collect()}
    assert [got[k] for k in sorted(got)] == [3, 4, 7, 8, 8]
    other = multi_index.nearest(df, df.where("vec_id = 9"), top=5).collect()
    assert [r["vec_id"] for r in sorted(other, key=lambda r: r["rank"])] == [0] * 5


def test_the_last_visited_cell_is_searched():
    # a query takes its cells along, so they hold what they were counted to hold, however queries are batched
    rng = np.random.default_rng(6)
    x = multi_index._unit(rng.normal(size=(3000, 24)))
    index = multi_index.MultiIndex(x, 3000)
    counts = np.bincount(index.cells(x), minlength=index.k ** 2)
    starts = np.concatenate(([0], np.cumsum(counts)))
    for q, (a, b) in enumerate(zip(*index.near(x[:60]), strict=True)):
        cells = multi_index.visited_cells(index, a, b, counts, 400)
        assert counts[cells].sum() >= 400 > counts[cells].sum() - counts[cells].max() and (counts[cells] > 0).all(), q
        assert sorted({c for at in multi_index.places(cells, starts).values() for c in at}) == cells.tolist()
    whole = np.array([4, 9]), np.array([0, 0, 0, 0, 0, 20_000, 20_000, 20_000, 20_000, 20_000, 20_010])
    assert multi_index.places(*whole) == {0: [4], 1: [4], 2: [4, 9]}


def test_clustered_vectors(spark):
    # two queries of each cluster; a third of all vectors lies in one of them; scores don't depend on blocks
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 4
    which = np.where(rng.random(4000) < 0.33, 0, rng.integers(40, size=4000))
    x = centres[which] + rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = multi_index.nearest(df, df.where("vec_id % 50 = 0"), top=5).collect()
    unit = multi_index._unit(x)
    hit = 0
    for q in range(0, 4000, 50):
        cosine = unit @ unit[q]
        cosine[q] = -2
        hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-cosine)[:5].tolist()))
    assert len(got) == 400 and hit >= 0.9 * 400


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    order = list(multi_index.traverse(a, b))
    assert [round(d, 12) for d, _, _ in order] == sorted(round(x + y, 12) for x in a for y in b)
    assert {(i, j) for _, i, j in order} == {(i, j) for i in range(7) for j in range(5)}


def documents(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline(spark):
    """Stage by stage on the smallest tables, with planted cases."""
    rnd = random.Random(3)
    clean = lambda n: " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(5000)}" for _ in range(n))
    passage = clean(80)
    rows = [(10_000 + i, clean(120), "en", "src1") for i in range(20)]
    rows += [(20_000, rows[0][1], "en", "src2"), (20_001, rows[1][1] + "\n", "en", "src3"), (20_002, "too short", "en", "src1"), (20_003, None, "en", None),
             (20_004, clean(60) + "\n" + passage + " " + clean(60), "en", "src1"), (20_005, clean(200) + " " + passage, "en", "src1")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(documents(spark, rows))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "packing"]

    judged = stages["quality_rules"](spark, docs, SF).cache()
    assert judged.columns == list(pipeline.COLUMNS)
    ids = {r["doc_id"] for r in judged.collect()}
    assert {10_000 + i for i in range(20)} <= ids and not ids & {20_002, 20_003}

    single = stages["simhash_near_dedup"](spark, judged, SF).cache()
    ids = {r["doc_id"] for r in single.collect()}
    assert {10_000 + i for i in range(20)} <= ids and not ids & {20_000, 20_001} and single.count() == len(ids)

    cut = stages["substring_dedup"](spark, single, SF).cache()
    text = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert passage in text[20_004] and passage not in text[20_005] and len(text[20_005].split()) == 200
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where("doc_id >= 10000").collect())
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert all(len(t.split()) == len(before[i].split()) or t == " ".join(t.split()) for i, t in text.items())

    mixed = stages["source_mixing"](spark, cut, SF).cache()
    assert mixed.columns == list(pipeline.COLUMNS)
    assert all(text[r["doc_id"]] == r["text"] for r in mixed.collect())
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3

    packed = stages["packing"](spark, mixed, SF)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    assert packed.where("piece = 0").count() == mixed.count()


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None), (None, "a b c", "en", "s"), (2, "", "en", "s"), (2, "x " * 80, "en", None), (2, "x " * 80, "en", None), (2, "y z", "en", "s"),
            (None, "a b c", "en", "s"), (3, " ".join(f"w{i}" for i in range(3000)), "en", "t")]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        kept = [(r["doc_id"], (r["text"] or "")[:5]) for r in out.collect()] if "text" in out.columns else out.count()
        if name == "simhash_near_dedup":  # a row per group; the nameless rows are one, as their text is
            assert sorted((i or 0, t) for i, t in kept) == [(0, "a b c"), (1, ""), (2, "x x x"), (2, "y z"), (3, "w0 w1")]
        elif name == "substring_dedup":
            assert len(kept) == len(rows)
        elif name == "packing":
            assert kept >= len(rows)


def test_each_group_keeps_one_row(spark):
    """Ids that occur with different texts, and rows without an id."""
    rnd = random.Random(11)
    base = {k: [f"{k}{rnd.randrange(900)}" for _ in range(300)] for k in "abcdef"}
    copy = lambda k: " ".join([*base[k][:-1], "other"])
    text = {k: " ".join(v) for k, v in base.items()}
    # group a is led by 5; 5 is in groups b (led by 2) and c (its own), too; d has no id; e has one beside a nameless row; f is alone
    rows = [(5, text["a"]), (8, copy("a")), (2, text["b"]), (5, copy("b")), (5, text["c"]), (5, copy("c")), (None, text["d"]), (None, copy("d")),
            (None, text["d"]), (None, text["e"]), (9, copy("e")), (5, text["f"])]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = sorted((r["text"][0], r["doc_id"] or 0) for r in pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert got == [("a", 5), ("b", 2), ("c", 5), ("d", 0), ("e", 9), ("f", 5)]


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "piece", "start"]
