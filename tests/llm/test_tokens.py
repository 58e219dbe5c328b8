"""Token ids, counts, packing and shards against the tokenizers library."""

import functools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sondage.llm import bpe, packing, token_counts, token_shards
from sondage.llm.queries import tokenizer

BYTE, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "'", "é", "É", "İ", "Σ", "ß", "🙂", "中", "1", "23", "<|endoftext|>", "<|startoftext|>",
         ".", "--", "\x1c", "\x85", "́", " \n", "THE", "ing", "ᾳ", "²", "\0", "‍", "aaaa", "    ", "\n\n", "word", " Word", "　", "ŉ"]
LONG = ["", "x" * 3000, "ab " * 2000, " " * 300, "The quick brown fox. " * 200, "é" * 200 + " " + "-" * 100]
DOCS = "doc_id long, text string, length string"


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PARTS, k=rnd.randrange(16))) for _ in range(n)] + LONG


def library(name):
    return Tokenizer.from_file(tokenizer(name))


@pytest.mark.parametrize("name", [BYTE, WORDS])
def test_ids_equal_the_librarys(name):
    every = texts(3000)
    want = [e.ids for e in library(name).encode_batch(every, add_special_tokens=False)]
    enc = bpe.encoder(tokenizer(name))
    for _ in range(2):  # with new and with known words
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(every)] == want


def whole(machine, text):
    return machine.total(token_counts.STRETCH.findall(text))


def chunk_maps(machine, text, k):
    c = token_counts.CONTEXT
    return [token_counts.state_map(machine, text[max(i - c, 0):i], text[i:i + k], text[i + k:i + k + c]) for i in range(0, len(text), k)]


def in_order(machine, text, k):
    state, total, c = token_counts.START, 0, token_counts.CONTEXT
    for i in range(0, len(text), k):
        ((state, n),) = token_counts.state_map(machine, text[max(i - c, 0):i], text[i:i + k], text[i + k:i + k + c], state).values()
        total += n
    return state, total


# pieces longer than the context: one letter, one class, words run together, signs, white space, special strings
RUNS = ["a" * 5000, "ab" * 2500, "the" * 900 + "quick" * 400, "中文" * 900, "é" * 2000, "-=" * 700, " " * 1500 + "x", "\n" * 900 + "'s",
        "'" * 300 + "s" * 300, "<|endoftext|>" * 90, "x" * 200 + "<|endoftext|>" + "1" * 200, "🙂" * 500,
        "".join(random.Random(9).choices("abcdefghijklmnopqrstuvwxyz", k=6000)), "".join(random.Random(8).choices("'sdtrevml", k=2000))]


def test_counts_equal_the_librarys_however_a_text_is_cut():
    machine, rnd, missed = token_counts.Compiled(tokenizer(BYTE)), random.Random(4), 0
    every = [*texts(2000, 2), *("".join(rnd.choices(PARTS, k=90)) for _ in range(100)), *RUNS]
    for text, e in zip(every, library(BYTE).encode_batch(every, add_special_tokens=False), strict=True):
        assert whole(machine, text) == len(e.ids)
        if text:
            k = rnd.randrange(1, 12) if len(text) < 400 else rnd.randrange(70, 400)
            maps = chunk_maps(machine, text, k)
            left = functools.reduce(token_counts.compose, maps)
            half = len(maps) // 2
            if half:
                right = token_counts.compose(functools.reduce(token_counts.compose, maps[:half]), functools.reduce(token_counts.compose, maps[half:]))
                assert left == right
            found = left.get(token_counts.START)
            missed += found is None
            assert found in (None, (token_counts.START, len(e.ids)))
            assert in_order(machine, text, k) == (token_counts.START, len(e.ids))
    assert missed <= len(RUNS) // 4  # those are run in order


def test_states_can_be_forgotten(monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    machine = token_counts.Compiled(tokenizer(BYTE))
    every = [*texts(300, 3), *RUNS[:3]]
    for text, e in zip(every, library(BYTE).encode_batch(every, add_special_tokens=False), strict=True):
        assert whole(machine, text) == len(e.ids)
        if text:
            assert functools.reduce(token_counts.compose, chunk_maps(machine, text, 100))[token_counts.START] == (token_counts.START, len(e.ids))


@pytest.fixture(scope="module")
def rows():
    every = [None, *texts(80, 5), *["same text here"] * 40]
    return [(None if i == 7 else i // 2 if i > 60 else i, t, "clash") for i, t in enumerate(every)]


def test_token_counts(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    got = token_counts.token_counts(df, tokenizer(BYTE), limit=100, chunk_chars=50).collect()
    lib, key = library(BYTE), lambda r: (r[0] is None, r[0] or 0, *r[1:])
    counts = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    want = [(i, len((t or "").encode()), n, n > 100) for (i, t, _), n in zip(rows, counts, strict=True)]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(df.limit(0), tokenizer(BYTE)).count() == 0


def test_long_texts_without_white_space(spark, monkeypatch):
    lib = library(BYTE)
    every = [*RUNS, "a" * 300_001, RUNS[0]]  # chunks in three levels; a repeated row
    df = spark.createDataFrame([(i // 2, t, "") for i, t in enumerate(every)], DOCS)
    want = sorted((i // 2, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(every))
    got = token_counts.token_counts(df, tokenizer(BYTE), chunk_chars=70).drop("over_limit")
    assert sorted(tuple(r) for r in got.collect()) == want
    # no entry state fits: every text is run in order
    monkeypatch.setattr(token_counts, "compose", lambda f, g: {})
    got = token_counts.token_counts(df, tokenizer(BYTE), chunk_chars=70).drop("over_limit")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_packing(spark, rows):
    df, cap, lib = spark.createDataFrame(rows, DOCS), 64, library(BYTE)
    got = packing.pack_documents(df, tokenizer(BYTE), cap, 2).collect()
    want = []
    for id_, text, _ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        n, k = len(ids), -(-len(ids) // cap)
        cuts = [0] + [n - cap * (k - 1) + cap * j for j in range(k)]
        want += [(id_, j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    bound = -(-sum(r["length"] for r in got) // cap)
    assert bound <= len(bins) <= bound + 2
    assert packing.pack_documents(df.limit(0), tokenizer(BYTE), cap).count() == 0


def test_fullest_is_the_best_sum():
    rnd = random.Random(6)
    for _ in range(200):
        left = {rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(rnd.randrange(6))}
        room = rnd.randrange(60)
        sums = {0}
        for length, n in left.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        used = packing.fullest(left, room)
        assert sum(a * n for a, n in used) == max(sums) and all(n <= left[a] for a, n in used)


def test_combinations_use_up_every_piece():
    rnd = random.Random(8)
    counts = {n: rnd.randrange(1, 2000) for n in range(1, 256)} | {256: 10_000}
    plan = packing.combinations(counts, 256)
    used = {}
    for times, uses in plan:
        assert sum(a * n for a, n in uses) <= 256
        for a, n in uses:
            used[a] = used.get(a, 0) + times * n
    assert used == counts
    # no plan does with fewer bins than the tokens fill, or than there are pieces over half a bin
    bound = max(-(-sum(a * n for a, n in counts.items()) // 256), sum(n for a, n in counts.items() if a > 128))
    assert bound <= sum(t for t, _ in plan) <= 1.01 * bound and len(plan) < 2000


def test_token_shards(spark, rows, tmp_path):
    df, lib = spark.createDataFrame(rows, DOCS).repartition(3), library(WORDS)
    got = token_shards.token_shards(df, tokenizer(WORDS), 1).collect()
    ids = [(i, np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t, _ in rows]
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids), key=key)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(in_order)

    manifest, dictionary = token_shards.write_shards(df, tokenizer(WORDS), 1, f"file://{tmp_path}/shards")
    found = [token_shards.Shard(r["path"], token_shards.read_bytes(dictionary)).find(3) for r in manifest.collect()]
    assert any(x is not None and x.tolist() == dict(ids)[3].tolist() for x in found)
    with pytest.raises(ValueError):
        token_shards.Shard(manifest.first()["path"], b"another")
    assert token_shards.token_shards(df.limit(0), tokenizer(WORDS), 1).count() == 0


def test_dictionary_makes_short_documents_smaller(spark):
    import zstandard
    rnd = random.Random(1)
    vocabulary = [f"{a}{b}" for a in ("the", "re", "un", "over") for b in ("ing", "tion", "able", "ness", "s")]
    df = spark.createDataFrame([(i, " ".join(rnd.choices(vocabulary, k=40))) for i in range(3000)], "doc_id long, text string")
    manifest, path = token_shards.write_shards(df, tokenizer(WORDS), 1)
    r = manifest.first()
    shard = token_shards.Shard(r["path"], token_shards.read_bytes(path))
    with_dictionary = int(shard.index[:, 2].max())
    alone = sum(len(zstandard.compress(shard.document(k).tobytes())) for k in range(len(shard.index)))
    assert with_dictionary < 0.9 * alone and manifest.agg(F.sum("n_docs")).first()[0] == 3000


def test_an_id_over_several_shards_keeps_its_place(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "SHARD_BYTES", 300)
    rnd = random.Random(3)
    said = [(5, " ".join(rnd.choices(["one", "two", "red", "sea", "word"], k=40))) for _ in range(60)] + [(i, "x y z") for i in (4, 6, 7, 8)]
    df = spark.createDataFrame(said, "doc_id long, text string")
    got = token_shards.token_shards(df, tokenizer(WORDS), end_id=1).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [4] + [5] * 60 + [6, 7, 8]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
