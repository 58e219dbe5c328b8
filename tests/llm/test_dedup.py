"""SimHash groups and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import xxhash

from sondage.llm import components, simhash, substring_dedup

DOCS = "doc_id long, text string, n_words string"


def brute_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and group[j] < group[i]:
                    group[i], changed = group[j], True
    least = {}
    for (id_, _, _), g in zip(rows, group, strict=True):
        if id_ is not None:
            least[g] = min(id_, least.get(g, id_))
    return [(id_, fp, least.get(g)) for (id_, _, _), fp, g in zip(rows, fps, group, strict=True)]


def words(rnd, n):
    return [f"w{rnd.randrange(400)}" for _ in range(n)]


def test_simhash_groups(spark):
    rnd = random.Random(5)
    rows = [(0, None, "x"), (1, "", "x"), (7, " \n", "x"), (8, "one two", "x"), (8, "one two", "x"), (None, "lone text here", "x"),
            (9, "w " * 70_000, "x")]
    for i in range(30):
        base = words(rnd, 200)
        rows.append((10 + 10 * i, " ".join(base), "x"))
        for k in range(rnd.randrange(4)):
            base[rnd.randrange(200)] = "new"
            rows.append((11 + 10 * i + k, "  ".join(base).upper(), "x"))
    rnd.shuffle(rows)
    got = simhash.simhash_groups(spark.createDataFrame(rows, DOCS)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    want = brute_groups(rows)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert any(c not in (None, i) for i, _, c in want)
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_search_finds_all_links():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, size=1500, dtype=np.uint64)
    for i in range(600):  # chains of near points, and a dense cluster
        x[900 + i] = x[i % 40 if i < 300 else 899 + i] ^ np.uint64(1 << int(rng.integers(62))) ^ np.uint64(1 << int(rng.integers(62)))
    x = np.unique(x)
    rng.shuffle(x)
    links = simhash.search(x, len(x), 4)
    want = simhash.Links(len(x))
    want.join(*np.nonzero(simhash.distance(x[:, None], x[None, :]) <= 4))
    assert (links.roots(np.arange(len(x))) == want.roots(np.arange(len(x)))).all()
    # shards: every near pair meets in the home of one of the two
    tree = simhash.Tree(np.sort(x[:400]), 0.1)
    home = tree.home(x)
    visits = {(leaf, int(i)) for leaf, at in tree.visits(x, 4) for i in at}
    a, b = np.nonzero(simhash.distance(x[:, None], x[None, :]) <= 4)
    assert tree.leaves > 4 and all((int(home[j]), int(i)) in visits for i, j in zip(a, b, strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 99), (99, 98), (100, 98), (5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 98: 98, 99: 98, 100: 98}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(rows, window):
    first = {}
    for id_, text in rows:
        w = (text or "").encode().split()
        if id_ is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(id_, first.get(key, id_))
    out = []
    for id_, text in rows:
        w = (text or "").encode().split()
        gone = set()
        if id_ is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < id_:
                    gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((id_, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup(spark):
    rnd = random.Random(2)
    shared, window = words(rnd, 90), 20
    rows = [(0, None), (1, ""), (2, " \t"), (3, "a " * 60), (4, "a " * 25), (5, "a " * 20 + "b " * 20), (None, " ".join(shared))]
    for i in range(6, 60):
        own = words(rnd, rnd.randrange(5, 80))
        at, size = rnd.randrange(60), rnd.randrange(10, 40)
        k = rnd.randrange(len(own))
        text = own[:k] + shared[at:at + size] + own[k:]
        rows.append((rnd.choice((i, i, i + 1)), ("\n " if i % 2 else " ").join(text)))
        if i % 5 == 0:
            rows.append((100 + i, " ".join(text)))
            rows.append((200 + i, " ".join(text[3:])))
    rows += [rows[-1], (300, "x" * 3_000_000 + " " + " ".join(shared)), (301, " ".join(shared) + " " + "y" * 2_500_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)
    got = substring_dedup.substring_dedup(df, window=window).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    # rows of an equal id don't count against each other: the brute force keys by id too
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=key) == sorted(brute_cut(rows, window), key=key)
    for r in got:
        assert sum(s["n"] for s in r["spans"]) == r["n_removed"] and (r["kept_text"] is None) == (r["n_removed"] == 0)
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_shards_are_bounded(spark, tmp_path, monkeypatch):
    """A run of words that is the minimizer in many documents, each with a near copy and other surroundings."""
    rnd, window, most = random.Random(8), 20, 600
    least = lambda run: int(substring_dedup._run_hashes(" ".join(run).encode(), (10,))[0][0])
    licence = min((words(rnd, 10) for _ in range(20_000)), key=least)
    rows = []
    for i in range(100):
        text = words(rnd, 30) + licence + words(rnd, 30)
        rows += [(i, " ".join(text)), (1000 + i, " ".join(["new", *text])), (2000 + i, " ".join([*text[15:], "end"]))]
    match = substring_dedup._match

    def measured(window):
        run = match(window)

        def shard(pdf):
            size = sum(len(t.split()) for t in pdf["words"])
            (tmp_path / f"{size}-{pdf['shard'].iloc[0]}").touch()
            return run(pdf)
        return shard
    monkeypatch.setattr(substring_dedup, "_match", measured)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", most)
    got = substring_dedup.substring_dedup(spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS), window=window).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(brute_cut(rows, window))
    sizes = [int(p.name.split("-")[0]) for p in tmp_path.iterdir()]
    assert sizes and max(sizes) < 3 * most


def test_automaton_names_the_first_document():
    rnd = random.Random(9)
    docs = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 40))] for _ in range(40)]
    automaton = substring_dedup.Automaton()
    for i, d in enumerate(docs):
        automaton.add(d, i)
    for d in docs:
        for size in (1, 3, 6):
            want = [next(i for i, e in enumerate(docs) if any(e[k:k + size] == d[j:j + size] for k in range(len(e)))) for j in range(len(d) - size + 1)]
            assert list(automaton.first_documents(d, size)) == want


def test_run_hashes_agree_across_blocks(monkeypatch):
    joined = " ".join(f"w{i % 97}" for i in range(4000)).encode()
    whole = substring_dedup._run_hashes(joined, (10, 50))
    monkeypatch.setattr(substring_dedup, "BLOCK", 300)
    for a, b in zip(whole, substring_dedup._run_hashes(joined, (10, 50)), strict=True):
        assert (a == b).all()
