"""Text operators: spelling vs brute force, translation memory, themes invariants."""

import collections
import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from sondage.operators import text as X
from sondage.operators import themes as TH


def lev(a, b):
    """Edits between a and b: letters inserted, dropped or changed, neighbours swapped."""
    seen = {}  # the unrestricted distance: letters may come between swapped ones
    d = {(-1, j): len(a) + len(b) for j in range(-1, len(b) + 1)} | {(i, -1): len(a) + len(b) for i in range(-1, len(a) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), last
            if x == y:
                last = j
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1,
                          d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1) if k and m else len(a) + len(b))
        seen[x] = i
    return d[len(a), len(b)]


def test_spelling_matches_brute_force(spark):
    rnd = random.Random(3)
    dic = {w: rnd.randint(1, 50) for w in ["sweet", "sweat", "creamy", "fresh", "bitter", "butter", "salty",
                                           "to", "too", "a", "milk", "silk"]}
    queries = ["swet", "sweeet", "creamt", "frsh", "bittr", "buter", "salty", "tooo", "t", "milkk", "xyzzy",
               "sweetnes", "ab", "fresh", "frehs", "mikl", "ot", "lsaty", "rbeitter", "bteur"]
    exp = {}
    for q in queries:
        if q in dic:
            exp[q] = q
            continue
        cands = [(lev(q, w), -f, w) for w, f in dic.items() if lev(q, w) <= 2]
        exp[q] = min(cands)[2] if cands else q
    words = spark.createDataFrame([(q,) for q in queries], "word string")
    d = spark.createDataFrame(list(dic.items()), "word string, freq long")
    got = {r["word"]: r["corrected"] for r in X.spelling_corrections(words, d).collect()}
    assert got == exp


def test_spell_summary_counts(spark):
    df = spark.createDataFrame([("Swet, creamy",), ("sweet,,Creamy ",), (None,)], "t string")
    d = spark.createDataFrame([("sweet", 10), ("creamy", 5)], "word string, freq long")
    got = {r["item"]: (r["count"], r["pct"]) for r in X.spell_summary(df, ["t"], d).collect()}
    assert got == {"sweet": (2, 50.0), "creamy": (2, 50.0)}


def test_translate_memory(spark):
    df = spark.createDataFrame([(1, "bonjour", "fr"), (2, "hello", "en"), (3, "salut", "fr"), (4, "  ", "fr")],
                               "id int, text string, lang string")
    tm = spark.createDataFrame([("fr", "bonjour", "hello"), ("fr", "bonjour", "hello"), ("en", "hello", "x")],
                               "lang string, text string, translated string")
    got = {r["id"]: r["text_translated"] for r in X.translate_tm(df, "text", "lang", "fr", tm).collect()}
    assert got == {1: "hello", 2: "hello", 3: "salut", 4: ""}


def test_themes_invariants(spark):
    topics = [["milk", "cream", "dairy", "butter"], ["train", "rail", "station", "ticket"],
              ["guitar", "song", "music", "band"]]
    rnd = random.Random(11)
    rows = []
    for i in range(90):
        t = topics[i % 3]
        rows.append((i, " ".join(rnd.choice(t) for _ in range(12))))
    rows.append((999, "?? !!"))  # no vocabulary term
    df = spark.createDataFrame(rows, "id long, text string")
    res = X.themes(df, "id", "text", n_topics=3, outer=20, inner=15)
    th = res["themes"].orderBy("theme").collect()
    assert len(th) == 3
    term_sets = [set(r["top_terms"].split(", ")[:4]) for r in th]
    for t in topics:  # every planted topic is recovered by one theme
        assert any(len(set(t) & s) >= 3 for s in term_sets)
    a = {r["id"]: r["assigned"] for r in res["assignments"].collect()}
    assert len(a) == 91 and a[999] == [1]  # all-zero row -> first theme (argmax)
    assert sum(r["count"] for r in th) >= 91
    ex = res["exemplars"].collect()
    assert all(r["rank"] <= 3 for r in ex)


def test_unicode_words(spark):
    df = spark.createDataFrame([("Crème brûlée, crème",)], "t string")
    wc = {r["word"]: r["freq"] for r in X.word_counts(df, "t").collect()}
    assert wc == {"crème": 2, "brûlée": 1}
    d = spark.createDataFrame([("crème", 5)], "word string, freq long")
    w = spark.createDataFrame([("crème",), ("crme",)], "word string")
    assert {r["word"]: r["corrected"] for r in X.spelling_corrections(w, d).collect()} == {
        "crème": "crème", "crme": "crème"}


def test_translate_service_variant(spark):
    df = spark.createDataFrame([(1, "bonjour", "en"), (2, "nan", "fr"), (3, None, "fr"), (4, "salut", "fr")],
                               "id int, text string, lang string")
    tm = spark.createDataFrame([("fr", "bonjour", "hello")], "lang string, text string, translated string")
    got = {r["id"]: r["text_translated"] for r in
           X.translate_tm(df, "text", None, "fr", tm, check_language=False).collect()}
    assert got == {1: "hello", 2: "nan", 3: None, 4: "salut"}
    got2 = {r["id"]: r["text_translated"] for r in X.translate_tm(df, "text", "lang", "fr", tm).collect()}
    assert got2 == {1: "bonjour", 2: "nan", 3: "", 4: "salut"}


def test_spelling_of_random_words(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abc", k=rnd.randint(1, 9)))
    dic = {word(): rnd.randint(1, 9) for _ in range(80)}
    queries = {word() for _ in range(120)} | {"z" * 10_000}
    for _ in range(60):  # long words with two swaps or edits anywhere, at the edges of segments too
        w = "".join(rnd.choices("abcde", k=rnd.randint(12, 22)))
        dic[w] = rnd.randint(1, 9)
        for _ in range(3):
            q = list(w)
            for _ in range(2):
                i = rnd.randrange(len(q) - 1)
                q[i:i + 2] = rnd.choice([[q[i + 1], q[i]], [q[i + 1], q[i]], [q[i]], [q[i], "b", q[i + 1]], ["d", q[i + 1]]])
            queries.add("".join(q))
    exp = {}
    for q in queries:
        near = [(d, -f, w) for w, f in dic.items() if abs(len(w) - len(q)) <= 2 and (d := lev(q, w)) <= 2]
        exp[q] = q if q in dic else min(near)[2] if near else q
    got = X.spelling_corrections(spark.createDataFrame([(q,) for q in queries], "word string"),
                                 spark.createDataFrame(list(dic.items()), "word string, freq long"))
    assert {r["word"]: r["corrected"] for r in got.collect()} == exp


# --- themes ---------------------------------------------------------------------------------------


def dense_nmf(x, k, iters=2000, tol=1e-4):
    """Non-negative factorisation as the usual library does it, dense: NNDSVD start with zeros filled by the mean,
    one coordinate descent sweep of W, then of H, until the violation is ``tol`` of the first."""
    u, s, v = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((len(x), k)), np.zeros((k, x.shape[1]))
    w[:, 0], h[0] = np.sqrt(s[0]) * abs(u[:, 0]), np.sqrt(s[0]) * abs(v[0])
    for t in range(1, k):
        sides = [(np.maximum(sign * u[:, t], 0), np.maximum(sign * v[t], 0)) for sign in (1, -1)]
        size, a, b = max(((np.linalg.norm(a) * np.linalg.norm(b), a, b) for a, b in sides), key=lambda z: z[0])
        w[:, t], h[t] = np.sqrt(s[t] * size) * a / np.linalg.norm(a), np.sqrt(s[t] * size) * b / np.linalg.norm(b)
    w[w < 1e-6], h[h < 1e-6] = x.mean(), x.mean()

    def sweep(m, gram, b):
        off = 0.0
        for t in range(k):
            grad = m @ gram[t] - b[:, t]
            off += np.abs(np.where(m[:, t] == 0, np.minimum(grad, 0), grad)).sum()
            if gram[t, t]:
                m[:, t] = np.maximum(m[:, t] - grad / gram[t, t], 0)
        return off

    first = None
    for _ in range(iters):
        ht = h.T.copy()
        off = sweep(w, h @ h.T, x @ h.T) + sweep(ht, w.T @ w, x.T @ w)
        h = ht.T
        first = first or off
        if off <= tol * first:
            break
    return w, h


def answers(n=150, seed=6):
    rnd = random.Random(seed)
    topics = [["taste", "sweet", "sugar", "flavour", "honey"], ["box", "pack", "lid", "open", "seal"], ["price", "cost", "cheap", "money", "shop"],
              ["taste", "box", "price", "nice", "good"]]
    return [(i, " ".join(rnd.choices(topics[i % 4], k=9)) + "  ​" + rnd.choice(["Great!", "bad", ""])) for i in range(n)]


def test_factorisation_agrees_with_a_dense_one(spark):
    df = spark.createDataFrame(answers(), "id long, text string")
    res = X.themes(df, "id", "text", n_topics=4, tol=1e-4)
    terms = res["vocab"]
    maker = TH.Vectoriser(2, frozenset(StopWordsRemover.loadDefaultStopWords("english")))
    texts = [re.sub(r"\s+", " ", t.replace("​", " ")).strip() for _, t in answers()]
    docs = [maker.grams(t) for t in texts]
    counts = collections.Counter(g for d in docs for g in d)
    df_ = collections.Counter(g for d in docs for g in set(d))
    assert terms == sorted(t for t in counts if df_[t] >= 2)
    x = np.array([[d.count(t) * (np.log((1 + len(docs)) / (1 + df_[t])) + 1) for t in terms] for d in docs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w, h = dense_nmf(x, 4, tol=1e-6)
    mine = res["H"]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    assert np.abs(unit(mine) - unit(h)).max() < 0.01  # topics in the same order, too
    ours = TH.solve(x @ mine.T, mine @ mine.T)
    assert np.linalg.norm(x - ours @ mine) <= np.linalg.norm(x - w @ h) * 1.001
    again = X.themes(df.repartition(5), "id", "text", n_topics=4, tol=1e-4, seed=99)
    assert np.abs(again["H"] - mine).max() < 1e-3  # neither the seed nor the partitions show


def test_leading_vectors_equal_an_svd(spark):
    rnd = np.random.default_rng(3)
    x = rnd.random((60, 30)) * (rnd.random((60, 30)) < 0.3)
    rows = spark.createDataFrame([(0, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for r in x], "col int, idx array<int>, val array<double>")
    values, v, norms = TH.leading_vectors(rows, {0: 30}, {0: 5}, 1)[0]
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert values == pytest.approx(s[:5])
    for t in range(5):
        sign = np.sign(v[:, t] @ vt[t])
        assert v[:, t] * sign == pytest.approx(vt[t], abs=1e-4)
        a, b = (np.linalg.norm(np.maximum(z * u[:, t], 0)) for z in (sign, -sign))
        assert norms[:, t] == pytest.approx([a, b], abs=1e-4)


def test_solve_is_the_best_non_negative_solution():
    rnd = np.random.default_rng(2)
    h = rnd.random((3, 8))
    x = rnd.standard_normal((20, 8))
    w = TH.solve(x @ h.T, h @ h.T)
    grad = w @ h @ h.T - x @ h.T
    assert (w >= 0).all() and np.abs(np.where(w > 0, grad, np.minimum(grad, 0))).max() < 1e-6
    assert (TH.solve(np.zeros((2, 2)), np.zeros((2, 2))) == 0).all()


def test_several_columns_at_once(spark):
    rows = [(i, t, None, "the and of", "blue green red" if i % 2 else "  ", 5) for i, t in answers(60)]
    df = spark.createDataFrame(rows, "id long, likes string, empty string, stops string, few string, col int")
    out = X.theme_analysis(df, "id", ["likes", "empty", "stops", "absent", "few"], save_name="wave1", n_topics=3)
    d = json.loads(out["dictionary"].first()["json"])
    assert (d["save_name"], d["language"], list(d["columns"])) == ("wave1", "en", ["likes", "empty", "stops", "few"])
    assert d["meta"] == {"method": "TF-IDF + NMF", "assign_threshold": 0.35, "min_df": 2, "max_features": 5000, "top_terms": 8, "random_state": 42}
    assert d["columns"]["empty"] == {"themes": []}
    assert [len(d["columns"][c]["themes"]) for c in ("likes", "stops", "few")] == [3, 3, 3]
    assert {t for x in d["columns"]["stops"]["themes"] for t in x["top_terms"]} == {"the", "and", "of"}  # fell back to all words
    alone = X.themes(df, "id", "likes", n_topics=3)
    assert [x["label"] for x in d["columns"]["likes"]["themes"]] == [r["label"] for r in alone["themes"].orderBy("theme").collect()]
    verbatims = out["assignments"].collect()
    by_column = collections.Counter(r["oe_column"] for r in verbatims)
    assert by_column == {"likes": 60, "stops": 60, "few": 30}
    texts = dict(answers(60))
    for r in verbatims:
        themes = d["columns"][r["oe_column"]]["themes"]
        assert r["assigned_themes"] == " | ".join(themes[i - 1]["label"] for i in r["assigned"]) and r["assigned"]
        assert r["oe_column"] != "likes" or r["verbatim"] == texts[r["id"]]  # as it was written
    overview = out["themes"].collect()
    assert {(r["oe_column"], r["theme"]): r["count"] for r in overview} == {
        (c, t): sum(t in r["assigned"] for r in verbatims if r["oe_column"] == c) for c in by_column for t in (1, 2, 3)}
    assert all(r["pct"] == pytest.approx(100 * r["count"] / by_column[r["oe_column"]]) for r in overview)
    assert {r["oe_column"] for r in out["exemplars"].collect()} == set(by_column)


def test_themes_without_any_term(spark):
    empty = spark.createDataFrame([], "id long, text string")
    signs = spark.createDataFrame([(1, "?!"), (2, "a b"), (3, None)], "id long, text string")
    for df, n in ((empty, 0), (signs, 2)):
        out = X.themes(df, "id", "text")
        assert out["themes"].count() == 0 == out["exemplars"].count() and out["k"] == 0
        got = out["assignments"].collect()
        assert len(got) == n and all(r["assigned"] == [] and r["assigned_themes"] == "" for r in got)
        assert json.loads(out["dictionary"].first()["json"])["columns"] == {"text": {"themes": []}}
    nothing = X.theme_analysis(empty, "id", ["absent"])
    assert json.loads(nothing["dictionary"].first()["json"])["columns"] == {} and nothing["assignments"].count() == 0
    assert nothing["themes"].columns == ["oe_column", "theme", "label", "top_terms", "count", "pct", "pct_1dp"]


def test_spelling_of_long_and_odd_words(spark):
    """Around the length where segments take over, edits at every place, and words of one letter."""
    rnd = random.Random(12)
    base = ["".join(rnd.choices("abcdef", k=n)) for n in range(1, 19) for _ in range(4)]
    dic = {w: rnd.randint(1, 9) for w in base}
    queries = set()
    for w in base:
        for _ in range(6):
            q = list(w)
            for _ in range(rnd.randint(1, 3)):
                at = rnd.randrange(len(q) + 1)
                q[at:at + rnd.randint(0, 1)] = rnd.choice(["", "a", "é", "x"])
            queries.add("".join(q))
    queries.discard("")
    exp = {}
    for q in queries:
        near = [(d, -f, w) for w, f in dic.items() if abs(len(w) - len(q)) <= 2 and (d := lev(q, w)) <= 2]
        exp[q] = q if q in dic else min(near)[2] if near else q
    got = X.spelling_corrections(spark.createDataFrame([(q,) for q in queries], "word string"),
                                 spark.createDataFrame(list(dic.items()), "word string, freq long"))
    assert {r["word"]: r["corrected"] for r in got.collect()} == exp


def test_spelling_keys_are_selective(spark):
    """Short words of an alphabet: a key meets few of them."""
    words = ["".join(p) for p in itertools.product("abcdefgh", repeat=4)]
    keys = spark.createDataFrame([(w,) for w in words], "word string").select(F.explode(X._own_keys("word", 2)).alias("k"))
    assert keys.groupBy("k").count().agg(F.max("count")).first()[0] < len(words) / 10


def test_vocabulary_in_two_steps_is_the_whole_count(spark, monkeypatch):
    rnd = random.Random(5)
    letters = "abcdefgh"
    texts = [" ".join(a + a + b for a, b in zip(rnd.choices(letters, k=12), rnd.choices(letters[:3], k=12), strict=True))
             + f" solo{i} once{i} the" for i in range(60)]
    docs = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "col int, id int, text string").repartition(3)
    stop = frozenset(["the"])
    plain = TH.Vectoriser(2, stop)
    total, seen = collections.Counter(), collections.Counter()
    for t in texts:
        total.update(plain.grams(t))
        seen.update(set(plain.grams(t)))
    for most, sent in ((10, 1 << 18), (10, 2), (30, 1 << 18), (10_000, 1 << 18)):  # also: too many words to send; all words fit
        monkeypatch.setattr(TH, "PAIR_WORDS", sent)
        best = sorted((t for t in total if seen[t] >= 2), key=lambda t: (-total[t], t))[:most]
        makers = {0: TH.Vectoriser(2, stop)}
        TH.vocabularies(docs, makers, {0: len(texts)}, most, 2)
        assert makers[0].terms == sorted(best)
        assert makers[0].idf.tolist() == [math.log(61 / (1 + seen[t])) + 1.0 for t in sorted(best)]
    # no task gets all terms of a column: each bucket hands on its first ones
    words = spark.createDataFrame([(0, f"w{i}", 1 + i % 7, 2) for i in range(5000)], "col int, term string, total long, docs long")
    assert [t for t, _, _ in TH._most_frequent(words, 4)[0]] == sorted(f"w{i}" for i in range(6, 5000, 7))[:4]
    # a pair with a rare word is not counted
    assert TH._pairs(plain, frozenset(["aa", "bb"]))("aa bb the cc aa the bb") == ["aa bb", "aa bb"]
