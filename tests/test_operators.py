"""Micro cases with hand-derived answers (FIXTURES.md section 3) on tiny DataFrames."""

import math

import pytest
from pyspark.sql import functions as F

from sondage.functions import scalar as S
from sondage.operators import clean as C
from sondage.operators import drivers as D
from sondage.operators import reshape as R
from sondage.operators import sensory as E
from sondage.operators import stats as H
from sondage.operators import summarise as A


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def wide2(spark, xs, ys, col="q"):
    data = [(i, "P1", float(x) if x is not None else None) for i, x in enumerate(xs)]
    data += [(100 + i, "P2", float(y) if y is not None else None) for i, y in enumerate(ys)]
    return spark.createDataFrame(data, f"customer_id long, product string, {col} double")


def test_cliff_and_mwu_effect_m4_m5(spark):
    mw = H.mann_whitney(wide2(spark, [1, 2, 3], [2, 3, 4]), ["q"]).first()
    assert mw["u_statistic"] == 2.0
    assert mw["cliffs_delta"] == pytest.approx(-0.555556, abs=1e-6)
    assert mw["strength"] == "large"
    assert mw["z_r"] == pytest.approx(-1.091089, abs=1e-6)
    assert mw["r"] == pytest.approx(0.445435, abs=1e-6)
    assert mw["r_z_strength"] == "medium"
    # ties present -> asymptotic branch: z=(7-4.5-0.5)/sqrt(9/12*(7-12/30)) , p = 2 sf(z)
    z = (7 - 4.5 - 0.5) / math.sqrt(9 / 12 * (7 - 12 / 30))
    assert mw["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-12)


def test_mwu_exact_small_no_ties(spark):
    mw = H.mann_whitney(wide2(spark, [1, 2, 3], [4, 5, 6]), ["q"]).first()
    assert mw["u_statistic"] == 0.0
    assert mw["p_value"] == pytest.approx(0.1)


def test_mwu_not_enough_data(spark):
    mw = H.mann_whitney(wide2(spark, [1, 2, 3], [None, None]), ["q"]).first()
    assert mw["hypothesis_95"] == "Not enough data" and mw["strength"] == "N/A"


def test_wilcoxon_m6(spark):
    x = [2, 1, 5, 6, 3]
    y = [1, 2, 3, 3, 3]  # diffs 1, -1, 2, 3, 0
    data = [(i, "P1", float(v)) for i, v in enumerate(x)] + [(i, "P2", float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(data, "customer_id long, product string, q double")
    w = H.wilcoxon(df, ["q"]).first()
    assert (w["w_plus"], w["w_minus"], w["statistic"]) == (8.5, 1.5, 1.5)
    assert w["n_pairs"] == 5 and w["n_nonzero"] == 4
    assert w["r"] == pytest.approx(w["z_value"] / math.sqrt(5))


def test_mcnemar_rules(spark):
    # b = 10 (0 -> 1), c = 2 (1 -> 0), plus concordant pairs
    pairs = [(0, 1)] * 10 + [(1, 0)] * 2 + [(1, 1)] * 5 + [(0, 0)] * 3
    data = [(i, "P1", a) for i, (a, b) in enumerate(pairs)] + [(i, "P2", b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(data, "customer_id long, product string, t2b int")
    m = H.mcnemar(df, ["t2b"]).first()
    assert (m["b"], m["c"], m["chi2"], m["e"], m["p_value"]) == (10, 2, 5.3333, "E", 0.0386)
    assert m["confidence_95"].startswith("Reject")


def test_fisher_m3(spark):
    # product P1: 1 zero, 11 ones; P2: 9 zeros, 3 ones -> [[1, 9], [11, 3]]
    data = [(i, "P1", 0.0) for i in range(1)] + [(i, "P1", 1.0) for i in range(1, 12)]
    data += [(i, "P2", 0.0) for i in range(9)] + [(i, "P2", 1.0) for i in range(9, 12)]
    df = spark.createDataFrame(data, "customer_id long, product string, q double")
    f = H.fisher(df, ["q"]).first()
    assert f["p_value"] == pytest.approx(0.0027594562, abs=1e-9)


def test_box_scores_m7(spark):
    df = spark.createDataFrame([("P", float(v) if v else None) for v in [1, 2, 3, 4, 5, 5, None]],
                               "product string, q double")
    b = {r["metric"]: r["value"] for r in A.box_scores(df, ["q"], []).collect()}
    exp = {"Bottom Box": 16.67, "% B2B": 33.33, "% B4B": 66.67, "% Middle": 16.67, "% T2B": 50.0,
           "% T3B": 66.67, "% T4B": 0.0, "Top Box": 33.33, "% TT2B": 0.0, "% TB2B": 33.33}
    for k, v in exp.items():
        assert round(b[k], 2) == v
    assert "Mean" not in b


def test_box_scores_all_null_is_null(spark):
    df = spark.createDataFrame([("P", None), ("P", None)], "product string, q double")
    assert all(r["value"] is None for r in A.box_scores(df, ["q"], ["q"]).collect())


CATA = ["Sweet,Creamy", "Too Sweet", None, "Sweet"]


def cata_df(spark, liking=(8.0, 5.0, 6.0, 9.0)):
    return spark.createDataFrame([(i, "P", c, y) for i, (c, y) in enumerate(zip(CATA, liking))],
                                 "customer_id long, product string, cata string, liking double")


def test_cata_counts_m8(spark):
    r = {x["attribute"]: x for x in A.cata_counts(cata_df(spark), ["cata"]).collect()}
    assert r["Sweet"]["count"] == 2 and round(r["Sweet"]["percentage"], 2) == 66.67
    assert r["Creamy"]["count"] == 1 and r["Too Sweet"]["count"] == 1
    assert round(r["Too Sweet"]["percentage"], 2) == 33.33


def test_cata_penalty_m9(spark):
    sub = {x["attribute"]: x for x in E.cata_penalty(cata_df(spark), "cata", "liking").collect()}
    assert sub["Sweet"]["mean_checked"] == pytest.approx(22 / 3)
    assert sub["Sweet"]["penalty"] == pytest.approx(22 / 3 - 6)
    assert sub["Sweet"]["p_value"] is None  # only one unchecked row
    ex = {x["attribute"]: x for x in E.cata_penalty(cata_df(spark), "cata", "liking", mode="exact").collect()}
    assert ex["Sweet"]["penalty"] == pytest.approx(3.0)


def test_cata_dummies(spark):
    d = rows(R.cata_dummies(cata_df(spark), "cata", ["customer_id"]), "customer_id")
    assert d[0]["cata_Sweet"] == 1 and d[0]["cata_Creamy"] == 1 and d[0]["cata_Too Sweet"] == 0
    assert all(d[2][k] == 0 for k in d[2] if k.startswith("cata_"))


def test_maxdiff_m10(spark):
    df = spark.createDataFrame([("Price:M,Taste:L",), ("Taste:M,Pack:L",), ("broken",)], "md string")
    r = {x["attribute"]: x["net_score"] for x in A.maxdiff(df, ["md"]).collect()}
    assert r == {"Price": 1, "Taste": 0, "Pack": -1}


def test_to_float_m11(spark):
    df = spark.createDataFrame([("-5",), ("1e3",), ("7.0 pts",), ("1.2.3",), (None,)], "v string")
    got = [r[0] for r in C.convert_columns_to_float(df, ["v"]).collect()]
    assert got == [5.0, 13.0, 7.0, None, None]


def test_ten_to_five_m12(spark):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in [1, 2, 3, 9, 10, None, 11]],
                               "v double")
    got = [r[0] for r in df.select(S.ten_to_five("v")).collect()]
    assert got == [1.0, 1.0, 2.0, 5.0, 5.0, None, 11.0]


def test_spearman_pairwise_complete_m13(spark):
    df = spark.createDataFrame([("P", 1.0, 2.0), ("P", 2.0, None), ("P", 3.0, 5.0), ("P", 4.0, 1.0)],
                               "product string, x double, y double")
    r = {(x["q1"], x["q2"]): x["rho"] for x in E.spearman(df, ["x", "y"]).collect()}
    assert r[("x", "y")] == pytest.approx(-0.5) and r[("y", "x")] == pytest.approx(-0.5)
    assert r[("x", "x")] == 1.0


def eav(spark, data):
    return spark.createDataFrame(data, "customerid long, productname string, missiondesc string, attribute string, "
                                       "answerscore double, answer string")


def test_pivot_keeps_keys_m14_m15(spark):
    df = eav(spark, [
        (1, "P", "Visit 1", "Other attribute", 4.0, None),        # only outside the list -> all-null row
        (2, "P", "Visit 1", "Product-3DigitCode-", None, "123"),   # code only
        (3, "P", "Visit 1", "A", 7.0, None),                       # scores only
        (3, "P", "Visit 1", "A", 9.0, None),
        (None, "P", "Visit 1", "A", 5.0, None),                    # NULL key part: blocks stay apart
        (None, "P", "Visit 1", "Product-3DigitCode-", None, "999"),
    ])
    out = rows(R.pivot_eav(df, ["A"]), "customerid", "Product-3DigitCode-")
    assert len(out) == 5
    by = {(r["customerid"], r["Product-3DigitCode-"]): r for r in out}
    assert by[(1, None)]["A"] is None
    assert by[(2, "123")]["A"] is None
    assert by[(3, None)]["A"] == 9.0
    assert by[(None, None)]["A"] == 5.0 and by[(None, "999")]["A"] is None


def test_synonym_collapse_max_vs_avg(spark):
    df = eav(spark, [(1, "P", "Visit 3", "x accept", 4.0, None), (1, "P", "Visit 3", "y accept", 8.0, None)])
    syn = {"x accept": "accept", "y accept": "accept"}
    assert R.pivot_eav(df, ["accept"], synonyms=syn).first()["accept"] == 8.0
    assert R.pivot_eav(df, ["accept"], synonyms=syn, collapse="avg").first()["accept"] == 6.0


def test_jar_penalty_m16(spark):
    pairs = [(1, 5), (2, 6), (3, 8), (3, 9), (4, 4), (5, None), (None, 7)]
    df = spark.createDataFrame([("P", float(j) if j else None, float(y) if y else None) for j, y in pairs],
                               "product string, jar double, liking double")
    r = E.jar_penalty(df, ["jar"], "liking").first()
    assert r["mean_jar"] == pytest.approx(8.5)
    assert r["mean_too_low"] == pytest.approx(4.0) and r["pct_too_low"] == pytest.approx(200 / 7)
    assert r["mean_drop_too_low"] == pytest.approx(4.5)
    assert r["std_mean_drop_too_low"] == pytest.approx(6.363961, abs=1e-6)
    assert r["mean_too_high"] == pytest.approx(5.5) and r["mean_drop_too_high"] == pytest.approx(3.0)
    assert r["std_mean_drop_too_high"] == pytest.approx(4.242641, abs=1e-6)
    assert r["penalty"] == pytest.approx(3.5)


def test_labels_m18(spark):
    df = spark.createDataFrame([("a:b?",)], "s string")
    r = df.select(S.sanitize_filename("s").alias("f"), S.clean_sheet_name("s").alias("c")).first()
    assert (r["f"], r["c"]) == ("a_b_", "a_b_")
    long_q = "x" * 40 + "?" + "tail"
    r2 = spark.createDataFrame([(long_q,), ("short",)], "s string").select(S.cata_sheet_name("s")).collect()
    assert r2[0][0] == "x" * 31 and r2[1][0] == "shor"


def test_auto_topics_m19(spark):
    df = spark.createDataFrame([(10,), (11,), (100,)], "n int")
    assert [r[0] for r in df.select(S.auto_topics("n")).collect()] == [3, 5, 8]


def test_likert_first_level_wins_m20(spark):
    lk = spark.createDataFrame([(2, "Agree"), (4, "Agree"), (1, "No")], "level int, label string")
    df = spark.createDataFrame([(" Agree ",), ("No",), ("zzz",)], "a string")
    got = [r["lvl"] for r in C.likert_map(df, "a", lk, "lvl").collect()]
    assert sorted(got, key=lambda v: (v is None, v)) == [1.0, 2.0, None]


def test_whitespace_python_semantics(spark):
    df = spark.createDataFrame([("  a b \n",), ("　x",), (None,)], "s string")
    assert [r[0] for r in C.whitespace_remover(df).collect()] == ["a b", "x", None]


def test_find_replace_chains(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    out = C.find_and_replace(df, ["v"], [(["a", "b"], "m"), (["m"], "M")])
    assert [r[0] for r in out.collect()] == ["M", "M", "c"]


def test_linear_drivers_invariants(spark):
    import random
    rnd = random.Random(7)
    data = []
    for i in range(400):
        a, b, c = rnd.randint(1, 10), rnd.randint(1, 10), rnd.randint(1, 10)
        data.append(("P", float(a), float(b), float(c), float(3 * a + b + rnd.random())))
    df = spark.createDataFrame(data, "product string, a double, b double, c double, y double")
    res = {r["variable"]: r for r in D.linear_drivers(df, ["a", "b", "c"], "y").collect()}
    for col in ("linear_weight", "johnson_weight", "lasso_weight"):
        assert sum(r[col] for r in res.values()) == pytest.approx(100.0)
        assert res["a"][col] > res["b"][col] > res["c"][col]
    ols = {r["variable"]: r for r in D.ols_signed(df, ["a", "b", "c"], "y").collect()}
    assert ols["a"]["ols_coefficient"] > 0.8 and ols["a"]["r2"] > 0.95


def test_duplicate_respondents_are_an_error_row(spark):
    # one respondent id holding most rows is one small row, and no pairing is made up for it
    data = [(0, "P1", float(i % 10 + 1)) for i in range(600)] + [(0, "P2", float(i % 7 + 1)) for i in range(500)]
    data += [(i, p, v) for i in range(1, 50) for p, v in (("P1", 5.0), ("P2", 6.0), ("P3", float(i % 9)))]
    df = spark.createDataFrame(data, "customer_id long, product string, q double").repartition(7)
    w = {(r["name1"], r["name2"]): r for r in H.wilcoxon(df, ["q"]).collect()}
    assert len(w) == 3 and all(r["statistic"] is None and r["hypothesis_95"] == H.DUPLICATES for r in w.values())
    m = H.mcnemar(spark.createDataFrame([(1, "A", 0.0), (1, "A", 1.0), (1, "B", 1.0), (1, "B", 0.0)],
                                        "customer_id long, product string, q double"), ["q"]).first()
    assert m["status"] == H.DUPLICATES and m["b"] is None and m["p_value"] is None


def test_mann_whitney_all_tied_accepts(spark):
    df = spark.createDataFrame([(i, p, 3.0) for i in range(8) for p in ("A", "B")], "customer_id long, product string, q double")
    r = H.mann_whitney(df, ["q"]).first()
    assert r["hypothesis_95"] == r["hypothesis_90"] == H.ACCEPT


def test_find_replace_many_values(spark):
    import time
    df = spark.createDataFrame([("v7",), ("v199",), ("x",), (None,)], "v string")
    t = time.time()
    out = C.find_and_replace(df, ["v"], [([f"v{i}" for i in range(200)], "w"), (["w"], "z")])
    out.explain()
    assert time.time() - t < 5
    assert [r[0] for r in out.collect()] == ["z", "z", "x", None]


def test_constant_predictor_is_left_out(spark):
    df = spark.createDataFrame([("P", float(i % 7), 4.0, float(i % 7 + i % 3)) for i in range(60)]
                               + [("Q", float(i % 5), float(i % 2), 1.0) for i in range(20)],
                               "product string, a double, b double, y double")
    got = D.linear_drivers(df, ["a", "b"], "y").collect()
    assert [(r["product"], r["variable"]) for r in got] == [("P", "a")] and got[0]["johnson_weight"] == pytest.approx(100.0)


def test_labels_stay_unique_when_numbers_meet_names(spark):
    df = spark.createDataFrame([("foo bar",), ("foo/bar",), ("foo bar_2",), ("\u00a0x",)], "q string")
    got = [r["sheet"] for r in S.safe_sheet_labels(df, "q").collect()]
    assert len(set(got)) == 4 and {"foo bar", "foo bar_2", "x"} <= set(got)


def test_clean_text_unicode_spaces(spark):
    df = spark.createDataFrame([("\u00a0a\u3000\u200b b ",)], "t string")
    assert df.select(S.clean_text("t")).first()[0] == "a b"


def test_likert_mapping_of_a_table(spark):
    likert = spark.createDataFrame([(1, "No"), (5, "Yes"), (7, "Yes")], "level int, label string")
    df = spark.createDataFrame([(1, " Yes", "No", "k"), (1, "?", None, "k")], "id long, a string, b string, s string")
    got = C.apply_likert_mapping(df, likert, ["id"], ["s"])
    assert got.columns == ["id", "a", "b", "s"]
    assert [tuple(r) for r in got.collect()] == [(1, 5.0, 1.0, "k"), (1, None, None, "k")]


def test_column_listing_ordinal(spark):
    from sondage.operators import discovery as Q
    df = spark.createDataFrame([(1, "a", 2.0)], "customerid long, attribute string, answerscore double")
    assert Q.column_listing(df) == [(1, "customerid", "bigint"), (2, "attribute", "string"),
                                    (3, "answerscore", "double")]


def test_safe_sheet_labels_unique(spark):
    names = ["What is: the overall taste of product?", "What is: the overall taste of product?!",
             "Short"]
    df = spark.createDataFrame([(n,) for n in names], "q string")
    got = [r["sheet"] for r in S.safe_sheet_labels(df, "q", "_Summary").orderBy("q").collect()]
    assert len(set(got)) == 3 and all(len(x) <= 31 for x in got)
    assert "Short_Summary" in got and any(x.endswith("_2") for x in got)


def test_columns_table(spark):
    from sondage.operators import discovery as Q
    df = spark.createDataFrame([(1, "a")], "customerid long, attribute string")
    assert [tuple(r) for r in Q.columns_table(df).collect()] == [(1, "customerid", "bigint"), (2, "attribute", "string")]


def test_gram_merges_centred_partials(spark):
    """Large values keep their correlations; groups have column sets of their own."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 3)) + 1e9
    rows = [("P" if i % 2 else "Q", *(float(v) for v in r[:2]), None if i % 7 == 0 else float(r[2])) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0, 3.0), ("R", None, None, None)], "product string, a double, b double, c double").repartition(9)
    got = {r["product"]: r for r in D.gram(df, ["a", "b", "c"], complete={"P": ["a", "b"], "Q": ["a", "b", "c"], "R": ["a"]}).collect()}
    assert set(got) == {"P", "Q"}
    for g, cols in (("P", [0, 1]), ("Q", [0, 1, 2])):
        own = x[[i for i, r in enumerate(rows) if r[0] == g and (g == "P" or r[3] is not None)]][:, cols]
        cov = np.array(got[g]["m2"]).reshape(3, 3)[np.ix_(cols, cols)] / got[g]["n"]
        assert got[g]["n"] == len(own) and cov == pytest.approx(np.cov(own.T, bias=True), abs=1e-6)
    assert D.gram(df.limit(0), ["a", "b"]).count() == 0


def test_wide_gram_is_one_pass(spark):
    """300 predictors and hundreds of products."""
    cols = [f"x{i}" for i in range(300)]
    df = spark.range(600).select((F.col("id") % 300).cast("string").alias("product"), *[(F.col("id") * (i + 1) % 17).cast("double").alias(c) for i, c in enumerate(cols)])
    g = D.gram(df, cols, complete={str(p): cols[: 10 + p % 5] for p in range(300)})
    assert g.count() == 300 and g.agg(F.sum("n")).first()[0] == 600


def test_reports_without_a_usable_column_are_empty(spark):
    df = spark.createDataFrame([("P", 1, 2.0)], "product string, customer_id int, a double")
    assert A.crosstab(df, {"x": ["a"], "y": ["a", "absent"]}).columns == ["product", "name", "value1", "value2", "n"]
    assert A.crosstab(df, {}).count() == 0 == A.cata_counts(df, []).count()
    assert A.cata_counts(df, []).columns == ["product", "question", "sheet", "attribute", "count", "percentage"]
    assert E.cata_mcnemar(df, []).count() == 0
