"""The whole-study run: every CATA question, both predictor sets, trees; and tree importances."""

import random

import pytest
from pyspark.sql import functions as F

from sondage.operators import drivers as D
from sondage.operators import sensory as E
from sondage.operators import stats as H
from sondage.operators import summarise as A
from sondage.operators.reshape import dichotomize
from sondage.plans.study import run_study


def survey(spark, n=120):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        for product in ("P", "Q"):
            a, b, c, jar = rnd.randint(1, 10), rnd.randint(1, 10), rnd.randint(1, 5), rnd.randint(1, 5)
            rows.append((i, product, float(a), float(b), float(c), float(jar), float(min(10, max(1, a - 1 + rnd.randint(0, 2)))),
                         "Creamy" if a > 5 else "Sweet,Creamy", "Soft" if b > 4 else "Hard,Soft", "x:M,y:L"))
    return spark.createDataFrame(rows, "customer_id long, product string, ten_a double, ten_b double, t2b_c double, jar_d double,"
                                       " liking double, cata1 string, cata2 string, md string")


def test_study_covers_every_question(spark, tmp_path):
    config = {"TEN": ["ten_a", "ten_b"], "T2B": ["t2b_c"], "JAR": ["jar_d"], "CATA": ["cata1", "cata2"], "MD": ["md"]}
    out = run_study(spark, survey(spark), config, "liking", f"file://{tmp_path}", ri_remove=["t2b_c"], ri_remove_all=["t2b_c", "ten_b"],
                    hgb={"max_iter": 2, "repeats": 1})
    tables = {r["table"]: r["path"] for r in out.collect()}
    penalties = spark.read.parquet(tables["cata_penalty"])
    assert {r[0] for r in penalties.select("question").distinct().collect()} == {"cata1", "cata2"}
    hgb = spark.read.parquet(tables["drivers_hgb"])
    assert {r[0] for r in hgb.select("variable").distinct().collect()} == {"ten_a", "ten_b"}
    combined = spark.read.parquet(tables["drivers_combined"])
    assert {r[0] for r in combined.select("variable").distinct().collect()} == {"ten_a"}
    assert {"linear_weight", "johnson_weight", "lasso_weight", "rf_weight"} <= set(combined.columns)


def test_trees_rank_the_planted_driver_first(spark):
    df = survey(spark, 200)
    rf = D.random_forest_importance(df, ["ten_a", "ten_b", "t2b_c"], "liking", num_trees=20, max_depth=8)
    hgb = D.gbt_permutation_importance(df, ["ten_a", "ten_b", "t2b_c"], "liking", repeats=2, max_iter=5)
    for table, column in ((rf, "rf_weight"), (hgb, "hgb_weight")):
        for product in ("P", "Q"):
            w = {r["variable"]: r[column] for r in table.where(f"product = '{product}'").collect()}
            assert sum(w.values()) == pytest.approx(100.0) and w["ten_a"] == max(w.values()) and w["ten_a"] > 60


def test_reports_from_shared_counts_equal_those_from_the_table(spark, tmp_path):
    df = survey(spark, 60).withColumn("t2b_c", F.when(F.col("customer_id") % 4 > 0, F.col("t2b_c")))
    df = df.withColumn("jar_d", F.when(F.col("product") == "P", F.col("jar_d")))  # no answers at all in Q
    config = {"TEN": ["ten_a", "ten_b"], "T2B": ["t2b_c"], "JAR": ["jar_d"]}
    only = ["box_scores", "likert_counts", "jar_5pt", "jar_3pt", "mann_whitney", "crosstab"]
    done = {r["table"]: r["path"] for r in run_study(spark, df, config, "liking", f"file://{tmp_path}", only=only).collect()}
    assert set(done) == set(only) - {"crosstab"}
    ten, t2b, jar = config.values()
    direct = {"box_scores": A.box_scores(df, t2b, ten), "likert_counts": A.likert_counts(df, ten + t2b), "jar_5pt": A.jar_5pt(df, jar),
              "jar_3pt": A.jar_3pt(df, jar), "mann_whitney": H.mann_whitney(df, ten + t2b)}
    for name, want in direct.items():
        assert sorted(map(str, spark.read.parquet(done[name]).collect())) == sorted(map(str, want.collect())), name
    boxes = {(r["product"], r["question"], r["metric"]): r["value"] for r in direct["box_scores"].collect()}
    by_hand = df.where("product = 'P' AND t2b_c IS NOT NULL").agg(F.avg(F.col("t2b_c").isin([4.0, 5.0]).cast("double")) * 100).first()[0]
    assert boxes["P", "t2b_c", "% T2B"] == pytest.approx(by_hand) and ("P", "t2b_c", "Mean") not in boxes


def test_a_failing_report_ends_the_run(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        run_study(spark, survey(spark, 10), {"TEN": ["ten_a"], "CATA": ["nowhere"]}, "liking", f"file://{tmp_path}", only=["cata_counts"])


def messy(spark):
    """Respondents twice in a product, without an id, without a product, without answers; three products."""
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        who = rnd.choice([None, *range(90)])
        answers = [rnd.choice([None, *map(float, range(1, 6))]) for _ in range(3)]
        cell = rnd.choice([None, "", "A", "A,B", "B,A,A", " B,C", "C,,D"])
        rows.append((who, rnd.choice(["P", "Q", "R", "R", None]), *answers, cell))
    rows += [(1000 + i, p, float(1 + (i + k) % 5), float(1 + i % 5), None, "A,D" if i % 2 else "B") for i in range(60) for k, p in enumerate("ST")]
    return spark.createDataFrame(rows, "customer_id long, product string, a double, b double, c double, cata string")


def test_paired_counts_match_respondents_by_hand(spark):
    df = messy(spark)
    rated = {}
    for r in df.collect():
        for q in "abc":
            if r[q] is not None:
                rated.setdefault((q, r["customer_id"]), {}).setdefault(r["product"], []).append(r[q])
    want, twice = {}, set()
    for (q, _), by_product in rated.items():
        twice |= {(q, p) for p, v in by_product.items() if len(v) > 1 and p is not None}
        names = sorted(by_product, key=lambda p: (p is not None, p))
        for i, p in enumerate(names):
            for o in names[i + 1:]:
                key = (q, p, o, min(by_product[p]), min(by_product[o]))
                want[key] = want.get(key, 0) + 1
    got = {tuple(r)[:5]: (r["n"], r["duplicates"]) for r in H.paired_counts(df, ["a", "b", "c"]).collect()}
    assert got == {k: (n, (k[0], k[1]) in twice or (k[0], k[2]) in twice) for k, n in want.items()}
    assert {d for _, d in got.values()} == {True, False}


def test_cata_pairs_match_respondents_by_hand(spark):
    df = messy(spark)
    checked = {}
    for r in df.collect():
        if r["customer_id"] is not None and r["product"] is not None:
            checked.setdefault(r["product"], {}).setdefault(r["customer_id"], set()).update(t for t in (r["cata"] or "").split(",") if t)
    want = set()
    for p in checked:
        for o in checked:
            both = [(checked[p][i], checked[o][i]) for i in checked[p] if p < o and i in checked[o]]
            for t in {t for x, y in both for t in x | y}:
                n1, n2 = sum(t in x for x, _ in both), sum(t in y for _, y in both)
                if 0 < n1 < len(both) and 0 < n2 < len(both):
                    want.add((p, o, t, sum(t in y and t not in x for x, y in both), sum(t in x and t not in y for x, y in both)))
    got = E.cata_mcnemar(df, ["cata"]).collect()
    assert {(r["name1"], r["name2"], r["token"], r["b"], r["c"]) for r in got} == want and len(got) == len(want) > 3


def test_paired_tests_share_one_written_table(spark, tmp_path):
    df = messy(spark).withColumn("liking", F.lit(1.0))
    config = {"TEN": ["a"], "T2B": ["b"], "JAR": ["c"]}
    done = {r["table"]: r["path"] for r in run_study(spark, df, config, "liking", f"file://{tmp_path}", only=["wilcoxon", "mcnemar"]).collect()}
    assert set(done) == {"wilcoxon", "mcnemar"} and spark.read.parquet(f"file://{tmp_path}/paired_counts").count() > 0
    direct = {"wilcoxon": H.wilcoxon(df, ["a"]), "mcnemar": H.mcnemar(dichotomize(df, ["b", "c"], [4, 5], keep=["customer_id", "product"]), ["b", "c"])}
    for name, want in direct.items():
        assert sorted(map(str, spark.read.parquet(done[name]).collect())) == sorted(map(str, want.collect())), name


def test_rows_are_counted_before_answers_are_exploded(spark):
    df = survey(spark, 20)
    reports = {"spearman": E.spearman(df, ["ten_a", "ten_b", "t2b_c"]), "maxdiff": A.maxdiff(df, ["md"], ["product"])}
    for name, report in reports.items():
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        exploded = [below for below in plan.split("Generate explode(")[1:]]
        assert exploded and all("Aggregate" in below for below in exploded), name
    penalty = E.cata_penalty(df, "cata1", "liking")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD [product#" in penalty and "_n#" in penalty  # what is kept are sums per cell, not rows


def test_spearman_keeps_groups_and_diagonal(spark):
    rows = [(None, 1.0, 2.0), (None, 2.0, 1.0), ("P", 1.0, 1.0), ("P", 2.0, 3.0), ("P", 2.0, None), ("P", 3.0, 3.0), ("Q", 1.0, None)]
    got = {(r["product"], r["q1"], r["q2"]): r["rho"] for r in E.spearman(spark.createDataFrame(rows, "product string, a double, b double"), ["a", "b"]).collect()}
    r = pytest.approx((1.5 ** 0.5) / 2 ** 0.5)  # ranks 1, 2, 3 and 1, 2.5, 2.5
    assert got == {("P", "a", "a"): 1.0, ("P", "b", "b"): 1.0, ("P", "a", "b"): r, ("P", "b", "a"): r, ("Q", "a", "a"): None,
                   (None, "a", "a"): 1.0, (None, "b", "b"): 1.0}


def test_rank_tests_bear_many_millions_of_answers(spark):
    """Cubes of counts pass a long from some millions of answers on: six times 1 GB has 5 million per product."""
    m = 10_000_000
    counts = spark.createDataFrame([(p, "a", float(s), m * k) for p, ks in (("P", (1, 2)), ("Q", (2, 1))) for s, k in enumerate(ks)],
                                   "product string, question string, score double, n long")
    mw = H.mann_whitney(None, ["a"], counts=counts).first()
    assert mw["n1"] == mw["n2"] == 3 * m and mw["cliffs_delta"] == pytest.approx(1 / 3)
    n = 3.0 * m
    assert abs(mw["z_r"]) == pytest.approx(n * n / 6 / (n * n * (2 * n + 1) / 12) ** 0.5) and mw["p_value"] == 0
    paired = spark.createDataFrame([("a", "P", "Q", 1.0, 2.0, 2 * m, False), ("a", "P", "Q", 2.0, 1.0, m, False), ("a", "P", "Q", 1.0, 1.0, m, False)],
                                   "question string, name1 string, name2 string, x double, y double, n long, duplicates boolean")
    wx = H.wilcoxon(None, ["a"], paired=paired).first()
    half = (n + 1) / 2
    var = (n * (n + 1) * (2 * n + 1) - 0.5 * n * (n * n - 1)) / 24
    assert wx["w_minus"] == 2 * m * half and wx["w_plus"] == m * half and wx["n_pairs"] == 4 * m
    assert wx["z"] == pytest.approx((m * half - n * (n + 1) / 4) / var ** 0.5)
