"""Whole-study run: every per-product report table of one study, written once.

The reference loops products and recomputes everything per table; here the
long form and the aggregations are keyed by product, so each report is ONE
Spark job over all products, and each result is written to ``out_root/<table>``.
The answers per (product, question, score) are counted once and written; counts, boxes,
JAR tables and rank tests are made from that small table; the paired answers per
(question, two products) likewise, for the paired tests.  Reports don't depend on each
other, so some run at a time, the longest first, and the cluster is not idle while one ends.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drivers as D
from ..operators import sensory as E
from ..operators import stats as H
from ..operators import summarise as A
from ..operators.clean import predictor_set
from ..operators.reshape import dichotomize
from ..session import scratch_path

AT_A_TIME = 4  # reports that run at the same time
PAIRED = ("question", "name1", "name2", "n", "duplicates")
LONG = ("drivers_hgb", "drivers_combined")  # reports of many jobs, which begin first


def run_study(spark: SparkSession, wide: DataFrame, config: dict, target: str, out_root: str | None = None,
              threshold: float = 0.3, inverted_jar: bool = True, abbreviations: dict | None = None,
              ri_remove: Sequence[str] = (), ri_remove_all: Sequence[str] | None = None,
              hgb: dict | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Run the study's reports (those named by ``only``); returns a manifest (table, rows, path).

    A report whose questions the study lacks is left out.  A report that fails ends the run.

    Drivers are sought among the T2B and 10-point questions: boosted trees, which bear
    missing answers, without ``ri_remove``; all other methods without ``ri_remove_all``
    (by default the same), merged into one table.  ``hgb``: options of the boosted trees.
    """
    out_root = (out_root or scratch_path(spark, "study")).rstrip("/")
    ten, t2b, jar, cata, md = (config.get(k, []) for k in ("TEN", "T2B", "JAR", "CATA", "MD"))
    wide = wide.persist()
    five_ten = [c for c in ten]
    w5 = wide.withColumns({c: F.when(F.col(c).isin([float(i) for i in range(1, 11)]),
                                     F.ceil(F.col(c) / 2).cast("double")).otherwise(F.col(c)) for c in five_ten})
    broad = predictor_set(t2b + ten, target, ri_remove)
    clean = predictor_set(t2b + ten, target, ri_remove if ri_remove_all is None else ri_remove_all)
    asked = list(dict.fromkeys(ten + t2b + jar))
    counted = f"{out_root}/answer_counts"
    A.answer_counts(wide, asked, ["product"]).write.mode("overwrite").parquet(counted)
    counts = spark.read.parquet(counted)
    reports = {
        "spearman": lambda: E.spearman(w5, ten + t2b + [target]),
        "condition_index": lambda: D.condition_index(w5, ten + t2b, threshold),
        "jar_penalty": lambda: E.jar_penalty(wide, jar, target, abbreviations, inverted=inverted_jar),
        "jar_5pt": lambda: A.jar_5pt(wide, jar, counts=counts),
        "jar_3pt": lambda: A.jar_3pt(wide, jar, abbreviations, counts=counts),
        "box_scores": lambda: A.box_scores(wide, t2b, ten, counts=counts),
        "likert_counts": lambda: A.likert_counts(wide, ten + t2b, counts=counts),
        "crosstab": lambda: A.crosstab(wide, config["column_pairs_dict"]) if config.get("column_pairs_dict") else None,
        "cata_counts": lambda: A.cata_counts(wide, cata) if cata else None,
        "cata_penalty": lambda: functools.reduce(DataFrame.unionByName, [E.cata_penalty(wide, c, target) for c in cata]) if cata else None,
        "maxdiff": lambda: A.maxdiff(wide, md, group=["product"]) if md else None,
        "drivers_hgb": lambda: D.gbt_permutation_importance(wide, broad, target, 0.99, **(hgb or {})),
        "drivers_combined": lambda: D.driver_merge(wide, clean, target, threshold, run_hgb=False),
        "ols_signed": lambda: D.ols_signed(wide, clean, target),
        "mann_whitney": lambda: H.mann_whitney(wide, ten + t2b, counts=counts),
        "wilcoxon": lambda: H.wilcoxon(wide, ten, paired=paired.result()),
        "mcnemar": lambda: H.mcnemar(wide, t2b + jar, paired=dichotomize(paired.result(), ["x", "y"], [4, 5], keep=PAIRED), counts=counts),
        "cata_mcnemar": lambda: E.cata_mcnemar(wide, cata) if cata else None,
    }

    def report(name: str):
        df = reports[name]()
        if df is None:
            return None
        path = f"{out_root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return name, spark.read.parquet(path).count(), path

    def pairs():
        path = f"{out_root}/paired_counts"
        H.paired_counts(wide, asked).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    names = [n for n in reports if only is None or n in only]
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        # begins before the reports that wait for it
        paired = pool.submit(pairs) if {"wilcoxon", "mcnemar"} & set(names) else None
        running = {n: pool.submit(report, n) for n in sorted(names, key=lambda n: n not in LONG)}
        manifest = [m for m in (running[n].result() for n in names) if m]
    wide.unpersist()
    return spark.createDataFrame(manifest, "table string, rows long, path string")
