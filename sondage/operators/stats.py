"""Pairwise significance tests across every product pair, as aggregations.

The reference loops question x pair x rows.  Here every test is:
  unpivot once -> one aggregation to frequencies (or to paired differences)
  -> join with the product-pair dimension -> window/aggregate over the tiny
  frequency table -> p-value UDF over one row per (question, pair).
Rank statistics come from mid-ranks over frequencies (a window over at most
#levels rows per group), never from sorting responses.  Paired tests align
respondents with an equi-join on the respondent key, not by row position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues as PV
from .reshape import long_form

REJECT = "Reject null => Significant difference"
ACCEPT = "Accept null => No significant difference"


def verdict(p, alpha: float):
    return F.when(p.isNull(), F.lit(None)).when(p < alpha, F.lit(REJECT)).otherwise(F.lit(ACCEPT))


def product_pairs(df: DataFrame, col: str = "product") -> DataFrame:
    """All unordered pairs (name1 < name2) of the distinct values of ``col``.

    Built inside the same plan (a one-column distinct with map-side
    aggregation); the product dimension is one row per product studied, and
    AQE broadcasts it from its runtime size.
    """
    p = df.select(F.col(col).alias("_p")).where(F.col("_p").isNotNull()).distinct()
    return (p.alias("a").join(p.alias("b"), F.col("a._p") < F.col("b._p"))
            .select(F.col("a._p").alias("name1"), F.col("b._p").alias("name2")))


def _freq(long: DataFrame) -> DataFrame:
    """Answers per level, of a long table or one that is counted already (column n)."""
    n = F.sum("n") if "n" in long.columns else F.count(F.lit(1))
    return (long.where(F.col("score").isNotNull())
            .groupBy("product", "question", F.col("score").alias("value"))
            .agg(n.alias("n")))


def _paired_by_pair(fq: DataFrame, pairs: DataFrame) -> DataFrame:
    """(question, name1, name2, value, n1, n2): both samples' counts on each level."""
    f1 = fq.join(pairs, fq["product"] == pairs["name1"]).select(
        "question", "name1", "name2", "value", F.col("n").alias("n1"))
    f2 = fq.join(pairs, fq["product"] == pairs["name2"]).select(
        "question", "name1", "name2", "value", F.col("n").alias("n2"))
    return (f1.join(f2, ["question", "name1", "name2", "value"], "full_outer")
            .select("question", "name1", "name2", "value",
                    F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2")))


def _midranks(df: DataFrame, keys: Sequence[str], order: str, t: str = "t") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(t).over(w)
    return df.withColumn("midrank", cum - F.col(t) + (F.col(t) + 1) / 2.0)


def rank_sums(long: DataFrame) -> DataFrame:
    """Per (question, name1, name2): n1, n2, R1, U1 and the tie term sum(t^3 - t)."""
    fq = _freq(long)
    pairs = product_pairs(long)  # every product present, even one with no answers
    c = _paired_by_pair(fq, pairs).withColumn("t", F.col("n1") + F.col("n2"))
    keys = ["question", "name1", "name2"]
    r = _midranks(c, keys, "value")
    agg = r.groupBy(*keys).agg(
        F.sum("n1").cast("long").alias("n1"), F.sum("n2").cast("long").alias("n2"),
        F.sum(F.col("n1") * F.col("midrank")).alias("r1"),
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie"))
    return agg.withColumn("u1", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0)


def _cliff_label(d):
    a = F.abs(d)
    return (F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium")
            .otherwise("large"))


def mann_whitney(wide: DataFrame, questions: Sequence[str], group: str = "product",
                 ids: Sequence[str] = ("customer_id",), counts: DataFrame | None = None) -> DataFrame:
    """Two-sided Mann-Whitney U for every question and product pair, with effect sizes.

    ``counts``: ``summarise.answer_counts`` by product, in place of the table.

    ``u_statistic`` is U of the first sample; ``cliffs_delta`` = 2U/(n1 n2) - 1
    (equal to the pairwise-count definition); ``z_r``/``r`` use the plain
    normal approximation without tie or continuity correction, as reported.
    """
    if counts is None:
        long = long_form(wide.withColumnRenamed(group, "product") if group != "product" else wide,
                         [*ids, "product"], questions)
    else:
        long = counts.where(F.col("question").isin(list(questions)))
    rs = rank_sums(long)
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    nn = n1.cast("double") * n2  # a product of three counts passes a long at some millions
    ok = (n1 > 0) & (n2 > 0)
    delta = F.when(ok, 2.0 * F.col("u1") / nn - 1.0)
    z_r = F.when(ok, (F.col("u1") - nn / 2.0) / F.sqrt(nn * (n + 1) / 12.0))
    r = F.abs(z_r) / F.sqrt(n.cast("double"))
    r_lab = F.when(r < 0.1, "negligible").when(r < 0.3, "small").when(r < 0.5, "medium").otherwise("large")
    # continuity-corrected, tie-corrected z of max(U1, U2) (what the p-value uses)
    umax = F.greatest(F.col("u1"), nn - F.col("u1"))
    var = nn / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1)))
    z_c = F.when(ok & (var > 0), (umax - nn / 2.0 - 0.5) / F.sqrt(var))
    p = F.when(ok, PV.mwu_p_udf(F.col("u1"), n1, n2, F.col("tie")))
    out = rs.select(
        "question", "name1", "name2", "n1", "n2",
        F.when(ok, F.col("u1")).alias("u_statistic"), delta.alias("cliffs_delta"),
        F.when(ok, _cliff_label(delta)).otherwise(F.lit("N/A")).alias("strength"),
        z_r.alias("z_r"), F.when(ok, r).alias("r"),
        F.when(ok, r_lab).otherwise(F.lit("N/A")).alias("r_z_strength"),
        z_c.alias("z_corrected"), p.alias("p_value"))
    nd = F.lit("Not enough data")
    # without a p-value (all values tie) nothing is below the level, so the null is accepted
    told = lambda alpha: F.coalesce(verdict(F.col("p_value"), alpha), F.lit(ACCEPT))
    return out.select("*", F.when(ok, told(0.05)).otherwise(nd).alias("hypothesis_95"),
                      F.when(ok, told(0.10)).otherwise(nd).alias("hypothesis_90"))


def cliffs_delta(wide: DataFrame, questions: Sequence[str]) -> DataFrame:
    mw = mann_whitney(wide, questions)
    return mw.select("question", "name1", "name2", "cliffs_delta",
                     F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("strength"))
                     .otherwise(F.lit("insufficient data")).alias("strength"))


DUPLICATES = "error (duplicate respondents)"


def respondent_pairs(wide: DataFrame, key: str, answers: dict) -> DataFrame:
    """(name1, name2, first, second): the products that a respondent rated, two at a time, and itself where it says so.

    ``answers``: name -> aggregate over a respondent's rows for a product, which ``first`` and ``second``
    hold as fields.  A field ``twice`` that is true pairs the product with itself as well.  A
    respondent's products meet in one row, however many there are, and leave it as pairs at once.
    """
    rated = wide.groupBy(key, "product").agg(*[a.alias(name) for name, a in answers.items()])
    rated = rated.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("product", *answers))).alias("a"))
    first = rated.select("a", F.posexplode("a").alias("i", "first"))
    start = F.col("i") + (F.when(F.col("first.twice"), 1).otherwise(2) if "twice" in answers else F.lit(2))
    both = first.select("first", F.explode(F.slice("a", start, F.size("a"))).alias("second"))
    return both.select(F.col("first.product").alias("name1"), F.col("second.product").alias("name2"), "first", "second")


def paired_counts(wide: DataFrame, questions: Sequence[str], key: str = "customer_id") -> DataFrame:
    """(question, name1, name2, x, y, n, duplicates): answered pairs across every product pair.

    Respondents are matched on ``key`` with all their answers at once.  ``duplicates`` tells that a
    respondent answers more than once for one of the two products; such a pair has no
    pairing, and its statistics are an error.  Several tests can share this table (``paired=``).
    """
    cols = list(questions)
    rows = wide.select(key, "product", *[F.col(q).cast("double").alias(f"q{i}") for i, q in enumerate(cols)])
    answers = {f"s{i}": F.min(f"q{i}") for i in range(len(cols))}  # a repeated key is one answer
    answers |= {f"t{i}": F.count(f"q{i}") > 1 for i in range(len(cols))}
    answers["twice"] = F.greatest(F.lit(False), F.lit(False), *[F.count(f"q{i}") > 1 for i in range(len(cols))])
    pairs = respondent_pairs(rows, key, answers)
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(f"first.s{i}").alias("x"), F.col(f"second.s{i}").alias("y"),
                                        F.col(f"first.t{i}").alias("twice")) for i, q in enumerate(cols)]))
    long = pairs.select("name1", "name2", each.alias("p")).select("p.question", "name1", "name2", "p.x", "p.y", "p.twice")
    long = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    counts = long.groupBy("question", "name1", "name2", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"))
    # a product paired with itself is there for its respondents who answer twice
    own = F.col("name1").eqNullSafe(F.col("name2"))
    flags = [F.max(own & F.col("twice") & F.col(side).isNotNull()).over(Window.partitionBy("question", side)) for side in ("name1", "name2")]
    counts = counts.withColumns({"_name1": flags[0], "_name2": flags[1]}).where(~own)
    dup = F.coalesce("_name1", F.lit(False)) | F.coalesce("_name2", F.lit(False))
    return counts.select("question", "name1", "name2", "x", "y", "n", dup.alias("duplicates"))


def mcnemar(binary_wide: DataFrame, questions: Sequence[str], key: str = "customer_id",
            paired: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Paired McNemar on 0/1 columns for every product pair (respondents joined on ``key``).

    ``paired`` (``paired_counts`` of 0/1 answers) and ``counts`` (``summarise.answer_counts``), in
    place of the table.

    b = #(first 0, second 1), c = #(first 1, second 0) over respondents answered
    in both.  A respondent twice in a product -> error; not 2x2 (a value missing on either side) -> skip; b + c = 0 -> no
    discordant pairs; b + c >= 25 -> chi-square without continuity correction,
    p from the statistic rounded to 4 dp; otherwise exact binomial, flag 'E'.
    Verdicts compare the p rounded to 4 dp.  ``len1``/``len2`` are each
    product's row counts for the question, so unequal tables stay visible.
    """
    if counts is None:
        lens = long_form(binary_wide, ["product"], questions).groupBy("product", "question").agg(F.count(F.lit(1)).alias("len"))
    else:
        lens = counts.where(F.col("question").isin(list(questions))).groupBy("product", "question").agg(F.sum("n").alias("len"))
    pr = paired_counts(binary_wide, questions, key) if paired is None else paired.where(F.col("question").isin(list(questions)))
    agg = pr.groupBy("question", "name1", "name2").agg(
        F.sum("n").alias("n_pairs"),
        F.sum(F.when((F.col("x") == 0) & (F.col("y") == 1), F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when((F.col("x") == 1) & (F.col("y") == 0), F.col("n")).otherwise(0)).alias("c"),
        # the 2x2 condition: both values present on each side (0/1 columns)
        (F.min("x") != F.max("x")).alias("vx"), (F.min("y") != F.max("y")).alias("vy"),
        F.max("duplicates").alias("dup"))
    l1 = lens.select(F.col("product").alias("name1"), "question", F.col("len").alias("len1"))
    l2 = lens.select(F.col("product").alias("name2"), "question", F.col("len").alias("len2"))
    agg = agg.join(l1, ["name1", "question"], "left").join(l2, ["name2", "question"], "left")
    b, c = F.col("b"), F.col("c")
    is22 = F.col("vx") & F.col("vy") & ~F.col("dup")
    disc = b + c
    stat = F.bround(F.try_divide(F.pow((b - c).cast("double"), 2), disc.cast("double")), 4)
    status = (F.when(F.col("dup"), DUPLICATES).when(~is22, "skip (not 2x2)").when(disc == 0, "no discordant pairs").otherwise("ok"))
    p = F.when(is22 & (disc > 0), PV.mcnemar_p_udf(b, c, stat))
    out = agg.select(
        "question", "name1", "name2", "len1", "len2", "n_pairs",
        F.when(is22, b).alias("b"), F.when(is22, c).alias("c"),
        F.when(is22 & (disc == 0), F.lit(0.0)).when(is22, stat).alias("chi2"),
        F.when(is22 & (disc > 0) & (disc < 25), F.lit("E")).otherwise(F.lit("")).alias("e"),
        status.alias("status"), p.alias("p_value"))
    ok = F.col("status") == "ok"
    return out.select("*",
                      F.when(ok, verdict(F.col("p_value"), 0.05)).otherwise(F.col("status")).alias("confidence_95"),
                      F.when(ok, verdict(F.col("p_value"), 0.10)).otherwise(F.col("status")).alias("confidence_90"))


def wilcoxon(wide: DataFrame, questions: Sequence[str], key: str = "customer_id", paired: DataFrame | None = None) -> DataFrame:
    """Paired Wilcoxon signed-rank for every product pair (zero differences dropped).

    ``paired``: ``paired_counts`` of the answers, in place of the table.

    Distribution of differences -> mid-ranks of |d| -> W+, W-; statistic =
    min(W+, W-).  Exact null distribution iff <= 50 non-zero pairs with no
    ties and no zeros, else the tie-corrected normal approximation.  ``z_value``
    = |Phi^-1(p/2)|, ``r`` = z / sqrt(all pairs incl. zeros).
    """
    every = paired_counts(wide, questions, key) if paired is None else paired.where(F.col("question").isin(list(questions)))
    pr = every.where(~F.col("duplicates"))
    keys = ["question", "name1", "name2"]
    # one chain: counts per |d| (signed) -> mid-ranks over |d| > 0 -> one aggregate
    d = F.col("x") - F.col("y")
    g = pr.groupBy(*keys, F.abs(d).alias("ad")).agg(
        F.sum(F.when(d > 0, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(d < 0, F.col("n")).otherwise(0)).alias("neg"),
        F.sum("n").alias("all"))
    g = g.withColumn("t", F.when(F.col("ad") > 0, F.col("pos") + F.col("neg")).otherwise(F.lit(0)))
    g = _midranks(g, keys, "ad")
    t = F.col("t").cast("double")  # cubes of counts pass a long at some millions
    a = g.groupBy(*keys).agg(
        F.sum(F.col("pos") * F.col("midrank")).alias("w_plus"),
        F.sum(F.col("neg") * F.col("midrank")).alias("w_minus"),
        F.sum("t").alias("n_nonzero"), F.sum(t * (t * t - 1)).alias("tie"),
        F.max("t").alias("max_t"), F.sum("all").alias("n_pairs"),
        F.sum(F.when(F.col("ad") == 0, F.col("all")).otherwise(0)).alias("n_zero"))
    a = a.withColumn("w_plus", F.when(F.col("n_nonzero") > 0, F.col("w_plus"))) \
         .withColumn("w_minus", F.when(F.col("n_nonzero") > 0, F.col("w_minus"))) \
         .withColumn("max_t", F.when(F.col("n_nonzero") > 0, F.col("max_t")))
    n = F.coalesce(F.col("n_nonzero"), F.lit(0))
    stat = F.least("w_plus", "w_minus")
    var = (n.cast("double") * (n + 1) * (2 * n + 1) - 0.5 * F.coalesce(F.col("tie"), F.lit(0))) / 24.0
    exact = (n <= 50) & (F.coalesce(F.col("max_t"), F.lit(1)) <= 1) & (F.col("n_zero") == 0)
    z = F.when(var > 0, (stat - n * (n + 1) / 4.0) / F.sqrt(var))
    p = F.when(n > 0, PV.wilcoxon_p_udf(stat, n, var, exact))
    out = a.where(F.col("n_pairs") > 0).select(
        *keys, F.col("n_pairs").cast("long").alias("n_pairs"), n.cast("long").alias("n_nonzero"),
        "w_plus", "w_minus", stat.alias("statistic"), z.alias("z"), exact.alias("exact"), p.alias("p_value"))
    zv = PV.norm_isf_half_udf(F.col("p_value"))
    out = out.withColumn("z_value", zv).withColumn("r", F.col("z_value") / F.sqrt(F.col("n_pairs")))
    r = F.col("r")
    inten = (F.when(r > 0.5, "large").when(r > 0.3, "moderate").when(r >= 0.1, "small")
             .otherwise("undetermined"))
    out = out.select("*", inten.alias("intensity"), verdict(F.col("p_value"), 0.05).alias("hypothesis_95"),
                     verdict(F.col("p_value"), 0.10).alias("hypothesis_90"))
    # a pair with a respondent twice in one product keeps its row, as an error
    failed = every.where("duplicates").groupBy(*keys).agg(F.sum("n").cast("long").alias("n_pairs"))
    failed = failed.select(*keys, "n_pairs", F.lit("undetermined").alias("intensity"),
                           F.lit(DUPLICATES).alias("hypothesis_95"), F.lit(DUPLICATES).alias("hypothesis_90"))
    return out.unionByName(failed, allowMissingColumns=True)


def fisher(wide: DataFrame, questions: Sequence[str]) -> DataFrame:
    """Two-sided Fisher exact test per question and product pair on a two-category column.

    Categories are the union of both samples' non-null values; anything but
    exactly two gives an error row.
    """
    long = long_form(wide, ["product"], questions)
    fq = _freq(long)
    c = _paired_by_pair(fq, product_pairs(long))
    agg = c.groupBy("question", "name1", "name2").agg(
        F.count(F.lit(1)).alias("k"),
        F.min_by("n1", "value").alias("a"), F.min_by("n2", "value").alias("b"),
        F.max_by("n1", "value").alias("c"), F.max_by("n2", "value").alias("d"))
    two = F.col("k") == 2
    p = F.when(two, PV.fisher_p_udf("a", "b", "c", "d"))
    out = agg.select("question", "name1", "name2", F.when(two, F.col("a")).alias("a"),
                     F.when(two, F.col("b")).alias("b"), F.when(two, F.col("c")).alias("c"),
                     F.when(two, F.col("d")).alias("d"), p.alias("p_value"),
                     F.when(~two, F.lit("Not a 2x2 table. Fisher Exact not applicable.")).alias("error"))
    return out.select("*", verdict(F.col("p_value"), 0.05).alias("hypothesis_95"),
                      verdict(F.col("p_value"), 0.10).alias("hypothesis_90"))


def t_test_from_moments(n1, m1, v1, n2, m2, v2, welch: bool):
    """(t, df) from group sizes, means and sample variances."""
    if welch:
        se2 = v1 / n1 + v2 / n2
        t = (m1 - m2) / F.sqrt(se2)
        df = se2 * se2 / (F.pow(v1 / n1, 2) / (n1 - 1) + F.pow(v2 / n2, 2) / (n2 - 1))
    else:
        df = (n1 + n2 - 2).cast("double")
        sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / df
        t = (m1 - m2) / F.sqrt(sp2 * (1.0 / n1 + 1.0 / n2))
    return t, df
