"""Sensory analyses: CATA tests and penalties, JAR penalty, Spearman correlation.

All work on sparse long forms.  CATA indicators are never materialised as a
dense respondent x token grid: checked cells come from exploding the answer
tokens, and "unchecked" counts are totals minus checked counts.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues as PV
from ..functions import scalar as S
from .reshape import long_form
from .stats import respondent_pairs, t_test_from_moments

# ---------------------------------------------------------------------------
# CATA pairwise McNemar (exact) on token indicators
# ---------------------------------------------------------------------------


def cata_mcnemar(wide: DataFrame, columns: Sequence[str], key: str = "customer_id") -> DataFrame:
    """Exact McNemar per product pair, CATA question and token common to both products.

    Respondents are paired on ``key``; a NULL cell means no token checked.
    b = #(unchecked in first, checked in second), c = the reverse; pairs whose
    2x2 table lacks a row or column (token checked by all or none on a side)
    are skipped.  ``attribute`` is the text after the last '_' of the dummy
    name ``<question>_<token>``, ``token`` the full token.
    """
    cols = list(dict.fromkeys(columns))
    if not cols:
        return wide.sparkSession.createDataFrame([], "name1 string, name2 string, question string, token string, attribute string, b long, c long,"
                                                     " p_value double")
    rows = wide.where(F.col("product").isNotNull() & F.col(key).isNotNull()).select(
        key, "product", *[F.col(c).alias(f"q{i}") for i, c in enumerate(cols)])
    pairs = respondent_pairs(rows, key, {f"q{i}": F.sort_array(F.collect_set(f"q{i}")) for i in range(len(cols))})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("question"), F.col(f"first.q{i}").alias("cells1"), F.col(f"second.q{i}").alias("cells2"))
                               for i, c in enumerate(cols)]))
    # equal cells are counted before they are cut into tokens
    cells = pairs.select("name1", "name2", each.alias("p")).groupBy("name1", "name2", "p.question", "p.cells1", "p.cells2").agg(F.count(F.lit(1)).alias("n"))
    tokens = lambda c: F.array_distinct(F.filter(F.flatten(F.transform(c, lambda x: F.split(x, ","))), lambda t: t != ""))
    sets = cells.select("name1", "name2", "question", "n", tokens("cells1").alias("t1"), tokens("cells2").alias("t2"))
    # the row without a token counts all respondents of the pair
    flags = sets.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_union("t1", "t2"))).alias("token"))
    x, y = (F.coalesce(F.array_contains(t, F.col("token")), F.lit(False)) for t in ("t1", "t2"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    cnt = flags.groupBy("name1", "name2", "question", "token").agg(
        total(x).alias("n1"), total(y).alias("n2"), total(~x & y).alias("b"), total(x & ~y).alias("c"), total(F.col("token").isNull()).alias("n"))
    j = cnt.withColumn("n", F.max("n").over(Window.partitionBy("name1", "name2", "question"))).where(F.col("token").isNotNull())
    ok = (F.col("n1") > 0) & (F.col("n1") < F.col("n")) & (F.col("n2") > 0) & (F.col("n2") < F.col("n"))
    out = j.where(ok).select("name1", "name2", "question", "token",
                             F.element_at(F.split(F.concat("question", F.lit("_"), "token"), "_"), -1).alias("attribute"), "b", "c")
    return out.withColumn("p_value", PV.mcnemar_exact_udf("b", "c"))


# ---------------------------------------------------------------------------
# CATA penalty: liking when a token is checked vs not
# ---------------------------------------------------------------------------


def cata_penalty(wide: DataFrame, column: str, target: str, group: Sequence[str] = ("product",),
                 key: str = "customer_id", mode: str = "substring") -> DataFrame:
    """Mean target when each token is checked vs not, penalty, Welch t / df / p.

    Tokens are the trimmed, non-empty comma items.  ``mode='substring'`` (the
    reference rule) counts a row as checked when its raw cell contains the
    token anywhere, so 'Sweet' is checked by 'Too Sweet'; since tokens carry
    no comma, that holds iff some token of the row contains it, which is a join
    of row tokens with the token-containment pairs of the (small) vocabulary.
    ``mode='exact'`` uses token equality.
    """
    g = list(group)
    # rows with the same cell check the same tokens, so counts and sums per cell stand for them
    y = F.col(target).cast("double")
    rows = wide.groupBy(*g, F.col(column).alias("_cell")).agg(
        F.count(y).alias("_n"), F.sum(y).alias("_s"), F.sum(y * y).alias("_q")).checkpoint()
    key = "_cell"
    rt = (rows.where(F.col("_cell").isNotNull())
          .select(*g, key, F.explode(F.transform(F.split("_cell", ","), S.strip_whitespace)).alias("u"))
          .where(F.col("u") != "").distinct())
    vocab = rt.select(*g, "u").distinct()
    if mode == "exact":
        contain = vocab.select(*g, "u", F.col("u").alias("token"))
    else:
        contain = (vocab.alias("big").join(vocab.alias("small"),
                                           [F.col(f"big.{c}") == F.col(f"small.{c}") for c in g]
                                           + [F.instr(F.col("big.u"), F.col("small.u")) > 0])
                   .select(*[F.col(f"big.{c}").alias(c) for c in g], F.col("big.u").alias("u"),
                           F.col("small.u").alias("token")))
    checked = rt.join(contain, [*g, "u"]).select(*g, key, "token").distinct()
    tot = rows.groupBy(*g).agg(F.sum("_n").alias("n_all"), F.sum("_s").alias("s_all"), F.sum("_q").alias("q_all"))
    ch = checked.join(rows, [*g, key]).groupBy(*g, "token").agg(
        F.sum("_n").alias("n_c"), F.sum("_s").alias("s_c"), F.sum("_q").alias("q_c"))
    vt = vocab.select(*g, F.col("u").alias("token"))
    j = vt.join(ch, [*g, "token"], "left").join(tot, g, "left").fillna(0, subset=["n_c", "s_c", "q_c"])
    n_c, n_u = F.col("n_c"), F.coalesce(F.col("n_all"), F.lit(0)) - F.col("n_c")
    s_u = F.coalesce(F.col("s_all"), F.lit(0.0)) - F.col("s_c")
    q_u = F.coalesce(F.col("q_all"), F.lit(0.0)) - F.col("q_c")
    m_c = F.when(n_c > 0, F.col("s_c") / n_c)
    m_u = F.when(n_u > 0, s_u / n_u)
    v_c = F.when(n_c > 1, (F.col("q_c") - n_c * m_c * m_c) / (n_c - 1))
    v_u = F.when(n_u > 1, (q_u - n_u * m_u * m_u) / (n_u - 1))
    t, df = t_test_from_moments(n_c, m_c, F.greatest(v_c, F.lit(0.0)), n_u, m_u,
                                F.greatest(v_u, F.lit(0.0)), welch=True)
    both = (n_c > 1) & (n_u > 1)
    out = j.select(*g, F.lit(column).alias("question"), F.col("token").alias("attribute"),
                   n_c.cast("long").alias("n_checked"), n_u.cast("long").alias("n_not_checked"),
                   m_c.alias("mean_checked"), m_u.alias("mean_not_checked"), (m_c - m_u).alias("penalty"),
                   F.when(both, t).alias("t"), F.when(both, df).alias("df"))
    return out.withColumn("p_value", F.when(F.col("t").isNotNull(), PV.t_p_udf("t", "df")))


# ---------------------------------------------------------------------------
# JAR penalty analysis
# ---------------------------------------------------------------------------


def _mwu_two_samples(fq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank sums of sample 1 vs 2 from (keys, value, n1, n2) frequencies."""
    c = fq.withColumn("t", F.col("n1") + F.col("n2"))
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("midrank", F.sum("t").over(w) - F.col("t") + (F.col("t") + 1) / 2.0)
    a = c.groupBy(*keys).agg(F.sum("n1").alias("m1"), F.sum("n2").alias("m2"),
                             F.sum(F.col("n1") * F.col("midrank")).alias("r1"),
                             F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie"))
    a = a.withColumn("u1", F.col("r1") - F.col("m1") * (F.col("m1") + 1) / 2.0)
    return a.withColumn("p", PV.mwu_p_udf("u1", "m1", "m2", "tie"))


def jar_penalty(wide: DataFrame, jar_columns: Sequence[str], target: str,
                abbreviations: dict | None = None, group: Sequence[str] = ("product",),
                inverted: bool = True, threshold_pct: float = 20.0) -> DataFrame:
    """Penalty analysis per JAR attribute: means, shares, mean drops and tests.

    Inverted scale (default): Too Low = {4, 5}, JAR = {3}, Too High = {1, 2};
    ``inverted=False`` swaps the two sides.  Shares use all rows as the base;
    side p-values (Mann-Whitney JAR vs side) drop NULL targets; the penalty p is
    the pooled Student t-test of JAR vs non-JAR.  ``above_threshold`` and
    ``significant_*`` are the chart flags (share >= threshold, p < .05).
    """
    g = list(group)
    abbreviations = abbreviations or {}
    low, high = ([4.0, 5.0], [1.0, 2.0]) if inverted else ([1.0, 2.0], [4.0, 5.0])
    lng = long_form(wide.withColumn("_y", F.col(target).cast("double")), [*g, "_y"], jar_columns)
    side = (F.when(F.col("score").isin(low), "low").when(F.col("score") == 3.0, "jar")
            .when(F.col("score").isin(high), "high"))
    lng = lng.withColumn("side", side)
    y = F.col("_y")

    def cnt(s):
        return F.count_if(F.col("side") == s)

    def n_(s):
        return F.count(F.when(F.col("side") == s, y))

    def sm(s):
        return F.sum(F.when(F.col("side") == s, y))

    def sq(s):
        return F.sum(F.when(F.col("side") == s, y * y))

    agg = lng.groupBy(*g, "question").agg(
        F.count(F.lit(1)).alias("n_rows"),
        cnt("low").alias("c_low"), cnt("high").alias("c_high"),
        n_("jar").alias("n_jar"), n_("low").alias("n_low"), n_("high").alias("n_high"),
        sm("jar").alias("s_jar"), sm("low").alias("s_low"), sm("high").alias("s_high"),
        sq("jar").alias("q_jar"), sq("low").alias("q_low"), sq("high").alias("q_high"))
    # MWU JAR vs each side, from target frequencies
    fq = (lng.where(y.isNotNull() & F.col("side").isNotNull())
          .groupBy(*g, "question", "side", F.col("_y").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    tests = []
    for s in ("low", "high"):
        two = (fq.where(F.col("side").isin("jar", s))
               .groupBy(*g, "question", "value")
               .agg(F.sum(F.when(F.col("side") == "jar", F.col("n")).otherwise(0)).alias("n1"),
                    F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias("n2")))
        r = _mwu_two_samples(two, [*g, "question"])
        tests.append(r.select(*g, "question", F.when((F.col("m1") > 0) & (F.col("m2") > 0), F.col("p"))
                              .alias(f"p_{s}")))
    a = agg.join(tests[0], [*g, "question"], "left").join(tests[1], [*g, "question"], "left")

    def mean(s):
        return F.when(F.col(f"n_{s}") > 0, F.col(f"s_{s}") / F.col(f"n_{s}"))

    def var(s):
        n = F.col(f"n_{s}")
        return F.when(n > 1, F.greatest((F.col(f"q_{s}") - F.col(f"s_{s}") * F.col(f"s_{s}") / n) / (n - 1),
                                        F.lit(0.0)))

    m_jar, m_low, m_high = mean("jar"), mean("low"), mean("high")
    sd_jar = F.sqrt(var("jar"))
    n_non = F.col("n_low") + F.col("n_high")
    s_non = F.coalesce(F.col("s_low"), F.lit(0.0)) + F.coalesce(F.col("s_high"), F.lit(0.0))
    q_non = F.coalesce(F.col("q_low"), F.lit(0.0)) + F.coalesce(F.col("q_high"), F.lit(0.0))
    m_non = F.when(n_non > 0, s_non / n_non)
    v_non = F.when(n_non > 1, F.greatest((q_non - s_non * s_non / n_non) / (n_non - 1), F.lit(0.0)))
    t, df = t_test_from_moments(F.col("n_jar"), m_jar, var("jar"), n_non, m_non, v_non, welch=False)
    has_t = (F.col("n_jar") > 0) & (n_non > 0) & ((F.col("n_jar") + n_non) > 2)
    md_low = F.when(F.col("c_low") > 0, m_jar - m_low)
    md_high = F.when(F.col("c_high") > 0, m_jar - m_high)
    amap = F.create_map(*[F.lit(x) for kv in abbreviations.items() for x in kv]) if abbreviations else None
    attr = F.coalesce(amap[F.col("question")], F.col("question")) if amap is not None else F.col("question")
    out = a.select(
        *g, attr.alias("attribute"), m_jar.alias("mean_jar"),
        m_low.alias("mean_too_low"), (F.col("c_low") * 100.0 / F.col("n_rows")).alias("pct_too_low"),
        md_low.alias("mean_drop_too_low"),
        F.when(sd_jar > 0, md_low / sd_jar).alias("std_mean_drop_too_low"),
        F.when(F.col("c_low") > 0, F.col("p_low")).alias("p_too_low"),
        m_high.alias("mean_too_high"), (F.col("c_high") * 100.0 / F.col("n_rows")).alias("pct_too_high"),
        md_high.alias("mean_drop_too_high"),
        F.when(sd_jar > 0, md_high / sd_jar).alias("std_mean_drop_too_high"),
        F.when(F.col("c_high") > 0, F.col("p_high")).alias("p_too_high"),
        (m_jar - m_non).alias("penalty"), F.when(has_t, t).alias("t_penalty"),
        F.when(has_t, df).alias("df_penalty"))
    out = out.withColumn("p_penalty", F.when(F.col("t_penalty").isNotNull(), PV.t_p_udf("t_penalty", "df_penalty")))
    thr = float(threshold_pct)
    return out.select("*", (F.col("pct_too_low") >= thr).alias("above_threshold_too_low"),
                      (F.col("pct_too_high") >= thr).alias("above_threshold_too_high"),
                      (F.col("p_too_low") < 0.05).alias("significant_too_low"),
                      (F.col("p_too_high") < 0.05).alias("significant_too_high"))


# ---------------------------------------------------------------------------
# Spearman rank correlation, pairwise complete
# ---------------------------------------------------------------------------


def joint_freq(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ("product",)) -> DataFrame:
    """(group, q1, q2, v1, v2, n) over rows where both columns are answered, q1 <= q2 by position.

    Rows alike in all columns are counted first.  Each of these emits its p(p+1)/2 column pairs, a
    column with itself among them (p = number of columns, fixed by the questionnaire); the map-side
    partial aggregate collapses them to at most p^2 x levels^2 rows per task before the shuffle.
    """
    g = list(group)
    cols = list(columns)
    answers = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]
    alike = wide.select(*g, *answers).groupBy(*g, *[f"c{i}" for i in range(len(cols))]).agg(F.count(F.lit(1)).alias("n"))
    pairs = [F.struct(F.lit(a).alias("q1"), F.lit(cols[j]).alias("q2"), F.col(f"c{i}").alias("v1"), F.col(f"c{j}").alias("v2"))
             for i, a in enumerate(cols) for j in range(i, len(cols))]
    ex = alike.select(*g, "n", F.explode(F.array(*pairs)).alias("p")).select(*g, "n", "p.*")
    return (ex.where(F.col("v1").isNotNull() & F.col("v2").isNotNull())
            .groupBy(*g, "q1", "q2", "v1", "v2").agg(F.sum("n").alias("n")))


def spearman(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ("product",)) -> DataFrame:
    """Long correlation matrix (group, q1, q2, rho), pandas ``corr('spearman')`` semantics.

    Ranks are recomputed within each pair's complete rows (average ties), then
    a weighted Pearson over the joint frequencies.  The diagonal is 1 for a
    column with variance, NULL otherwise; the matrix is emitted symmetric.
    """
    g = list(group)
    jf = joint_freq(wide, columns, g)
    keys = [*g, "q1", "q2"]

    def rank(v):
        upto = Window.partitionBy(*keys).orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        t = F.sum("n").over(Window.partitionBy(*keys, v))
        return (F.sum("n").over(upto) - t + (t + 1) / 2.0).alias("r_" + v)

    j = jf.select("*", rank("v1"), rank("v2"))
    n, r1, r2 = F.col("n"), F.col("r_v1"), F.col("r_v2")
    a = j.groupBy(*keys).agg(F.sum(n).alias("N"), F.sum(n * r1).alias("s1"), F.sum(n * r2).alias("s2"),
                             F.sum(n * r1 * r1).alias("s11"), F.sum(n * r2 * r2).alias("s22"),
                             F.sum(n * r1 * r2).alias("s12"), (F.min("v1") < F.max("v1")).alias("varies"))
    N = F.col("N")
    cov = F.col("s12") - F.col("s1") * F.col("s2") / N
    v1 = F.col("s11") - F.col("s1") * F.col("s1") / N
    v2 = F.col("s22") - F.col("s2") * F.col("s2") / N
    rho = F.when((v1 > 1e-12) & (v2 > 1e-12) & (N > 1), cov / F.sqrt(v1 * v2))
    own = F.col("q1") == F.col("q2")
    known = functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in g], F.lit(True))
    out = a.where(own | known).select(*keys, F.when(own, F.when(F.col("varies"), F.lit(1.0))).otherwise(rho).alias("rho"))
    there = F.struct("q1", "q2")
    back = F.struct(F.col("q2").alias("q1"), F.col("q1").alias("q2"))
    both = F.explode(F.when(own, F.array(there)).otherwise(F.array(there, back)))
    return out.select(*g, both.alias("q"), "rho").select(*g, "q.q1", "q.q2", "rho")
