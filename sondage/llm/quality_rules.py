"""Quality rules: a learned decision list (sequential covering, grown and pruned).

Everything on the data is a DataFrame expression.  Base counts per document come
from higher-order array functions, without exploding words.  For learning, the
labelled documents are reduced by one aggregation to a table of cells - one per
combination of binned features - with the number of good and bad documents in a
growing and a pruning fold.  Its size is bounded by the bins (``(BINS + 1) **
len(FEATURES)``), not by the corpus, so the covering itself is driver arithmetic
over those counts:

grow   add the threshold condition with the best FOIL gain until no good one is covered
prune  drop trailing conditions while (bad - good) / (bad + good) on the pruning fold rises
emit   keep the rule if it rejects bad documents with precision of at least ``min_precision``
       on both folds, remove what it covers, go on with the rest

The result is an ordered list of conjunctions, applied as one CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SYMBOLS = "#*$%&|<>"
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "log_words")
BINS = 8  # thresholds per feature


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` -> (id, ``also``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all long.

    A null text counts as empty: every count is 0.
    """
    ids = [id_col, *also]
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*ids, text.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(
        *ids,
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.array_remove(F.split(F.translate("t", SPACES, " " * len(SPACES)), " "), "").alias("w"))
    # windows of three words as (hash, place), sorted; 64 bits tell the windows of one text apart
    d = d.select("*", F.size("w").cast("long").alias("n_words"), F.expr(
        "CASE WHEN size(w) >= 3 THEN sort_array(transform(slice(w, 1, size(w) - 2),"
        " (x, i) -> struct(xxhash64(x, w[i + 1], w[i + 2]) AS h, i AS i))) END").alias("g"))
    # places of the windows that equal a neighbour, in text order
    d = d.withColumn("places", F.expr(
        "sort_array(filter(transform(g, (x, k) ->"
        " CASE WHEN x.h = get(g, k - 1).h OR x.h = get(g, k + 1).h THEN x.i END), i -> i IS NOT NULL))"))
    covered = F.expr("aggregate(places, struct(-3 AS last, 0L AS n),"
                     " (s, p) -> struct(p AS last, s.n + least(3, p - s.last) AS n), s -> s.n)")
    return d.select(*ids, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios of the base counts; of a document without words all are 0."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "mean_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "log_words": F.log1p(F.col("n_words").cast("double")),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # "<" or ">="
    threshold: float

    def column(self) -> Column:
        c = features()[self.feature]
        return c < self.threshold if self.op == "<" else c >= self.threshold


Rule = tuple[Condition, ...]


def _thresholds(stats: DataFrame) -> dict[str, list[float]]:
    """At most BINS cut points per feature: quantiles of the good and of the bad documents."""
    shares = [i / (BINS // 2 + 1) for i in range(1, BINS // 2 + 1)]
    aggs = [F.percentile_approx(F.when(F.col("bad") == b, c), shares, 10_000).alias(f"{name}_{b}")
            for name, c in features().items() for b in (0, 1)]
    row = stats.agg(*aggs).first()
    return {name: sorted({*(row[f"{name}_0"] or []), *(row[f"{name}_1"] or [])}) for name in FEATURES}


def learn(labelled: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rules: int = 8,
          max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """Learn the reject rules from ``labelled``: base counts plus a 0/1 label (0 = bad).

    Rows with a null label are left out; without a bad (or a good) row there is no rule.
    """
    fold = F.when(F.pmod(F.xxhash64(F.col(id_col)), F.lit(3)) == 2, 1).otherwise(0)  # a third prunes
    stats = (labelled.where(F.col(label_col).isin(0, 1) & ~base_failed())
             .withColumn("bad", 1 - F.col(label_col).cast("int")).withColumn("fold", fold))
    cuts = _thresholds(stats)
    # the bin of a value is the number of cut points at or below it
    code = {name: sum(((c >= t).cast("int") for t in cuts[name]), F.lit(0)) for name, c in features().items()}
    cells = (stats.groupBy(*(code[n].alias(n) for n in FEATURES), "fold")
             .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect())
    rows = [([r[n] for n in FEATURES], r["fold"], r["bad"], r["good"]) for r in cells]
    every = [(f, op, k) for f, n in enumerate(FEATURES) for k in range(len(cuts[n])) for op in ("<", ">=")]

    def fits(codes, cond) -> bool:
        f, op, k = cond
        return codes[f] <= k if op == "<" else codes[f] > k

    def covered(rule, fold) -> tuple[int, int]:
        take = [(b, g) for codes, x, b, g in rows if x == fold and all(fits(codes, c) for c in rule)]
        return sum(b for b, _ in take), sum(g for _, g in take)

    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule: list = []
        bad, good = covered(rule, 0)
        while good and bad and len(rule) < max_conditions:
            before, best = math.log2(bad / (bad + good)), None
            for cond in every:
                b, g = covered([*rule, cond], 0)
                gain = b * (math.log2(b / (b + g)) - before) if b else 0.0
                if gain > 1e-9 and (best is None or (gain, cond) > best[:2]):
                    best = (gain, cond, b, g)
            if best is None:
                break
            rule.append(best[1])
            bad, good = best[2:]

        def worth(r) -> float:
            b, g = covered(r, 1)
            return (b - g) / (b + g) if b + g else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        (b0, g0), (b1, g1) = covered(rule, 0), covered(rule, 1)
        if not rule or b0 < min_cover or b0 < min_precision * (b0 + g0) or b1 < min_precision * (b1 + g1) or not b1:
            break
        rules.append(tuple(Condition(FEATURES[f], op, cuts[FEATURES[f]][k]) for f, op, k in rule))
        rows = [r for r in rows if not all(fits(r[0], c) for c in rule)]
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the first rule that rejects or null) as ordered CASE expressions."""
    if not rules:
        return F.lit(True), F.lit(None).cast("int")
    number = None
    for i, rule in enumerate(rules, 1):
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        number = F.when(cond, i) if number is None else number.when(cond, i)
    return number.isNull(), number


def quality_rules(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                  **options) -> DataFrame:
    """``base_counts`` rows -> the same plus base_failed, kept, rule (the first that rejects).

    ``labels``: (id, 0/1); a document labelled more than once counts as bad if any label is bad.
    Labels without a document are ignored; documents with a null or repeated id are judged
    row by row.  Without labels (or with only one class) the base test alone decides.
    """
    one = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias(label_col))
    rules = learn(counts.join(one, id_col), id_col, label_col, **options)
    good, number = verdict(rules)
    return (counts.withColumn("base_failed", base_failed()).withColumn("rule", number)
            .withColumn("kept", ~F.col("base_failed") & good))
