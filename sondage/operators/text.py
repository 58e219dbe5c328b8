"""Open-ended text: spelling normalisation, translation memory, themes.

* Spelling: exact candidates by keys.  An edit inserts, drops or changes a letter or swaps two
  neighbours.  Short dictionary words are met by leaving out up to two letters on both sides (words
  within two edits have such a rest in common), long ones by segments (of five, two edits leave
  one untouched, as a swap may touch two, so it occurs in the query word near its place).  A word
  has a bounded number of keys; the candidates' distance is told by ``levenshtein`` of the words and
  of their swaps, and the best is the first by (distance, -frequency, word).  Only DISTINCT words
  are corrected; the word -> correction map is joined back.
* Translation: a translation-memory join keyed by (language, text hash).
* Themes: see ``themes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..partitioning import balance
from ..session import scratch_path
from .themes import theme_analysis, themes  # noqa: F401

# Word characters as Python 3 regexes see them (letters, digits, underscore in any script);
# Java's plain \w is ASCII-only, so the class is spelled out.
WORD = r"[\p{L}\p{N}_]"
WORD_SPLIT = rf"({WORD}+|[^\p{{L}}\p{{N}}_\s]|\s)"

# ---------------------------------------------------------------------------
# Spelling
# ---------------------------------------------------------------------------


def _segment(length: str, i: str) -> tuple[str, str]:
    """(start from 0, size) of the i-th of the segments of a word of ``length``, as SQL."""
    n = SEGMENTS
    return f"({i} * ({length} div {n}) + least({i}, {length} % {n}))", f"({length} div {n} + IF({i} < {length} % {n}, 1, 0))"


SHORT = 14  # dictionary words up to this length are met by deletions, longer ones by segments of three letters or more
SEGMENTS = 5


def _deletions(word: str, max_d: int) -> str:
    """``word`` with up to ``max_d`` letters left out, in all ways, as SQL.

    Two words within that many edits of one another have one of these in common.
    """
    one = f"transform(sequence(1, char_length({word})), i -> concat(substr({word}, 1, i - 1), substr({word}, i + 1)))"
    two = (f"flatten(transform(sequence(2, greatest(char_length({word}), 2)), j -> transform(sequence(1, j - 1), i ->"
           f" concat(substr({word}, 1, i - 1), substr({word}, i + 1, j - i - 1), substr({word}, j + 1)))))")
    return f"array_distinct(concat(array({word}){f', {one}' if max_d > 0 else ''}{f', {two}' if max_d > 1 else ''}))"


def _own_keys(word: str, max_d: int):
    """Keys of a dictionary word: if short, itself with letters left out; else its length with each of its segments."""
    start, size = _segment(f"char_length({word})", "i")
    return F.expr(f"""IF(char_length({word}) <= {SHORT}, transform({_deletions(word, max_d)}, d -> concat('-', d)),
        transform(sequence(0, {SEGMENTS - 1}), i -> concat_ws('|', char_length({word}), i, substr({word}, {start} + 1, {size}))))""")


def _met_keys(word: str, max_d: int):
    """Keys of every dictionary word that ``word`` may be within ``max_d`` (at most 2) edits of.

    Short words are met by deletions.  Of a long word's five segments two edits leave one
    untouched, at most ``max_d`` places off.  However long the word is, its keys are bounded.
    """
    start, size = _segment("l", "i")
    at = f"({start} + 1 + s)"
    return F.expr(f"""concat(
        IF(char_length({word}) BETWEEN 1 AND {SHORT + max_d}, transform({_deletions(word, max_d)}, d -> concat('-', d)), array()),
        IF(char_length({word}) + {max_d} > {SHORT}, array_distinct(filter(flatten(transform(
          sequence(greatest(char_length({word}) - {max_d}, {SHORT + 1}), char_length({word}) + {max_d}), l ->
            flatten(transform(sequence(0, {SEGMENTS - 1}), i -> transform(sequence(-{max_d}, {max_d}), s ->
              IF({at} >= 1 AND {at} + {size} - 1 <= char_length({word}), concat_ws('|', l, i, substr({word}, {at}, {size})), NULL)))))),
          k -> k IS NOT NULL)), array()))""")


def _swaps(word: str) -> str:
    """``word`` with two neighbouring letters swapped, in all ways, as SQL."""
    return (f"transform(sequence(1, greatest(char_length({word}) - 1, 1)), i -> concat(substr({word}, 1, i - 1),"
            f" substr({word}, i + 1, 1), substr({word}, i, 1), substr({word}, i + 2)))")


def _edits(a: str, b: str):
    """Edits between two words, swaps of neighbours being one each, up to 2; null beyond."""
    plain = f"levenshtein({a}, {b}, 4)"  # two swaps are four plain edits
    swapped = (f"exists({_swaps(a)}, x -> levenshtein(x, {b}, 1) >= 0) OR exists({_swaps(b)}, x -> levenshtein({a}, x, 1) >= 0)"
               f" OR arrays_overlap({_swaps(a)}, {_swaps(b)})")
    return F.expr(f"""CASE WHEN {plain} < 0 THEN NULL WHEN {plain} < 2 THEN {plain}
        WHEN {plain} = 2 THEN IF(char_length({a}) = char_length({b}) AND array_contains({_swaps(a)}, {b}), 1, 2)
        WHEN {swapped} THEN 2 END""")


def word_counts(df: DataFrame, column: str, lower: bool = True) -> DataFrame:
    """(word, freq) over all ``\\w+`` words of a text column."""
    x = F.lower(F.col(column)) if lower else F.col(column)
    return (df.select(F.explode(F.regexp_extract_all(x, F.lit(f"({WORD}+)"), 1)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("freq")))


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write under the shared scratch folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spelling_corrections(words: DataFrame, dictionary: DataFrame, max_distance: int = 2) -> DataFrame:
    """(word, corrected) for distinct ``words``: known words map to themselves; unknown words
    to the closest dictionary word (distance 1 before 2, then frequency, then alphabetical),
    or to themselves when nothing is within ``max_distance``.  Swapped neighbours are one edit."""
    # both sides are read several times, and may cost a scan of a corpus each
    w = _written(words.select("word").distinct(), "spell-words")
    dic = _written(dictionary.select(F.col("word").alias("cand"), "freq"), "spell-dictionary")
    known = w.join(dic, w["word"] == dic["cand"], "left_semi")
    unknown = w.join(dic, w["word"] == dic["cand"], "left_anti")
    if max_distance > 2:
        raise ValueError("words are matched by five segments, which bears two edits at most")
    # dealt by number: words are few bytes but many keys, and AQE would put them into one task by their bytes
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    qk = unknown.repartition(n, "word").select("word", F.explode(_met_keys("word", max_distance)).alias("key")).repartition(n, "key")
    dk = dic.where(F.col("cand") != "").repartition(n, "cand").select(
        "cand", "freq", F.explode(_own_keys("cand", max_distance)).alias("key")).repartition(n, "key")
    near = F.abs(F.char_length("word") - F.char_length("cand")) <= max_distance
    cands = (qk.join(dk, "key").where(near).withColumn("dist", _edits("word", "cand"))
             .where(F.col("dist") <= max_distance).select("word", "cand", "freq", "dist").distinct())
    win = Window.partitionBy("word").orderBy("dist", F.desc("freq"), "cand")
    best = cands.withColumn("_r", F.row_number().over(win)).where("_r = 1").select("word", "cand")
    fixed = unknown.join(best, "word", "left").select("word", F.coalesce("cand", "word").alias("corrected"))
    return known.select("word", F.col("word").alias("corrected")).unionByName(fixed)


def spell_summary(df: DataFrame, columns: Sequence[str], dictionary: DataFrame,
                  max_distance: int = 2) -> DataFrame:
    """Comma items, trimmed and lower-cased, blanks dropped, each word spell-corrected;
    counts and percent of items (2 dp, half-even) per column, largest first."""
    parts = []
    dictionary = _written(dictionary.select("word", "freq"), "spell-dictionary") if len(columns) > 1 else dictionary
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Column '{c}' not found.")
        items = (balance(df.select(c), c).where(F.col(c).isNotNull())
                 .select(F.explode(F.split(F.col(c).cast("string"), ",")).alias("item"))
                 .select(F.lower(S.strip_whitespace("item")).alias("item")).where(F.col("item") != ""))
        ic = _written(items.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "spell-items")
        toks = ic.select("item", F.posexplode(F.regexp_extract_all("item", F.lit(WORD_SPLIT), 1)).alias("pos", "tok"))
        is_word = F.col("tok").rlike(f"^{WORD}+$")
        said = toks.where(is_word)
        corr = spelling_corrections(said.select(F.col("tok").alias("word")), dictionary, max_distance)
        # white space and signs, half of all tokens, pass by the join
        fixed = (said.join(corr, said["tok"] == corr["word"], "left")
                 .select("item", "pos", F.coalesce("corrected", "tok").alias("tok"))
                 .unionByName(toks.where(~is_word)))
        rebuilt = fixed.groupBy("item").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda s: s["tok"]),
                         "").alias("corrected"))
        # written, or the total would run all of the above once more
        cnt = _written(ic.join(rebuilt, "item").groupBy("corrected").agg(F.sum("n").alias("count")), "spell-counts")
        tot = cnt.select(F.sum("count")).scalar()  # scalar subquery, no single-partition window
        parts.append(cnt.select(F.lit(c).alias("question"), F.col("corrected").alias("item"),
                                F.col("count").cast("long").alias("count"),
                                F.bround(F.col("count") / F.lit(tot) * 100.0, 2).alias("pct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("question", F.desc("pct"), "item")


# ---------------------------------------------------------------------------
# Translation memory
# ---------------------------------------------------------------------------


def translate_tm(df: DataFrame, column: str, lang_col: str | None, source_lang: str, memory: DataFrame,
                 out: str | None = None, check_language: bool = True) -> DataFrame:
    """Translate a text column from a translation memory (lang, text, translated).

    ``check_language=True``: NULL and blank cells become '', cells whose language
    is ``source_lang`` take the stored translation, a miss keeps the original.
    ``check_language=False`` (the service variant): every cell is looked up in
    ``source_lang``'s memory except blank / 'nan' / 'none', which stay as they
    are (NULL stays NULL).  Memory rows are deduplicated per (lang, text), so a
    repeated text never multiplies documents; the join key is a text hash.
    """
    out = out or f"{column}_translated"
    tm = (memory.groupBy("lang", "text").agg(F.min("translated").alias("translated"))
          .select(F.col("lang").alias("_l"), F.xxhash64("text").alias("_h"), F.col("text").alias("_t"),
                  "translated"))
    x = df.withColumn("_h", F.xxhash64(column))
    row_lang = F.col(lang_col) if (check_language and lang_col) else F.lit(source_lang)
    j = x.join(tm, (x["_h"] == tm["_h"]) & (row_lang == tm["_l"]) & (F.col(column) == tm["_t"]), "left")
    c = F.col(column)
    stripped = S.strip_whitespace(c)
    if check_language:
        res = (F.when(c.isNull() | (stripped == ""), F.lit(""))
               .when(F.col(lang_col) == source_lang, F.coalesce("translated", c)).otherwise(c))
    else:
        res = F.when(c.isNull() | F.lower(stripped).isin("", "nan", "none"), c).otherwise(
            F.coalesce("translated", c))
    return j.select(*[x[k] for k in df.columns], res.alias(out))
