"""Column-level scalar functions (all native Spark expressions, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the reference's name cleaners.
FILENAME_BAD_CHARS = r'[<>:"/\\|?*]'
SHEET_BAD_CHARS = r"[\\/*?\[\]:]"
SAFE_SHEET_BAD_CHARS = r"[:\\/?*\[\]]"
SHEET_MAX = 31
# Fixed value: the characters Python's str.strip() treats as whitespace, as a
# regex class both Java regex and RE2 read the same way.
PY_WHITESPACE = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_whitespace(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of every kind."""
    return F.regexp_replace(_c(c), f"\\A{PY_WHITESPACE}+|{PY_WHITESPACE}+\\z", "")


def to_float(c, keep_sign: bool = False) -> Column:
    """Delete every character that is not a digit or '.', then parse; unparsable -> NULL.

    ``-5`` becomes 5 and ``1e3`` becomes 13 by design (the reference's rule);
    ``keep_sign=True`` also keeps a minus sign.
    """
    pattern = r"[^0-9.\-]" if keep_sign else r"[^0-9.]"
    cleaned = F.regexp_replace(_c(c).cast("string"), pattern, "")
    return cleaned.try_cast("double")


def ten_to_five(c) -> Column:
    """{1,2}->1, {3,4}->2, {5,6}->3, {7,8}->4, {9,10}->5; other values unchanged."""
    x = _c(c)
    return F.when(x.isin([float(i) for i in range(1, 11)]), F.ceil(x / 2).cast("double")).otherwise(x)


def invert_ten(c) -> Column:
    """11 - x; NULL stays NULL."""
    return F.lit(11.0) - _c(c)


def sanitize_filename(c) -> Column:
    return F.regexp_replace(_c(c), FILENAME_BAD_CHARS, "_")


def clean_sheet_name(c) -> Column:
    return F.substring(F.regexp_replace(_c(c), SHEET_BAD_CHARS, "_"), 1, SHEET_MAX)


def cata_sheet_name(c) -> Column:
    """31 characters before the first '?' preceded by 31 characters, else s[-31:-1]."""
    x = _c(c)
    m = F.regexp_extract(x, r"(.{31})\?", 1)
    n = F.char_length(x)
    start = F.greatest(n - F.lit(31), F.lit(0)) + 1
    tail = F.substr(x, start, F.greatest(n - start, F.lit(0)))
    return F.when(x.rlike(r"(.{31})\?"), m).otherwise(tail)


def clean_text(c) -> Column:
    """Zero-width space -> space, collapse whitespace runs, strip."""
    x = F.replace(_c(c).cast("string"), F.lit("\u200b"), F.lit(" "))
    # single spaces stay as they are, and printable ASCII is told by one comparison: the plain pattern takes far longer
    return F.trim(F.regexp_replace(x, f"(?![!-~])(?:{PY_WHITESPACE}{{2,}}|(?! ){PY_WHITESPACE})", " "))


def auto_topics(n) -> Column:
    """n > 10: clamp(round(2 ln n), 3, 8); otherwise 3.  Python round is half-even."""
    x = _c(n)
    return F.when(x > 10, F.greatest(F.lit(3), F.least(F.lit(8), F.bround(2 * F.log(x), 0).cast("int")))
                  ).otherwise(F.lit(3))


def last_underscore_part(c) -> Column:
    return F.element_at(F.split(_c(c), "_"), -1)


def rsplit_colon(c) -> tuple[Column, Column]:
    """Split at the last ':'; (NULL, NULL) when there is no colon."""
    x = _c(c)
    pat = r"^(.*):([^:]*)$"
    has = x.rlike(pat)
    return (F.when(has, F.regexp_extract(x, pat, 1)), F.when(has, F.regexp_extract(x, pat, 2)))


def safe_sheet_labels(df, col: str, suffix: str = "", out: str = "sheet"):
    """Unique sheet labels: bad characters -> space, stripped, cut to fit 31 with ``suffix``.

    In order of ``col``, a label that is taken gets ``_2``, ``_3`` ... until it is free, so
    numbering a label never hits another column's own name.  Labels that can meet share
    their first characters (without trailing numbers), which is what they are grouped by.
    """
    clean = strip_whitespace(F.regexp_replace(F.col(col), SAFE_SHEET_BAD_CHARS, " "))
    maxl = max(SHEET_MAX - len(suffix), 1)
    base = F.concat(F.rtrim(F.substring(clean, 1, maxl)), F.lit(suffix))
    x = df.withColumn("_base", base)
    x = x.withColumn("_meet", F.substring(F.regexp_replace("_base", r"(_\d+)+$", ""), 1, 20))
    named = x.select(F.col(col), "_base", "_meet").distinct()

    def number(pdf):
        taken, labels = set(), []
        pdf = pdf.sort_values([col, "_base"])
        for label in pdf["_base"]:
            free, k = label, 2
            while free in taken:
                free = label[:SHEET_MAX - len(f"_{k}")] + f"_{k}"
                k += 1
            taken.add(free)
            labels.append(free)
        return pdf.assign(_label=labels)[[col, "_base", "_label"]]

    schema = named.select(col, "_base", F.lit("").alias("_label")).schema
    labels = named.groupBy("_meet").applyInPandas(number, schema)
    same = x[col].eqNullSafe(labels[col]) & x["_base"].eqNullSafe(labels["_base"])
    return x.join(labels, same, "left").select(*[x[c] for c in df.columns], F.col("_label").alias(out))
