"""Column expressions shared by the operators (all JVM-side, codegen-friendly).

Conventions that keep results identical across engines:
* money stays DECIMAL while it is summed; a ratio or mean is the exact sum cast
  to DOUBLE and divided once (``mean_of``, ``ratio``);
* division never raises under ANSI mode: ``try_divide`` yields NULL on a zero
  denominator unless the reference guards it explicitly (``guarded_ratio``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: ColumnOrName) -> Column:
    return col(c).cast("double")


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den in DOUBLE; NULL when den is 0 or NULL."""
    return F.try_divide(as_double(num), as_double(den))


def mean_of(c: ColumnOrName) -> Column:
    """Exact mean aggregate: SUM (exact for decimal/int) as DOUBLE over COUNT."""
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)).cast("double"))


def indicator(cond: Column) -> Column:
    """1 where cond holds, else 0 (NULL counts as 0, like CASE WHEN)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def is_defaulted(status: ColumnOrName = "Status") -> Column:
    return indicator(col(status) == F.lit("Defaulted"))


def guarded_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """CASE WHEN den = 0 THEN 0 ELSE num / den END, in DOUBLE."""
    return F.when(col(den) == 0, F.lit(0.0)).otherwise(as_double(num) / as_double(den))


def plus_one_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / (den + 1) in DOUBLE (the feature table's guard); NULL if den = -1."""
    return F.try_divide(as_double(num), as_double(den) + F.lit(1.0))


def int_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Exact floor division of non-negative integers (a div b)."""
    a, b = col(a).cast("long"), col(b).cast("long")
    exact = (a - F.pmod(a, b)).cast("decimal(38,0)")
    return F.try_divide(exact, b.cast("decimal(38,0)")).cast("long")


def pct_round2(part: ColumnOrName, total: ColumnOrName) -> Column:
    """ROUND(100 * part / total, 2), half-up, computed exactly in integers.

    floor((20000*part + total) / (2*total)) / 100 is the half-up rounding of
    the rational 100*part/total, so no binary-float tie can tip it.
    """
    p, t = col(part).cast("long"), col(total).cast("long")
    q = int_div(p * F.lit(20000) + t, t * F.lit(2))
    return q.cast("double") / F.lit(100.0)


def month_start(d: ColumnOrName) -> Column:
    """First day of the month, as DATE (FORMAT(d,'yyyy-MM-01') / to_period('M'))."""
    return F.trunc(col(d), "MM")


def month_label(d: ColumnOrName) -> Column:
    """'yyyy-MM' label of a date."""
    return F.date_format(col(d), "yyyy-MM")


def months_of_30_days(start: ColumnOrName, as_of: str) -> Column:
    """int(days(as_of - start) / 30), truncated toward zero; NULL start -> NULL."""
    days = F.datediff(F.lit(as_of).cast("date"), col(start))
    return (days.cast("double") / F.lit(30.0)).cast("int")


def non_negative(c: ColumnOrName) -> Column:
    """max(0, c) that keeps NULL as NULL (greatest() would turn NULL into 0)."""
    return F.when(col(c).isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0), col(c)))


# Credit-score bands, right-closed: (299,600] (600,660] (660,720] (720,900].
SCORE_BANDS = [("Low", 299, 600), ("Med", 600, 660), ("High", 660, 720), ("VeryHigh", 720, 900)]


def credit_score_band(score: ColumnOrName = "CreditScore") -> Column:
    """Right-closed bands; scores outside (299, 900] or NULL map to NULL."""
    s = col(score)
    expr = F.lit(None).cast("string")
    for label, lo, hi in reversed(SCORE_BANDS):
        expr = F.when((s > lo) & (s <= hi), F.lit(label)).otherwise(expr)
    return expr


def score_bin(score: ColumnOrName = "CreditScore", width: int = 50) -> Column:
    """Fixed-width bin start: floor(score / width) * width."""
    return (F.floor(col(score) / F.lit(width)) * F.lit(width)).cast("int")


def flag_at(p: ColumnOrName, threshold: float) -> Column:
    """0/1 flag p >= threshold."""
    return (col(p) >= F.lit(float(threshold))).cast("int")


def positive_probability(prob_vector: ColumnOrName = "probability") -> Column:
    """predict_proba[:, 1] of a pyspark.ml probability vector."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(col(prob_vector)).getItem(1)


def portable_hash(key: ColumnOrName, seed: int = 42, draw: ColumnOrName | None = None) -> Column:
    """Deterministic 31-bit hash of (key, seed[, draw]): the leading bits of an MD5.

    Any SQL engine evaluates it identically, so a split or sample depends on
    keys only, never on partitioning.  It is not linear: another seed is
    another shuffle.  It takes text, so no 64-bit key overflows."""
    parts = [col(key).cast("string"), F.lit(str(seed))] + ([col(draw).cast("string")] if draw is not None else [])
    text = parts[0]
    for x in parts[1:]:
        text = F.concat(text, F.lit(":"), x)
    return F.shiftright(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), 1)


def portable_hash_sql(key: str, seed: int = 42, draw: str | None = None) -> str:
    """The same hash as SQL text (for the oracle)."""
    text = f"CAST(({key}) AS VARCHAR) || ':{seed}'" + (f" || ':' || CAST(({draw}) AS VARCHAR)" if draw else "")
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) >> 1)"


def coerce_numeric(c: ColumnOrName, to: str = "double", strict: bool = True) -> Column:
    """Parse to a number.  strict: an unparsable value fails the job (ANSI
    cast); otherwise it becomes NULL (``try_cast``) for a quarantine step."""
    return col(c).cast(to) if strict else F.expr(f"try_cast({_sql_name(c)} AS {to})")


def _sql_name(c: ColumnOrName) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("coerce_numeric(strict=False) takes a column name")


def parse_date(c: ColumnOrName, fmt: str = "yyyy-MM-dd", strict: bool = True) -> Column:
    """Parse text to DATE.  strict: a malformed value fails the job; otherwise
    it becomes NULL (``try_to_timestamp``) for a quarantine step."""
    if strict:
        return F.to_date(col(c), fmt)
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("date")
