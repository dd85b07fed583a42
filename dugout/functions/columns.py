"""Column functions: coercion of raw text, buckets, and rates on decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- raw text ---------------------------------------------------------------


def text_or_null(c: ColumnOrName) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def id_or_null(c: ColumnOrName) -> Column:
    """Trimmed text; blank and ``(none)`` are null."""
    return F.nullif(text_or_null(c), F.lit("(none)"))


def int_or_null(c: ColumnOrName) -> Column:
    """An integer of digits with an optional minus sign, else null; ``+7``, ``1.5`` and ``6-05`` are null."""
    t = F.trim(_c(c))
    return F.when(t.rlike(r"^-?\d+$"), t.try_cast("int"))


def bool_or_null(c: ColumnOrName) -> Column:
    t = F.lower(F.trim(_c(c)))
    return F.when(t.isin("true", "t", "1"), True).when(t.isin("false", "f", "0"), False)


def us_date(c: ColumnOrName) -> Column:
    """``M/D/YYYY``; anything else, and impossible dates, are null."""
    t = F.trim(_c(c))
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "M/d/yyyy"))


def slash_date(c: ColumnOrName) -> Column:
    """``YYYY/M/D``; anything else, and impossible dates, are null."""
    t = F.trim(_c(c))
    return F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(t, "yyyy/M/d"))


def compact_date(c: ColumnOrName) -> Column:
    """``YYYYMMDD``; anything else, and impossible dates, are null."""
    t = F.trim(_c(c))
    return F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))


def balls_and_strikes(c: ColumnOrName) -> Column:
    """A struct of both numbers of a two-digit count, null otherwise."""
    t = F.trim(_c(c))
    counted = t.rlike(r"^\d\d$")
    return F.struct(
        F.when(counted, F.substring(t, 1, 1).cast("short")).alias("balls"),
        F.when(counted, F.substring(t, 2, 1).cast("short")).alias("strikes"),
    )


# --- buckets, rates and tests -----------------------------------------------


def decade(c: ColumnOrName) -> Column:
    """The first year of a date's decade."""
    return (F.floor(F.year(_c(c)) / 10) * 10).cast("int")


def rate(numerator: ColumnOrName, denominator: ColumnOrName, digits: int = 3, factor: int = 1) -> Column:
    """factor * numerator / denominator as a rounded decimal (half away from zero); null over zero."""
    top = (_c(numerator) * factor).cast("decimal(20,6)")
    bottom = F.nullif(_c(denominator).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    return F.round((top / bottom).cast("decimal(38,12)"), digits).cast(f"decimal(20,{digits})")


def count_if(condition: Column) -> Column:
    """Rows for which the condition holds; 0 if there are none."""
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, value: ColumnOrName) -> Column:
    """Sum over the rows for which the condition holds; null if there are none."""
    return F.sum(F.when(condition, _c(value)))


def standard_error(value: ColumnOrName) -> Column:
    return F.stddev_samp(_c(value)) / F.sqrt(F.count(_c(value)))


def welch_t(in_first: Column, value: ColumnOrName) -> Column:
    """Welch's t between the rows for which the condition holds and those for which it doesn't, in one aggregation."""
    v = _c(value)
    a, b = F.when(in_first, v), F.when(~in_first, v)
    return (F.avg(a) - F.avg(b)) / F.nullif(F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)), F.lit(0.0))


def regular_season(game_type: ColumnOrName) -> Column:
    """A missing game type counts as a regular game."""
    t = _c(game_type)
    return t.isNull() | (t == "regular")
