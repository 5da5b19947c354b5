"""Null is unknown, never zero. NaN never leaves a reader."""

from pyspark.sql import Column, DataFrame, functions as F, types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating column with NaN turned into null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def blank_to_null(col: Column) -> Column:
    t = F.trim(col)
    return F.when(t != "", t)


def to_number(col: Column) -> Column:
    """Text or number → double; what does not parse, and NaN, is null."""
    v = F.trim(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero or null."""
    return num / F.when(den != 0, den)


def sum_or_zero(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0.0))


def yes_flag(col: Column) -> Column:
    """Y / YES / TRUE / 1 in any case; a blank is a no."""
    return F.coalesce(F.upper(F.trim(col.cast("string"))).isin("Y", "YES", "TRUE", "1"), F.lit(False))


def yes_or_unknown(col: Column) -> Column:
    """'yes' → true, any other text → false, null → null."""
    return F.lower(F.trim(col.cast("string"))) == "yes"


def one_of(col: Column, allowed) -> Column:
    """Membership that is false, not null, for a null value."""
    return F.coalesce(col.isin(list(allowed)), F.lit(False))


def is_true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))
