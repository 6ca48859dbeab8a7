"""Small Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)


def col(c: str | Column) -> Column:
    return F.col(quote(c)) if isinstance(c, str) else c


def quote(name: str) -> str:
    """Back-quote a column name so dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def as_double(c: str | Column) -> Column:
    """Cast to double and map NaN to NULL: one notion of "missing"."""
    x = col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns (pandas ``isna``)."""
    dtype = df.schema[name].dataType
    c = col(name)
    if isinstance(dtype, FRACTIONAL_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL when den is 0 (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    """Percentage rounded to ``digits``; 0 for an empty denominator."""
    return F.round(F.coalesce(ratio(num, den) * F.lit(100.0), F.lit(0.0)), digits)


def round_to(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def dlit(v) -> Column:
    """A double literal (NULL for None)."""
    return F.lit(None if v is None else float(v)).cast("double")
