"""Missing and undefined numbers: NaN is turned to null once, and ratios have a guard instead of an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame) -> DataFrame:
    """All floating columns with NaN as null, so that comparisons and aggregates leave them out."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def ratio_or_zero(num: Column, den: Column, least: float = 1e-12) -> Column:
    """Retrieval's guard: 0 where the denominator is at most `least`."""
    return F.when(den > least, num / den).otherwise(F.lit(0.0))


def ratio_or_null(num: Column, den: Column) -> Column:
    """The response function's guard: missing where the denominator isn't positive."""
    return F.when(den > 0, num / den)


def number(c: Column) -> Column:
    """A tolerant cast: text that is no number is null."""
    return c.try_cast("double")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, failing when it is run if a row doesn't meet the condition."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
