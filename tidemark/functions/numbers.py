"""Number expressions that are safe under ANSI mode and never yield NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number in text. Spark alone would also take '1d' or '1f'.
NUMBER_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"

WHITE_SPACE = " \t\n\x0b\f\r"
# Amounts are summed as exact decimals with this many digits after the point, and
# twenty before it; a larger amount is an error, not NULL.
AMOUNT_SCALE = 8
AMOUNT = f"decimal(28,{AMOUNT_SCALE})"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def no_nan(value: Column | str) -> Column:
    """NaN becomes NULL."""
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def present(df: DataFrame, column: str) -> Column:
    """A column of ``df`` with NaN as NULL, whatever its type."""
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return no_nan(F.col(f"`{column}`"))
    return F.col(f"`{column}`")


def strip(text: Column | str) -> Column:
    """Text without white space at both ends, tabs and line ends included."""
    return F.btrim(as_column(text), F.lit(WHITE_SPACE))


def to_double(text: Column | str) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(NUMBER_TEXT), trimmed.try_cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL where the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def amount_of(df: DataFrame, column: str) -> Column:
    """A column of ``df`` as an exact amount; text that is no number and NaN are NULL."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return to_double(column).cast(AMOUNT)
    return no_nan(F.col(column).cast("double")).cast(AMOUNT)


def money_sum(value: Column | str) -> Column:
    """Sum that does not depend on the order of rows; 0 for no rows.

    Adding decimals is exact, so a task that is run again gives the same digits.
    """
    total = F.sum(as_column(value).cast(AMOUNT)).cast("double")
    return F.coalesce(total, F.lit(0.0))


def money_avg(value: Column | str) -> Column:
    value = as_column(value)
    return ratio(F.sum(value.cast(AMOUNT)).cast("double"), F.count(value))


def corr_of(x: Column, y: Column, window=None) -> Column:
    """Pearson correlation, NULL where one side does not vary.

    The built-in ``corr`` divides by zero there, which fails under ANSI mode.
    """
    parts = [F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)]
    if window is not None:
        parts = [part.over(window) for part in parts]
    covar, sx, sy = parts
    return F.try_divide(covar, sx * sy)
