"""Number parsing and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import named, strip

# Decimal notation accepted for a measure; digits may be grouped by single "_".
_DIGITS = r"\d+(?:_\d+)*"
_MANTISSA = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})"
PLAIN_NUMBER = rf"{_MANTISSA}$"
EXPONENT_NUMBER = rf"{_MANTISSA}[eE][+-]?{_DIGITS}$"

MONEY = T.DecimalType(18, 2)
WIDE = T.DecimalType(28, 2)  # its sums are TOTAL
TOTAL = T.DecimalType(38, 2)


def lenient_double(value: Column, stripped: bool = False) -> Column:
    """Parse text as a finite double; anything else becomes null.

    Plain notation comes first: it cannot overflow, so its cells are parsed just once.
    """
    text = value if stripped else strip(value)
    parsed = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    long = F.length(text) >= 300
    may_overflow = text.rlike(EXPONENT_NUMBER) | (long & text.rlike(PLAIN_NUMBER))
    return F.when(~long & text.rlike(PLAIN_NUMBER), parsed).when(
        may_overflow & (F.abs(parsed) < F.lit(float("inf"))), parsed
    )


def as_double(
    df: DataFrame, column: str, blank: float | None = None, stripped: bool = False
) -> Column:
    """The column as a double: typed columns are cast, text is parsed leniently.

    ``blank`` is the value of a null or empty cell (null when not given); ``stripped``
    says that text cells have no outer whitespace.
    """
    source = named(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        value = lenient_double(source, stripped)
        if blank is not None:
            value = F.when(F.coalesce(source, F.lit("")) == "", F.lit(blank)).otherwise(value)
        return value
    value = source.cast("double")
    return value if blank is None else F.coalesce(value, F.lit(blank))


def as_money(df: DataFrame, column: str) -> Column:
    """The column as DECIMAL(28,2), rounded half up; what does not parse is null, as is 1e26 and more."""
    source = named(column)
    if not isinstance(df.schema[column].dataType, T.StringType):
        return source.try_cast(WIDE)
    text = strip(source)
    is_number = text.rlike(PLAIN_NUMBER) | text.rlike(EXPONENT_NUMBER)
    return F.when(is_number, F.replace(text, F.lit("_"), F.lit("")).try_cast(WIDE))


def whole_amount(df: DataFrame, column: str) -> Column:
    """The number as written, cut toward zero before any rounding; unparseable cells count 0."""
    value = as_double(df, column)
    return F.coalesce(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)), F.lit(0)).cast("bigint")


def total(value: Column) -> Column:
    """Exact, order-independent money sum."""
    return F.sum(value).cast(TOTAL)


def whole_text(value: Column) -> Column:
    """A double printed with no decimals, halves to even; keeps the sign of a negative zero."""
    rounded = F.bround(value, 0)
    text = rounded.cast("bigint").cast("string")
    return F.when((rounded == 0) & (value < 0), F.concat(F.lit("-"), text)).otherwise(text)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, int(value)))
