"""Column profile: missing cells and numeric range of every column in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.numbers import as_double
from ledgerloom.functions.text import is_missing, named

DIGITS = 4


def with_numbers(df: DataFrame, trimmed: bool = False) -> DataFrame:
    """The frame plus one parsed number per column, so each cell is parsed once."""
    nothing = F.lit(None).cast("double")
    return df.select("*", *[
        (as_double(df, name, stripped=trimmed) if _numeric_or_text(df, name) else nothing).alias(f"_v{i}")
        for i, name in enumerate(df.columns)
    ])


def _is_missing(cell: Column, kind: T.DataType | None, trimmed: bool) -> Column:
    """Null, blank text, or an array or map of nothing."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return cell.isNull() | (F.size(cell) <= 0)
    if kind is not None and not isinstance(kind, T.StringType):
        return cell.isNull()
    return F.coalesce(cell, F.lit("")) == "" if trimmed else is_missing(cell)


def profile_measures(columns: list[str], trimmed: bool = False, kinds: dict[str, T.DataType] | None = None) -> list[Column]:
    """Aggregates over all columns of ``with_numbers``; usable in ``agg`` and in ``observe``.

    ``trimmed`` says that the text cells are stripped already; ``kinds`` are the columns' types, where
    they are not all text.
    """
    measures = [F.count(F.lit(1)).alias("row_count")]
    for i, name in enumerate(columns):
        cell, value = named(name), F.col(f"_v{i}")
        missing = _is_missing(cell, (kinds or {}).get(name), trimmed)
        measures += [
            F.count_if(missing).alias(f"nulls_{i}"),
            F.count(value).alias(f"count_{i}"),
            F.min(value).alias(f"min_{i}"),
            F.max(value).alias(f"max_{i}"),
            F.sum(value).alias(f"sum_{i}"),
        ]
    return measures


def _numeric_or_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.NumericType))


def _rows(measured: DataFrame, columns: list[str]) -> DataFrame:
    cells = []
    for i, name in enumerate(columns):
        average = F.col(f"sum_{i}") / F.nullif(F.col(f"count_{i}"), F.lit(0))
        cells.append(F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.col("row_count"),
            F.col(f"nulls_{i}").alias("null_count"),
            F.col(f"count_{i}").alias("numeric_count"),
            F.round(f"min_{i}", DIGITS).alias("min"),
            F.round(f"max_{i}", DIGITS).alias("max"),
            F.round(average, DIGITS).alias("avg"),
        ))
    return measured.select(F.inline(F.array(*cells)))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, row_count, null_count, numeric_count, min, max, avg."""
    return _rows(with_numbers(df).agg(*profile_measures(df.columns)), df.columns)


def profile_nulls(df: DataFrame) -> DataFrame:
    counts = df.agg(*[
        F.count_if(is_missing(named(c))).alias(f"n{i}") for i, c in enumerate(df.columns)
    ])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count"))
             for i, c in enumerate(df.columns)]
    return counts.select(F.inline(F.array(*cells)))


def profile_numeric(df: DataFrame) -> DataFrame:
    """Range and mean of the columns that hold at least one number."""
    return profile(df).filter("numeric_count > 0").select("column", "min", "max", "avg")


def profile_insights(df: DataFrame) -> DataFrame:
    """The same profile as one nested record."""
    rows = profile(df)
    by_position = F.sort_array(F.collect_list(F.struct("position", "column", "null_count",
                                                       "numeric_count", "min", "max", "avg")))
    record = rows.agg(F.max("row_count").alias("row_count"), by_position.alias("cols"))
    numeric = F.filter("cols", lambda c: c["numeric_count"] > 0)
    return record.select(
        F.transform("cols", lambda c: c["column"]).alias("columns"),
        "row_count",
        F.map_from_entries(
            F.transform("cols", lambda c: F.struct(c["column"], c["null_count"]))
        ).alias("null_counts"),
        F.map_from_entries(F.transform(
            numeric,
            lambda c: F.struct(c["column"], F.struct(
                c["min"].alias("min"), c["max"].alias("max"), c["avg"].alias("avg"))),
        )).alias("numeric_summary"),
    )


def insights_of(observed: dict, columns: list[str]) -> Row:
    """The nested record from measures observed while a frame was written."""
    ranges = {}
    for i, name in enumerate(columns):
        n = observed[f"count_{i}"]
        if n:
            ranges[name] = Row(
                min=round(observed[f"min_{i}"], DIGITS),
                max=round(observed[f"max_{i}"], DIGITS),
                avg=round(observed[f"sum_{i}"] / n, DIGITS),
            )
    return Row(
        columns=list(columns),
        row_count=observed["row_count"],
        null_counts={c: observed[f"nulls_{i}"] for i, c in enumerate(columns)},
        numeric_summary=ranges,
    )
