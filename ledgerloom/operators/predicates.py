"""Projections, filters and row predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.numbers import as_double
from ledgerloom.functions.text import any_of, contains_text, is_missing, named, strip
from ledgerloom.sources.contracts import REQUIRED_COLUMNS


def project_tx(tx: DataFrame) -> DataFrame:
    """The six columns the job reads, with the amount as a double."""
    return tx.select(
        "transaction_id", "customer_id", "merchant_id", "transaction_date", "status",
        as_double(tx, "amount").alias("amount"),
    )


def project_alerts(alerts: DataFrame) -> DataFrame:
    """The columns of the alerts that the job reads."""
    return alerts.select("transaction_id", "alert_status")


def project_loans(loans: DataFrame) -> DataFrame:
    """The columns of the loans that the job reads."""
    return loans.select("customer_id", "loan_id")


def trim_all(df: DataFrame) -> DataFrame:
    """Strip every text cell; other columns pass through."""
    return df.select([
        strip(named(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else named(f.name)
        for f in df.schema.fields
    ])


def null_or_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(is_missing(F.col(column)))


def nonempty_key(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither null nor empty."""
    if isinstance(df.schema[key].dataType, T.StringType):
        return df.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return df.filter(F.col(key).isNotNull())


def missing_columns(dataset: str, present: list[str]) -> list[str]:
    """Required columns of a known dataset that a file lacks, in contract order."""
    return [c for c in REQUIRED_COLUMNS.get(dataset, []) if c not in present]


def require_columns(dataset: str, present: list[str]) -> None:
    missing = missing_columns(dataset, present)
    if missing:
        raise ValueError(f"Required columns are missing: {', '.join(missing)}")


def required_columns(landings: DataFrame) -> DataFrame:
    """Per landing row (``dataset``, ``columns`` array): the required columns it lacks."""
    contract = F.create_map(*[
        part
        for name, columns in REQUIRED_COLUMNS.items()
        for part in (F.lit(name), F.array(*[F.lit(c) for c in columns]))
    ])
    required = F.coalesce(
        F.try_element_at(contract, F.col("dataset")), F.array().cast("array<string>")
    )
    return landings.withColumn("missing", F.array_except(required, F.col("columns")))


def reject_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("The file has a header but no rows.")
    return df


def status_landed(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("pipeline_status") == "landed")


def status_ready(registry: DataFrame) -> DataFrame:
    unset = F.coalesce(F.col("pipeline_status"), F.lit("")) == ""
    return registry.filter(
        (F.col("pipeline_status") == "analytics_ready") | ((F.col("status") == "success") & unset)
    )


def status_failed(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "failed")


def classify(dataset: Column) -> Column:
    return F.when(dataset.isin(list(REQUIRED_COLUMNS)), "finance").otherwise("external")


def date_range(df: DataFrame, column: str, today: dt.date, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days, counted from a given day."""
    return df.filter(F.col(column) >= F.lit(today - dt.timedelta(days=days)))


def prefix_like(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(F.lower(F.col(column)).startswith(prefix.lower()))


def search_any_cell(df: DataFrame, needle: str, column: str | None = None) -> DataFrame:
    """Rows with the needle in any cell, or in one column; a blank needle keeps all rows."""
    needle = needle.strip()
    if not needle:
        return df
    columns = [column] if column in df.columns else df.columns
    return df.filter(any_of([contains_text(named(c), needle) for c in columns]))


def search_concat(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows whose chosen columns, joined by spaces, contain the needle."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.filter(contains_text(joined, needle))


def hide_failed_jobs(jobs: DataFrame, hide: bool = True) -> DataFrame:
    if not hide:
        return jobs
    return jobs.filter(F.coalesce(F.lower("status"), F.lit("")) != "failed")


def numeric_columns(df: DataFrame) -> DataFrame:
    """Columns with at least one parseable number: (position, column, numeric_count)."""
    counts = df.agg(*[
        F.count(
            as_double(df, f.name) if isinstance(f.dataType, (T.StringType, T.NumericType))
            else F.lit(None)
        ).alias(f"n{i}")
        for i, f in enumerate(df.schema.fields)
    ])
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.col(f"n{i}").alias("numeric_count"))
        for i, c in enumerate(df.columns)
    ])
    return counts.select(F.inline(cells)).filter("numeric_count > 0")


def chart_series(df: DataFrame, x: str, y: str, order: list[Column], n: int = 20) -> DataFrame:
    """The first ``n`` plottable (ord, label, value) rows in a given order."""
    points = (
        df.withColumn("label", F.coalesce(F.col(x).cast("string"), F.lit("")))
        .withColumn("value", as_double(df, y))
        .filter((F.col("label") != "") & F.col("value").isNotNull())
        .orderBy(*order)
        .limit(n)
    )
    # The window runs over the n rows kept above.
    ord_ = F.row_number().over(Window.orderBy(*order)) - 1
    return points.select(ord_.alias("ord"), "label", "value")
