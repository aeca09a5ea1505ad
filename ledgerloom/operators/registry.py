"""Analytics and upkeep of the dataset registry and the append-only logs, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.limits import last_days
from ledgerloom.operators.skew import lookup_join

KEPT = 500
SHOWN = 300


def uploads_by_day(registry: DataFrame, days: int = 14) -> DataFrame:
    """Registry rows per day, the last ``days`` days that have rows, ascending."""
    day = F.substring(F.coalesce(F.col("uploaded_at").cast("string"), F.lit("")), 1, 10)
    counts = (
        registry.select(day.alias("label")).filter(F.col("label") != "")
        .groupBy("label").agg(F.count("*").cast("double").alias("value"))
    )
    return last_days(counts, "label", days)


def status_mix(registry: DataFrame) -> DataFrame:
    """Registry rows per pipeline status, blank shown as ``unknown``."""
    status = F.coalesce(F.nullif(F.col("pipeline_status"), F.lit("")), F.lit("unknown"))
    return (
        registry.select(status.alias("label")).groupBy("label")
        .agg(F.count("*").cast("double").alias("value"))
    )


def delegate_summary(registry: DataFrame) -> DataFrame:
    """Totals over the successful registry rows."""
    kind = F.col("classification")
    return registry.filter(F.col("status") == "success").agg(
        F.count("*").alias("successful_datasets"),
        F.count_if(kind == "finance").alias("finance_datasets"),
        F.count_if(kind == "external").alias("external_datasets"),
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("total_rows_processed"),
    )


def registry_update(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply updates to the newest row of each (uploaded_at, dataset); non-null values win.

    ``updates`` holds one row per key.
    """
    keys = ["uploaded_at", "dataset"]
    values = [c for c in updates.columns if c not in keys]
    newest = registry.groupBy(*keys).agg(F.max("seq").alias("seq"))
    target = newest.join(
        updates.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values]), keys
    ).drop(*keys)
    joined = registry.join(target, "seq", "left")
    return joined.select([
        F.coalesce(f"new_{c}", c).alias(c) if c in values else F.col(c) for c in registry.columns
    ])


def ready_times(markers: DataFrame) -> DataFrame:
    """Ready time per dataset: the marker, else the legacy ``ok`` marker.

    ``markers``: dataset, kind (``analytics_ready`` or ``ok``), stamp.
    """
    def newest(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("stamp")))

    return markers.groupBy("dataset").agg(
        F.coalesce(newest("analytics_ready"), newest("ok")).alias("ready_at"),
    ).filter(F.col("ready_at").isNotNull())


def mark_ready(registry: DataFrame, ready: DataFrame) -> DataFrame:
    """Registry rows with the ready time of their dataset (null where not ready)."""
    return lookup_join(registry, ready.select("dataset", "ready_at"), "dataset")
