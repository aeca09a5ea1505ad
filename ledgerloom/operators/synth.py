"""Synthetic customers and accounts, one per index row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Regions dealt in turn.
REGIONS = ("Central", "East", "West", "North")


def index_range(spark: SparkSession, n: int) -> DataFrame:
    """Index rows 1..n."""
    return spark.range(1, max(1, n) + 1).select(F.col("id").alias("i"))


def synth_customers(index: DataFrame) -> DataFrame:
    regions = F.array(*[F.lit(r) for r in REGIONS])
    return index.select(
        F.format_string("CUST%05d", "i").alias("customer_id"),
        F.concat(F.lit("Customer "), F.col("i").cast("string")).alias("full_name"),
        F.element_at(regions, (F.pmod(F.col("i") - 1, F.lit(len(REGIONS))) + 1).cast("int")).alias("region"),
    )


def synth_accounts(index: DataFrame) -> DataFrame:
    step = F.pmod(F.col("i"), F.lit(1000)).cast("decimal(18,0)") * F.lit("1000.50").cast("decimal(18,2)")
    return index.select(
        F.format_string("ACC%05d", "i").alias("account_id"),
        F.format_string("CUST%05d", "i").alias("customer_id"),
        (F.lit("500000.00").cast("decimal(18,2)") + step).cast("decimal(18,2)").alias("current_balance"),
    )


def range_totals(spark: SparkSession, n: int, tasks: int = 8) -> DataFrame:
    """Count and sum of 0..n-1, spread over several tasks."""
    return spark.range(0, n, 1, tasks).agg(
        F.count("*").alias("range_count"), F.coalesce(F.sum("id"), F.lit(0)).alias("range_sum")
    )


def range_smoke(spark: SparkSession, n: int = 1000) -> tuple[int, int]:
    """Cluster smoke check: counts 0..n-1 and sums 0..9."""
    count = range_totals(spark, n).first().range_count
    total = range_totals(spark, 10, 4).first().range_sum
    if count != n or total != sum(range(10)):
        raise RuntimeError(f"smoke check failed: {count}, {total}")
    return count, total
