"""Validation queries over the curated KPI tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.count("*").alias("daily_rows"),
        F.sum("transaction_count").alias("total_transactions"),
        F.sum("total_amount_ugx").cast("decimal(38,2)").alias("total_amount_ugx"),
    )


def top_merchants_curated(merchants: DataFrame) -> DataFrame:
    return (
        merchants.select("merchant_id", "merchant_name", "transaction_count", "total_amount_ugx")
        .orderBy(F.desc("transaction_count"), F.desc("total_amount_ugx"), "merchant_id").limit(10)
    )


def risk_sanity(risk: DataFrame) -> DataFrame:
    return risk.agg(
        F.count("*").alias("customer_rows"),
        F.sum("fraud_alert_count").alias("fraud_alert_total"),
        F.sum("loan_count").alias("loan_total"),
    )


def daily_trend(daily: DataFrame, days: int = 14) -> DataFrame:
    return (
        daily.select("transaction_date", "transaction_count", "total_amount_ugx", "failed_count")
        .orderBy(F.desc("transaction_date")).limit(days)
    )


def risk_outliers(risk: DataFrame, k: int = 25) -> DataFrame:
    return (
        risk.filter((F.col("fraud_alert_count") > 0) & (F.col("loan_count") > 0))
        .select("customer_id", "fraud_alert_count", "loan_count", "transaction_count")
        .orderBy(F.desc("fraud_alert_count"), F.desc("loan_count"), "customer_id").limit(k)
    )


def dq_bad_daily(daily: DataFrame) -> DataFrame:
    """Rows a healthy daily table does not have."""
    count, amount = F.col("transaction_count"), F.col("total_amount_ugx")
    return daily.filter(count.isNull() | amount.isNull() | ((count == 0) & (amount > 0)))


def merchant_min_max(merchants: DataFrame) -> DataFrame:
    return merchants.agg(
        F.count("*").alias("merchant_rows"),
        F.min("transaction_count").alias("min_txn"),
        F.max("transaction_count").alias("max_txn"),
    )
