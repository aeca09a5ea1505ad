"""Documented warehouse reports over the star schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import as_money, total
from ledgerloom.operators.joins import tx_alert_weights
from ledgerloom.operators.predicates import date_range


def daily_volume(tx: DataFrame, today: dt.date, days: int = 30) -> DataFrame:
    """Count and amount per day over the last ``days`` days, newest first."""
    recent = date_range(tx.withColumn("tx_date", F.col("transaction_date").cast("date")),
                        "tx_date", today, days)
    return (
        recent.groupBy("tx_date")
        .agg(F.count("*").alias("tx_count"), total(as_money(tx, "amount")).alias("total_amount_ugx"))
        .orderBy(F.desc("tx_date"))
    )


def _named_totals(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    """Totals per merchant name; transactions merge per id before the names are joined."""
    per_id = tx.groupBy("merchant_id").agg(
        F.count("*").alias("n"), total(as_money(tx, "amount")).alias("s")
    )
    return (
        per_id.join(merchants.select("merchant_id", "merchant_name"), "merchant_id", "left")
        .groupBy("merchant_name")
        .agg(F.sum("n").alias("tx_count"), F.sum("s").cast("decimal(38,2)").alias("total_amount_ugx"))
    )


def top_merchants_by_count(tx: DataFrame, merchants: DataFrame, k: int = 20) -> DataFrame:
    return (
        _named_totals(tx, merchants).select("merchant_name", "tx_count")
        .orderBy(F.desc("tx_count"), F.asc_nulls_first("merchant_name")).limit(k)
    )


def top_merchants_by_amount(tx: DataFrame, merchants: DataFrame, k: int = 20) -> DataFrame:
    return (
        _named_totals(tx, merchants).select("merchant_name", "total_amount_ugx")
        .orderBy(F.desc("total_amount_ugx"), F.asc_nulls_first("merchant_name")).limit(k)
    )


def tx_by_channel(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy("channel")
        .agg(F.count("*").alias("tx_count"), total(as_money(tx, "amount")).alias("total_amount_ugx"))
        .orderBy(F.desc("tx_count"), "channel")
    )


def fraud_rate_by_channel(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """Transactions, alerted transactions and their ratio per channel."""
    flagged = tx_alert_weights(tx.select("transaction_id", "channel"), alerts)
    return (
        flagged.groupBy("channel")
        .agg(F.count("*").alias("total_tx"), F.count("is_fraud").alias("fraud_tx"))
        .withColumn("fraud_rate", F.try_divide(F.col("fraud_tx"), F.col("total_tx")))
        .orderBy(F.desc("fraud_rate"), "channel")
    )


def loan_totals(loans: DataFrame) -> DataFrame:
    return loans.agg(
        F.count("*").alias("loans"),
        total(as_money(loans, "principal_amount")).alias("total_principal_ugx"),
    )


def loan_portfolio_by_status(loans: DataFrame) -> DataFrame:
    """Count, sum and mean per status; the mean is the exact sum over the parseable count."""
    amount = as_money(loans, "principal_amount")
    return (
        loans.groupBy("loan_status")
        .agg(F.count("*").alias("loan_count"), total(amount).alias("total_principal_ugx"),
             F.count(amount).alias("_n"))
        .withColumn("avg_principal_ugx",
                    F.try_divide(F.col("total_principal_ugx").cast("double"), F.col("_n")))
        .drop("_n").orderBy(F.desc("loan_count"), "loan_status")
    )


def customers_by_region(customers: DataFrame, k: int = 20) -> DataFrame:
    return (
        customers.groupBy("region").agg(F.count("*").alias("customer_count"))
        .orderBy(F.desc("customer_count"), "region").limit(k)
    )


def branches_by_region(branches: DataFrame) -> DataFrame:
    return (
        branches.groupBy("region").agg(F.count("*").alias("branches"))
        .orderBy(F.desc("branches"), "region")
    )


def group_sum_by_year(df: DataFrame, date: str, value: str, k: int = 15) -> DataFrame:
    """Sum per calendar year, latest years first."""
    return (
        df.groupBy(F.year(date).alias("year")).agg(total(as_money(df, value)).alias("total"))
        .orderBy(F.desc("year")).limit(k)
    )


def group_count_top(df: DataFrame, group: str, k: int = 10) -> DataFrame:
    """Rows per category, largest first."""
    return (
        df.groupBy(group).agg(F.count("*").alias("row_count"))
        .orderBy(F.desc("row_count"), group).limit(k)
    )
