"""The three curated KPI tables.

Each is one pass over the transactions with only the columns it needs; amounts are exact
decimals, so sums do not depend on the order of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.numbers import TOTAL, as_money, total
from ledgerloom.operators.joins import preagg_loans, tx_alert_weights


def _day(tx: DataFrame) -> Column:
    day = F.col("transaction_date")
    if isinstance(tx.schema["transaction_date"].dataType, T.StringType):
        return day.try_cast("date")
    return day.cast("date")


def kpi_daily_transactions(tx: DataFrame) -> DataFrame:
    """Count, amount and failures per day."""
    return (
        tx.select(
            _day(tx).alias("transaction_date"), as_money(tx, "amount").alias("amount"), "status"
        )
        .groupBy("transaction_date")
        .agg(
            F.count("*").alias("transaction_count"),
            total(F.col("amount")).alias("total_amount_ugx"),
            F.count_if(F.col("status") == "failed").alias("failed_count"),
        )
    )


def kpi_customer_risk(tx: DataFrame, alerts: DataFrame, loans: DataFrame) -> DataFrame:
    """Per customer: transactions, amount, fraud alerts, loans.

    A transaction counts once per alert it has, as in the left join this stands for.
    """
    narrow = tx.select("transaction_id", "customer_id", as_money(tx, "amount").alias("amount"))
    weighted = tx_alert_weights(narrow, alerts)
    # Only rows with several alerts pay for a decimal product.
    again = F.col("alert_count") - 1
    repeated = F.sum(F.when(again > 0, F.col("amount") * again.cast("decimal(18,0)")))
    per_customer = weighted.groupBy("customer_id").agg(
        F.sum("row_weight").alias("transaction_count"),
        (F.sum("amount") + F.coalesce(repeated, F.lit(0))).cast(TOTAL).alias("total_amount_ugx"),
        F.sum("alert_count").alias("fraud_alert_count"),
    )
    return preagg_loans(per_customer, loans, many=False)


def kpi_customer_risk_dedup(tx: DataFrame, alerts: DataFrame, loans: DataFrame) -> DataFrame:
    """Corrected variant: each transaction row counts once, however many alerts it has."""
    narrow = tx.select("transaction_id", "customer_id", as_money(tx, "amount").alias("amount"))
    flagged = tx_alert_weights(narrow, alerts)
    per_customer = flagged.groupBy("customer_id").agg(
        F.count("*").alias("transaction_count"),
        total(F.col("amount")).alias("total_amount_ugx"),
        F.count("is_fraud").alias("fraud_alert_count"),
    )
    return preagg_loans(per_customer, loans, many=False)


def kpi_top_merchants(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    """Per merchant: transactions and amount, with its name. Duplicate names multiply rows."""
    per_merchant = (
        tx.select("merchant_id", as_money(tx, "amount").alias("amount"))
        .groupBy("merchant_id")
        .agg(F.count("*").alias("transaction_count"), total(F.col("amount")).alias("total_amount_ugx"))
    )
    return per_merchant.join(merchants.select("merchant_id", "merchant_name"), "merchant_id", "left")


def curated_frames(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    tx = inputs["fact_transactions"]
    return {
        "kpi_daily_transactions": kpi_daily_transactions(tx),
        "kpi_customer_risk": kpi_customer_risk(
            tx, inputs["fact_fraud_alerts"], inputs["fact_loans"]
        ),
        "kpi_top_merchants": kpi_top_merchants(tx, inputs["dim_merchants"]),
    }
