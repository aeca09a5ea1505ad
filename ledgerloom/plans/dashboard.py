"""The dashboard's thirteen chart series as one long frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import whole_amount
from ledgerloom.functions.text import cut
from ledgerloom.operators.aggregates import (
    ENTITIES, LABEL_WIDTH, best_labels, histogram, label_parts, named_merchants,
)
from ledgerloom.operators.registry import status_mix, uploads_by_day
from ledgerloom.session import literal_rows

# Series keys and titles, in display order.
TITLES = {
    "merchants_txn": "Top merchants — transaction count",
    "merchants_amt": "Top merchants — amount (UGX)",
    "txn_amount_bins": "Transaction amounts (bins)",
    "loan_principal_bins": "Loan principal (bins)",
    "fraud_by_customer": "Fraud alerts by customer (top)",
    "entity_counts": "Entity row counts",
    "uploads_by_day": "Catalog uploads by day (UTC)",
    "pipeline_status": "Catalog by pipeline status",
    "customers_region": "Customers by region (top)",
    "customers_segment": "Customers by segment",
    "txn_channel": "Transactions by channel",
    "txn_type": "Transactions by type",
    "loan_status": "Loans by status",
}
TOP = 8
DAYS = 14
MERCHANT_LABEL_WIDTH = 22


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Chart rows of an already small (label, value) frame, in label order."""
    return df.select(
        F.lit(key).alias("key"), F.row_number().over(Window.orderBy("label")).alias("ord"),
        "label", "value",
    )


# How many labels each counted series shows.
LIMITS = {
    "merchants": TOP, "txn_channel": 8, "txn_type": 8, "loan_status": 8, "fraud_by_customer": 8,
    "customers_region": 10, "customers_segment": 8, "entity_counts": len(ENTITIES),
}


def counted_series(frames: dict[str, DataFrame | None], seq: str | None = None) -> DataFrame:
    """All counted series (key, ord, label, value): one pass per table, one ranking over their few distinct labels."""
    tx = frames["fact_transactions"]
    columns = {
        "fact_transactions": {"merchants": "merchant_id", "txn_channel": "channel", "txn_type": "transaction_type"},
        "fact_loans": {"loan_status": "loan_status"},
        "fact_fraud_alerts": {"fraud_by_customer": "customer_id"},
        "dim_customers": {"customers_region": "region", "customers_segment": "customer_segment"},
        "dim_accounts": {},
    }
    merchants = frames.get("dim_merchants")
    if merchants is None:
        merchants = literal_rows(tx.sparkSession, [("", "")], "merchant_id, merchant_name")
        del columns["fact_transactions"]["merchants"]
    amount = whole_amount(tx, "amount")
    parts = None
    for entity, table in ENTITIES:
        df = frames[table]
        present = {kind: c for kind, c in columns[table].items() if c in df.columns}
        part = label_parts(df, present, amount if df is tx else None, ("entity_counts", entity), ids=("merchants",))
        parts = part if parts is None else parts.unionByName(part)
    merchant = F.col("kind") == "merchants"
    best = best_labels(
        parts.filter(~merchant | (F.col("label") != "(empty)")), LIMITS, by_amount="merchants"
    )
    id_type = tx.schema["merchant_id"].dataType
    ids = F.when(merchant, F.col("label").try_cast(id_type))
    rows = named_merchants(best.withColumn("merchant_id", ids), merchants, seq)
    place = F.coalesce(*[F.when(F.col("label") == e, i) for i, (e, _) in enumerate(ENTITIES, 1)])
    points = F.when(merchant, F.array(
        F.struct(F.lit("merchants_txn").alias("key"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("merchants_amt").alias("key"), F.col("amt").cast("double").alias("value")),
    )).otherwise(F.array(
        F.struct(F.col("kind").alias("key"), F.col("n").cast("double").alias("value")),
    ))
    return rows.select(
        F.when(F.col("kind") == "entity_counts", place).otherwise(F.col("ord")).alias("ord"),
        F.when(merchant, cut(F.col("merchant_name"), MERCHANT_LABEL_WIDTH))
        .otherwise(cut(F.col("label"), LABEL_WIDTH)).alias("label"),
        F.inline(points),
    ).select("key", "ord", "label", "value")


def dashboard_charts(
    frames: dict[str, DataFrame | None], registry: DataFrame, seq: str | None = None
) -> DataFrame:
    """(key, title, ord, label, value); a series without rows shows one ``—`` of 0.

    Each star table is scanned once for all its counts. The two histograms add a min/max
    pass and a binning pass over a single column.
    """
    def bins(table: str, column: str, key: str) -> DataFrame:
        return histogram(frames[table], column, 5).withColumn("key", F.lit(key))

    blanks = [(k, 0, "—", 0.0) for k in TITLES if not k.startswith("merchants_")]
    blanks += [("entity_counts", i, label, 0.0) for i, (label, _) in enumerate(ENTITIES, 1)]
    rows = literal_rows(registry.sparkSession, blanks, "key, ord, label, value")
    for part in (
        counted_series(frames, seq),
        bins("fact_transactions", "amount", "txn_amount_bins"),
        bins("fact_loans", "principal_amount", "loan_principal_bins"),
        _numbered(uploads_by_day(registry, DAYS), "uploads_by_day"),
        _numbered(status_mix(registry), "pipeline_status"),
    ):
        rows = rows.unionByName(part.withColumn("ord", F.col("ord").cast("int")))
    # A few dozen rows per key from here on. A table without rows keeps its blank bar.
    merged = rows.groupBy("key", "ord", "label").agg(F.max("value").alias("value"))
    last = F.max("ord").over(Window.partitionBy("key"))
    title = F.coalesce(*[F.when(F.col("key") == k, t) for k, t in TITLES.items()])
    return (
        merged.withColumn("_last", last).filter((F.col("ord") > 0) | (F.col("_last") == 0))
        .select("key", title.alias("title"), F.greatest("ord", F.lit(1)).alias("ord"), "label", "value")
    )
