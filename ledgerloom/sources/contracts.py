"""Fixed values shared by ingest and curation."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns an upload of a known dataset must contain.
REQUIRED_COLUMNS: dict[str, list[str]] = {
    "dim_customers.csv": ["customer_id", "full_name"],
    "dim_accounts.csv": ["account_id", "customer_id"],
    "dim_merchants.csv": ["merchant_id", "merchant_name"],
    "dim_cards.csv": ["card_id", "account_id", "customer_id"],
    "dim_branches.csv": ["branch_id", "branch_name"],
    "dim_date.csv": ["date_key", "full_date"],
    "fact_transactions.csv": ["transaction_id", "account_id", "merchant_id", "amount"],
    "fact_fraud_alerts.csv": ["alert_id", "transaction_id", "account_id"],
    "fact_loans.csv": ["loan_id", "customer_id", "principal_amount"],
    "fact_loan_repayments.csv": ["repayment_id", "loan_id", "amount"],
}

# Columns the curation job reads; wider than the upload contract on purpose, so a
# file that would break the job is refused before it starts.
JOB_COLUMNS: dict[str, list[str]] = {
    "fact_transactions": [
        "transaction_id", "customer_id", "merchant_id", "transaction_date", "status", "amount",
    ],
    "fact_fraud_alerts": ["transaction_id", "alert_status"],
    "fact_loans": ["customer_id", "loan_id"],
    "dim_merchants": ["merchant_id", "merchant_name"],
}

# Datasets behind the readiness gate, and those counted by the overview.
GATED = [
    "dim_accounts.csv", "dim_customers.csv", "dim_merchants.csv",
    "fact_fraud_alerts.csv", "fact_loans.csv", "fact_transactions.csv",
]
KPI_TABLES = [
    "dim_customers.csv", "dim_accounts.csv", "fact_transactions.csv",
    "fact_loans.csv", "fact_fraud_alerts.csv",
]

# Declared types of the curated tables, in column order.
CURATED: dict[str, dict[str, str]] = {
    "kpi_daily_transactions": {
        "transaction_date": "date", "transaction_count": "bigint",
        "total_amount_ugx": "decimal(18,2)", "failed_count": "bigint",
    },
    "kpi_customer_risk": {
        "customer_id": "string", "transaction_count": "bigint",
        "total_amount_ugx": "decimal(18,2)", "fraud_alert_count": "bigint",
        "loan_count": "bigint",
    },
    "kpi_top_merchants": {
        "merchant_id": "string", "transaction_count": "bigint",
        "total_amount_ugx": "decimal(18,2)", "merchant_name": "string",
    },
}

STAGE = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
])
INSIGHTS = T.StructType([
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("row_count", T.LongType()),
    T.StructField("null_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("numeric_summary", T.MapType(T.StringType(), T.StructType([
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("avg", T.DoubleType()),
    ]))),
])
REGISTRY = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("uploaded_at", T.StringType()),
    T.StructField("processed_at", T.StringType()),
    T.StructField("landing_file", T.StringType()),
    T.StructField("pipeline_status", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("stages", T.ArrayType(STAGE)),
    T.StructField("insights", INSIGHTS),
])
AUDIT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("details", T.StringType()),
])
JOB_SUMMARY = T.StructType([
    T.StructField(name, T.LongType()) for name in (
        "successful_datasets", "finance_datasets", "external_datasets", "total_rows_processed")
])
ETL_JOB = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("triggered_by", T.StringType()),
    T.StructField("triggered_at", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("stages", T.ArrayType(T.StringType())),
    T.StructField("summary", JOB_SUMMARY),
])
