"""KPI, count, sum, top-list and histogram queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as agg
from ledgerloom.operators import profile as prof
from ledgerloom.operators import registry as reg
from ledgerloom.plans import dashboard, kpi, validation, warehouse
from ledgerloom.plans.sql_workspace import SqlWorkspace
from ledgerloom.sources.csv_files import scan_csv_raw
from ledgerloom.suite.core import Star, csv_copy, query

TODAY = dt.date(2001, 11, 4)


def risk(s: Star):
    return kpi.kpi_customer_risk(s.fact_transactions, s.fact_fraud_alerts, s.fact_loans)


def daily(s: Star):
    return kpi.kpi_daily_transactions(s.fact_transactions)


def merchants(s: Star):
    return kpi.kpi_top_merchants(s.fact_transactions, s.dim_merchants)


@query("kpi_daily_transactions", sql="SELECT * FROM kpi_daily_transactions ORDER BY transaction_date")
def _(s: Star):
    return daily(s).orderBy("transaction_date")


@query("kpi_customer_risk", sql="SELECT * FROM kpi_customer_risk")
def _(s: Star):
    return risk(s)


@query("kpi_customer_risk_dedup", sql="""
    SELECT t.customer_id, count(*) AS transaction_count,
           CAST(sum(t.amount) AS DECIMAL(38,2)) AS total_amount_ugx,
           count(a.n) AS fraud_alert_count, coalesce(max(l.n), 0) AS loan_count
    FROM fact_transactions t
    LEFT JOIN alert_counts a ON a.transaction_id = t.transaction_id
    LEFT JOIN (SELECT customer_id, count(*) AS n FROM fact_loans GROUP BY customer_id) l
      ON l.customer_id = t.customer_id
    GROUP BY t.customer_id""")
def _(s: Star):
    return kpi.kpi_customer_risk_dedup(s.fact_transactions, s.fact_fraud_alerts, s.fact_loans)


@query("kpi_top_merchants", sql="""
    SELECT * FROM kpi_top_merchants ORDER BY transaction_count DESC, total_amount_ugx DESC, merchant_id""")
def _(s: Star):
    return merchants(s).orderBy(F.desc("transaction_count"), F.desc("total_amount_ugx"), "merchant_id")


@query("count_rows", sql="""
    SELECT count(*) AS row_count FROM fact_transactions""")
def _(s: Star):
    return agg.count_rows(s.fact_transactions)


@query("sum_lenient", sql="""
    SELECT coalesce(CAST(sum(amount) AS DECIMAL(38,2)), 0) AS total FROM fact_transactions""")
def _(s: Star):
    return agg.sum_lenient(s.fact_transactions.withColumn("amount", F.col("amount").cast("string")), "amount")


@query("overview_kpis", sql="""
    SELECT (SELECT count(*) FROM dim_customers) AS customers,
           (SELECT count(*) FROM dim_accounts) AS accounts,
           (SELECT count(*) FROM fact_transactions) AS transactions,
           (SELECT count(*) FROM fact_loans) AS loans,
           (SELECT count(*) FROM fact_fraud_alerts) AS fraud_alerts,
           (SELECT CAST(trunc(sum(amount)) AS BIGINT) FROM fact_transactions) AS transaction_volume_ugx,
           (SELECT CAST(trunc(sum(principal_amount)) AS BIGINT) FROM fact_loans) AS loan_principal_ugx""")
def _(s: Star):
    return agg.overview_kpis(s.frames())


@query("kpi_view_scalar", sql="""
    SELECT (SELECT count(*) FROM dim_customers) AS customers,
           (SELECT count(*) FROM dim_accounts) AS accounts,
           (SELECT count(*) FROM fact_transactions) AS transactions,
           (SELECT count(*) FROM fact_loans) AS loans,
           (SELECT CAST(sum(amount) AS DECIMAL(38,2)) FROM fact_transactions) AS tx_volume_ugx,
           (SELECT CAST(sum(principal_amount) AS DECIMAL(38,2)) FROM fact_loans) AS loan_principal_ugx""")
def _(s: Star):
    space = SqlWorkspace(s.spark)
    own = Star(space.spark, s.folder)
    for name, df in own.frames("dim_customers", "dim_accounts", "fact_transactions", "fact_loans").items():
        space.register(name, df)
    space.create_view("""
        CREATE OR REPLACE VIEW `ledgerloom.analytics.vw_volumes` AS SELECT
          (SELECT CAST(SUM(amount) AS DECIMAL(38,2)) FROM `ledgerloom.analytics.fact_transactions`) AS tx_volume_ugx,
          (SELECT CAST(SUM(principal_amount) AS DECIMAL(38,2)) FROM `ledgerloom.analytics.fact_loans`) AS loan_principal_ugx""")
    space.create_view("""
        CREATE OR REPLACE VIEW `ledgerloom.analytics.vw_dashboard_kpis` AS SELECT
          (SELECT COUNT(*) FROM `ledgerloom.analytics.dim_customers`) AS customers,
          (SELECT COUNT(*) FROM `ledgerloom.analytics.dim_accounts`) AS accounts,
          (SELECT COUNT(*) FROM `ledgerloom.analytics.fact_transactions`) AS transactions,
          (SELECT COUNT(*) FROM `ledgerloom.analytics.fact_loans`) AS loans, tx_volume_ugx, loan_principal_ugx
        FROM vw_volumes""")
    return space.readonly_sql("SELECT * FROM vw_dashboard_kpis")


ENTITY_SQL = """
    SELECT CAST(1 AS INTEGER) AS ord, 'Customers' AS label, CAST(count(*) AS DOUBLE) AS value FROM dim_customers
    UNION ALL SELECT 2, 'Accounts', count(*) FROM dim_accounts
    UNION ALL SELECT 3, 'Txns', count(*) FROM fact_transactions
    UNION ALL SELECT 4, 'Loans', count(*) FROM fact_loans
    UNION ALL SELECT 5, 'Fraud', count(*) FROM fact_fraud_alerts"""


@query("entity_counts", sql=ENTITY_SQL)
def _(s: Star):
    return agg.entity_counts(s.frames())


@query("top_merchants", sql="""
    SELECT t.merchant_id, coalesce(any_value(m.merchant_name), CAST(t.merchant_id AS VARCHAR)) AS merchant_name,
           count(*) AS transaction_count, CAST(sum(CAST(trunc(t.amount) AS BIGINT)) AS BIGINT) AS total_amount_ugx
    FROM fact_transactions t LEFT JOIN dim_merchants m ON m.merchant_id = t.merchant_id
    GROUP BY t.merchant_id ORDER BY 3 DESC, 4 DESC, 1 LIMIT 5""")
def _(s: Star):
    return agg.top_merchants(s.fact_transactions, s.dim_merchants, 5, "merchant_id")


RANKED_MERCHANTS_SQL = """
    SELECT CAST(row_number() OVER (ORDER BY n DESC, amt DESC, merchant_id) AS INTEGER) AS ord,
           substr(name, 1, 22) AS label, n, amt FROM (
      SELECT t.merchant_id, coalesce(any_value(m.merchant_name), CAST(t.merchant_id AS VARCHAR)) AS name,
             count(*) AS n, CAST(sum(CAST(trunc(t.amount) AS BIGINT)) AS BIGINT) AS amt
      FROM fact_transactions t LEFT JOIN dim_merchants m ON m.merchant_id = t.merchant_id
      GROUP BY t.merchant_id) QUALIFY ord <= 8"""


def _merchant_series(s: Star, key: str):
    series = dashboard.counted_series(s.frames(), "merchant_id")
    return series.filter(F.col("key") == key).select(F.col("ord").cast("int").alias("ord"), "label", "value")


@query("merchants_txn", sql=f"SELECT ord, label, CAST(n AS DOUBLE) AS value FROM ({RANKED_MERCHANTS_SQL})")
def _(s: Star):
    return _merchant_series(s, "merchants_txn")


@query("merchants_amt", sql=f"SELECT ord, label, CAST(amt AS DOUBLE) AS value FROM ({RANKED_MERCHANTS_SQL})")
def _(s: Star):
    return _merchant_series(s, "merchants_amt")


def counts_sql(table: str, column: str, k: int) -> str:
    return f"""
    SELECT CAST(row_number() OVER (ORDER BY n DESC, l) AS INTEGER) AS ord, substr(l, 1, 24) AS label,
           CAST(n AS DOUBLE) AS value FROM (
      SELECT coalesce(nullif(trim(CAST({column} AS VARCHAR)), ''), '(empty)') AS l, count(*) AS n
      FROM {table} GROUP BY 1) QUALIFY ord <= {k}"""


def _value_counts(key: str, table: str, column: str, k: int) -> None:
    @query(key, sql=counts_sql(table, column, k))
    def _(s: Star):
        return agg.value_counts(getattr(s, table), column, k)


_value_counts("fraud_by_customer", "fact_fraud_alerts", "customer_id", 8)
_value_counts("customers_region", "dim_customers", "region", 10)
_value_counts("customers_segment", "dim_customers", "customer_segment", 8)
_value_counts("txn_channel", "fact_transactions", "channel", 8)
_value_counts("txn_type", "fact_transactions", "transaction_type", 8)
_value_counts("loan_status", "fact_loans", "loan_status", 8)


@query("value_counts", sql=counts_sql("documents", "source", 10))
def _(s: Star):
    return agg.value_counts(s.table("documents"), "source", 10)


def histogram_sql(table: str, column: str, bins: int = 5) -> str:
    return f"""
    SELECT CAST(i + 1 AS INTEGER) AS ord,
           CASE WHEN lo = hi THEN CAST(CAST(trunc(lo) AS BIGINT) AS VARCHAR)
                ELSE concat(CAST(CAST(round_even(lo + i * step, 0) AS BIGINT) AS VARCHAR), '-',
                            CAST(CAST(round_even(lo + (i + 1) * step, 0) AS BIGINT) AS VARCHAR)) END AS label,
           CAST(coalesce(n, 0) AS DOUBLE) AS value
    FROM (SELECT lo, hi, (hi - lo) / {bins} AS step FROM (
            SELECT min(CAST({column} AS DOUBLE)) AS lo, max(CAST({column} AS DOUBLE)) AS hi FROM {table})) b
    JOIN (SELECT unnest(range(0, {bins})) AS i) r ON b.lo < b.hi OR i = 0
    LEFT JOIN (
      SELECT CASE WHEN step > 0 THEN least({bins - 1}, CAST(floor((v - lo) / step) AS BIGINT)) ELSE 0 END AS bin,
             count(*) AS n
      FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {table}) x,
           (SELECT lo, (hi - lo) / {bins} AS step FROM (
              SELECT min(CAST({column} AS DOUBLE)) AS lo, max(CAST({column} AS DOUBLE)) AS hi FROM {table})) y
      GROUP BY 1) c ON c.bin = r.i"""


@query("histogram", sql=histogram_sql("events", "value", 12))
def _(s: Star):
    return agg.histogram(s.table("events"), "value", 12)


@query("txn_amount_bins", sql=histogram_sql("fact_transactions", "amount"))
def _(s: Star):
    return agg.histogram(s.fact_transactions, "amount", 5)


@query("loan_principal_bins", sql=histogram_sql("fact_loans", "principal_amount"))
def _(s: Star):
    return agg.histogram(s.fact_loans, "principal_amount", 5)


DAYS_SQL = """
    SELECT label, value FROM (
      SELECT CAST(CAST(uploaded_at AS DATE) AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS value
      FROM dataset_registry GROUP BY 1 ORDER BY 1 DESC LIMIT 14) ORDER BY label"""
MIX_SQL = """
    SELECT coalesce(nullif(pipeline_status, ''), 'unknown') AS label, CAST(count(*) AS DOUBLE) AS value
    FROM dataset_registry GROUP BY 1"""


@query("uploads_by_day", sql=DAYS_SQL)
def _(s: Star):
    return reg.uploads_by_day(s.registry, 14)


@query("status_mix", sql=MIX_SQL)
def _(s: Star):
    return reg.status_mix(s.registry)


@query("delegate_summary", sql="""
    SELECT count(*) AS successful_datasets,
           count(*) FILTER (WHERE classification = 'finance') AS finance_datasets,
           count(*) FILTER (WHERE classification = 'external') AS external_datasets,
           CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows_processed
    FROM dataset_registry WHERE status = 'success'""")
def _(s: Star):
    return reg.delegate_summary(s.registry)


# Profiles: of a raw CSV copy (all text), and of a typed frame with nulls.
LOAN_COLUMNS = ["loan_id", "customer_id", "principal_amount", "loan_status", "issue_date"]


@query("profile_nulls", sql="""
""" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE coalesce(CAST({c} AS VARCHAR), '') = '') AS null_count FROM dataset_registry"""
        for c in ("seq", "dataset", "classification", "uploaded_at", "pipeline_status", "status", "row_count")))
def _(s: Star):
    return prof.profile_nulls(s.registry)


def _range_sql(column: str) -> str:
    return (f"SELECT '{column}' AS \"column\", round(min(CAST({column} AS DOUBLE)), 4) AS min, "
            f"round(max(CAST({column} AS DOUBLE)), 4) AS max, "
            f"round(sum(CAST({column} AS DOUBLE)) / count({column}), 4) AS avg FROM fact_loans")


@query("profile_numeric", sql=" UNION ALL ".join(
    _range_sql(c) for c in ("loan_id", "customer_id", "principal_amount")))
def _(s: Star):
    return prof.profile_numeric(scan_csv_raw(s.spark, csv_copy(s, s.fact_loans, "fact_loans")))


@query("profile_insights", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", n.row_count, CAST(0 AS BIGINT) AS null_count, r.min, r.max, r.avg "
    f"FROM (SELECT count(*) AS row_count FROM fact_loans) n "
    f"LEFT JOIN ({_range_sql(c) if i < 3 else 'SELECT 0.0 AS min, 0.0 AS max, 0.0 AS avg LIMIT 0'}) r ON true"
    for i, c in enumerate(LOAN_COLUMNS)))
def _(s: Star):
    record = prof.profile_insights(scan_csv_raw(s.spark, csv_copy(s, s.fact_loans, "fact_loans")))
    each = record.select("*", F.explode("columns").alias("column"))
    numbers = F.try_element_at("numeric_summary", F.col("column"))
    return each.select(
        "column", "row_count", F.element_at("null_counts", F.col("column")).alias("null_count"),
        numbers["min"].alias("min"), numbers["max"].alias("max"), numbers["avg"].alias("avg"),
    )


@query("table_counts_union", "union_all", sql="""
    SELECT 'dim_customers' AS table_name, count(*) AS row_count FROM dim_customers
    UNION ALL SELECT 'dim_accounts', count(*) FROM dim_accounts
    UNION ALL SELECT 'dim_merchants', count(*) FROM dim_merchants
    UNION ALL SELECT 'fact_transactions', count(*) FROM fact_transactions
    UNION ALL SELECT 'fact_loans', count(*) FROM fact_loans""")
def _(s: Star):
    return agg.table_counts(s.frames(
        "dim_customers", "dim_accounts", "dim_merchants", "fact_transactions", "fact_loans"))


@query("loan_totals", sql="""
    SELECT count(*) AS loans, CAST(sum(principal_amount) AS DECIMAL(38,2)) AS total_principal_ugx FROM fact_loans""")
def _(s: Star):
    return warehouse.loan_totals(s.fact_loans)


@query("branches_by_region", sql="""
    SELECT region, count(*) AS branches FROM dim_branches GROUP BY region ORDER BY branches DESC, region""")
def _(s: Star):
    return warehouse.branches_by_region(s.dim_branches)


@query("daily_volume", sql="""
    SELECT transaction_date AS tx_date, count(*) AS tx_count,
           CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount_ugx
    FROM fact_transactions WHERE transaction_date >= DATE '2001-11-04' - INTERVAL 30 DAY
    GROUP BY 1 ORDER BY 1 DESC""")
def _(s: Star):
    return warehouse.daily_volume(s.fact_transactions, TODAY)


@query("top_merchants_by_count", sql="""
    SELECT merchant_name, CAST(sum(transaction_count) AS BIGINT) AS tx_count FROM kpi_top_merchants
    GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20""")
def _(s: Star):
    return warehouse.top_merchants_by_count(s.fact_transactions, s.dim_merchants)


@query("top_merchants_by_amount", sql="""
    SELECT merchant_name, CAST(sum(total_amount_ugx) AS DECIMAL(38,2)) AS total_amount_ugx FROM kpi_top_merchants
    GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20""")
def _(s: Star):
    return warehouse.top_merchants_by_amount(s.fact_transactions, s.dim_merchants)


@query("tx_by_channel", sql="""
    SELECT channel, count(*) AS tx_count, CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount_ugx
    FROM fact_transactions GROUP BY channel ORDER BY tx_count DESC, channel""")
def _(s: Star):
    return warehouse.tx_by_channel(s.fact_transactions)


@query("fraud_rate_by_channel", sql="""
    SELECT t.channel, count(*) AS total_tx, count(a.n) AS fraud_tx,
           CAST(count(a.n) AS DOUBLE) / count(*) AS fraud_rate
    FROM fact_transactions t LEFT JOIN alert_counts a ON a.transaction_id = t.transaction_id
    GROUP BY t.channel ORDER BY fraud_rate DESC, channel""")
def _(s: Star):
    return warehouse.fraud_rate_by_channel(s.fact_transactions, s.fact_fraud_alerts)


@query("loan_portfolio_by_status", sql="""
    SELECT loan_status, count(*) AS loan_count,
           CAST(sum(principal_amount) AS DECIMAL(38,2)) AS total_principal_ugx,
           CAST(sum(principal_amount) AS DOUBLE) / count(principal_amount) AS avg_principal_ugx
    FROM fact_loans GROUP BY 1 ORDER BY 2 DESC, 1""")
def _(s: Star):
    return warehouse.loan_portfolio_by_status(s.fact_loans)


@query("customers_by_region", sql="""
    SELECT region, count(*) AS customer_count FROM dim_customers GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(s: Star):
    return warehouse.customers_by_region(s.dim_customers)


@query("group_sum_by_year", sql="""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
    FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 ORDER BY 1 DESC LIMIT 15""")
def _(s: Star):
    urgent = s.table("orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return warehouse.group_sum_by_year(urgent, "o_orderdate", "o_totalprice")


@query("group_count_by_corpus", sql="""
    SELECT source, count(*) AS row_count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(s: Star):
    return warehouse.group_count_top(s.table("documents"), "source")


@query("daily_totals", sql="""
    SELECT count(*) AS daily_rows, CAST(sum(transaction_count) AS BIGINT) AS total_transactions,
           CAST(sum(total_amount_ugx) AS DECIMAL(38,2)) AS total_amount_ugx FROM kpi_daily_transactions""")
def _(s: Star):
    return validation.daily_totals(daily(s))


@query("risk_sanity", sql="""
    SELECT count(*) AS customer_rows, CAST(sum(fraud_alert_count) AS BIGINT) AS fraud_alert_total,
           CAST(sum(loan_count) AS BIGINT) AS loan_total FROM kpi_customer_risk""")
def _(s: Star):
    return validation.risk_sanity(risk(s))


@query("merchant_min_max", sql="""
    SELECT count(*) AS merchant_rows, min(transaction_count) AS min_txn, max(transaction_count) AS max_txn
    FROM kpi_top_merchants""")
def _(s: Star):
    return validation.merchant_min_max(merchants(s))


def _charts_sql() -> str:
    def part(key: str, sql: str) -> str:
        return f"SELECT '{key}' AS key, ord, label, value FROM ({sql})"

    def number(sql: str) -> str:
        return f"SELECT CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS ord, label, value FROM ({sql})"

    series = {
        "merchants_txn": f"SELECT ord, label, CAST(n AS DOUBLE) AS value FROM ({RANKED_MERCHANTS_SQL})",
        "merchants_amt": f"SELECT ord, label, CAST(amt AS DOUBLE) AS value FROM ({RANKED_MERCHANTS_SQL})",
        "txn_amount_bins": histogram_sql("fact_transactions", "amount"),
        "loan_principal_bins": histogram_sql("fact_loans", "principal_amount"),
        "fraud_by_customer": counts_sql("fact_fraud_alerts", "customer_id", 8),
        "entity_counts": ENTITY_SQL,
        "uploads_by_day": number(DAYS_SQL),
        "pipeline_status": number(MIX_SQL),
        "customers_region": counts_sql("dim_customers", "region", 10),
        "customers_segment": counts_sql("dim_customers", "customer_segment", 8),
        "txn_channel": counts_sql("fact_transactions", "channel", 8),
        "txn_type": counts_sql("fact_transactions", "transaction_type", 8),
        "loan_status": counts_sql("fact_loans", "loan_status", 8),
    }
    return "\nUNION ALL ".join(part(k, q) for k, q in series.items())


@query("dashboard_charts", sql=_charts_sql())
def _(s: Star):
    return dashboard.dashboard_charts(s.frames(), s.registry, "merchant_id").drop("title")
