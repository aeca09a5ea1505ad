"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.text import WHITESPACE
from ledgerloom.session import shared_folder
from ledgerloom.sources.csv_files import write_csv
from ledgerloom.sources.star import Star

# The star schema over the driver tables in SQL (FIXTURES.md, section 3).
STAR_SQL = {
    "fact_transactions": """
      SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS transaction_id,
             o.o_orderkey AS account_id, o.o_custkey AS customer_id, l.l_suppkey AS merchant_id,
             CAST(l.l_shipdate AS DATE) AS transaction_date,
             CASE WHEN l.l_linestatus = 'F' THEN 'failed' ELSE 'completed' END AS status,
             o.o_orderpriority AS channel, l.l_returnflag AS transaction_type,
             CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "fact_fraud_alerts": """
      SELECT event_id AS alert_id,
             CAST((event_id - event_id % 4) * 10 + 1 + (event_id - event_id % 4) % 7 AS BIGINT)
               AS transaction_id,
             user_id AS customer_id, event_type AS alert_status, CAST(ts AS DATE) AS alert_date
      FROM events WHERE event_type = 'error'""",
    "fact_loans": """
      SELECT o_orderkey AS loan_id, o_custkey AS customer_id,
             CAST(o_totalprice AS DECIMAL(18,2)) AS principal_amount, o_orderstatus AS loan_status,
             CAST(o_orderdate AS DATE) AS issue_date FROM orders""",
    "dim_customers": """
      SELECT c_custkey AS customer_id, c_name AS full_name, r_name AS region,
             c_mktsegment AS customer_segment
      FROM customer JOIN nation ON n_nationkey = c_nationkey
      JOIN region ON r_regionkey = n_regionkey""",
    "dim_accounts": """
      SELECT o_orderkey AS account_id, o_custkey AS customer_id,
             CAST(o_totalprice AS DECIMAL(18,2)) AS current_balance
      FROM orders WHERE o_orderstatus = 'O'""",
    "dim_merchants": """
      SELECT s_suppkey AS merchant_id, s_name AS merchant_name, n_name AS district
      FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 <> 3""",
    "dim_branches": """
      SELECT n_nationkey AS branch_id, n_name AS branch_name, r_name AS region
      FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "dataset_registry": """
      SELECT event_id AS seq, concat('ds_', CAST(user_id AS VARCHAR)) AS dataset,
             CASE WHEN user_id % 2 = 0 THEN 'finance' ELSE 'external' END AS classification,
             ts AS uploaded_at,
             CASE event_type WHEN 'signup' THEN 'landed' WHEN 'purchase' THEN 'analytics_ready'
                             WHEN 'error' THEN 'failed' ELSE NULL END AS pipeline_status,
             CASE event_type WHEN 'signup' THEN 'landed' WHEN 'error' THEN 'failed'
                             ELSE 'success' END AS status,
             CAST(floor(value) AS BIGINT) AS row_count
      FROM events""",
    # Curated tables over the ones above.
    "alert_counts": """
      SELECT transaction_id, count(*) AS n FROM fact_fraud_alerts GROUP BY transaction_id""",
    "kpi_daily_transactions": """
      SELECT transaction_date, count(*) AS transaction_count,
             CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount_ugx,
             CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed_count
      FROM fact_transactions GROUP BY transaction_date""",
    "kpi_customer_risk": """
      SELECT r.*, coalesce(l.n, 0) AS loan_count FROM (
        SELECT t.customer_id, count(*) AS transaction_count,
               CAST(sum(t.amount) AS DECIMAL(38,2)) AS total_amount_ugx,
               count(f.alert_id) AS fraud_alert_count
        FROM fact_transactions t LEFT JOIN fact_fraud_alerts f ON f.transaction_id = t.transaction_id
        GROUP BY t.customer_id) r
      LEFT JOIN (SELECT customer_id, count(*) AS n FROM fact_loans GROUP BY customer_id) l
        ON l.customer_id = r.customer_id""",
    "kpi_top_merchants": """
      SELECT a.merchant_id, a.transaction_count, a.total_amount_ugx, m.merchant_name FROM (
        SELECT merchant_id, count(*) AS transaction_count,
               CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount_ugx
        FROM fact_transactions GROUP BY merchant_id) a
      LEFT JOIN dim_merchants m ON m.merchant_id = a.merchant_id""",
}
_NEEDS = {
    "alert_counts": ["fact_fraud_alerts"],
    "kpi_daily_transactions": ["fact_transactions"],
    "kpi_customer_risk": ["fact_transactions", "fact_fraud_alerts", "fact_loans"],
    "kpi_top_merchants": ["fact_transactions", "dim_merchants"],
}

# SQL literal of the characters Python's str.strip() removes.
SQL_WHITESPACE = f"'{WHITESPACE}'"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def with_star(sql: str) -> str:
    """Prefix the star-schema tables a statement names."""
    import re

    used = {t for t in STAR_SQL if re.search(rf"\b{t}\b", sql)}
    for table in list(used):
        used.update(_NEEDS.get(table, []))
    ctes = [f"{t} AS ({STAR_SQL[t]})" for t in STAR_SQL if t in used]
    if not ctes:
        return sql
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(*names: str, sql: str | None):
    """Register a builder ``f(star) -> DataFrame`` under one or more names."""
    def register(build: Callable[[Star], DataFrame]):
        for name in names:
            QUERIES[name] = Query(
                name,
                lambda spark, folder, build=build: build(Star(spark, folder)),
                with_star(sql) if sql else None,
            )
        return build

    return register


def csv_copy(star: Star, df: DataFrame, name: str, folder: str | None = None) -> str:
    """Write a whole frame as CSV into the shared folder and return its path."""
    path = f"{folder or shared_folder(star.spark, 'csv')}/{name}.csv"
    write_csv(df, path)
    return path
