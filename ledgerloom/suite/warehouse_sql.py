"""Queries in the warehouse's spelling, through the SQL workspace."""

from __future__ import annotations

from ledgerloom.plans.sql_workspace import SqlWorkspace
from ledgerloom.suite.core import Star, query

PROJECT, DATASET = "loom-project-1", "ledger"
TABLES = ("dim_customers", "dim_accounts", "fact_transactions", "fact_fraud_alerts", "fact_loans")


def warehouse(s: Star, *names: str) -> SqlWorkspace:
    """A workspace that knows its tables by the warehouse's names, and the corpus in a dataset of its own."""
    space = SqlWorkspace(s.spark, PROJECT, DATASET)
    own = Star(space.spark, s.folder)
    for name in names or TABLES:
        space.register(name, getattr(own, name))
    space.register("texts", own.table("documents"), "samples")
    return space


def of(table: str, dataset: str = DATASET) -> str:
    return f"`{PROJECT}.{dataset}.{table}`"


@query("warehouse_counts", sql=" UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n FROM {t}" for t in TABLES))
def _(s: Star):
    return warehouse(s).readonly_sql_capped(" UNION ALL ".join(f"SELECT '{t}' AS source, COUNT(*) AS n FROM {of(t)}" for t in TABLES))


@query("warehouse_recent_days", sql="""
    SELECT transaction_date AS day, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS moved, date_trunc('month', transaction_date)::DATE AS month,
           CAST(date_diff('day', transaction_date, DATE '1998-09-01') AS INTEGER) AS age
    FROM fact_transactions WHERE transaction_date >= DATE '1998-09-01' - 30 AND transaction_date < DATE '1999-09-01' GROUP BY 1, 4, 5""")
def _(s: Star):
    return warehouse(s).readonly_sql_capped(f"""
        SELECT DATE(transaction_date) AS day, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(38,2)) AS moved,
               DATE_TRUNC(DATE(transaction_date), MONTH) AS month, DATE_DIFF(DATE '1998-09-01', DATE(transaction_date), DAY) AS age
        FROM {of('fact_transactions')}
        WHERE DATE(transaction_date) >= DATE_SUB(DATE_ADD(DATE '1998-08-31', INTERVAL 1 DAY), INTERVAL 30 DAY)
          AND DATE(transaction_date) < DATE_ADD(DATE '1998-09-01', INTERVAL 1 YEAR)
        GROUP BY day, month, age ORDER BY day DESC""", 500)


@query("warehouse_fraud_rate", sql="""
    SELECT channel, count(*) AS total, count(*) FILTER (WHERE a.transaction_id IS NOT NULL) AS alerted,
           count(*) FILTER (WHERE a.transaction_id IS NOT NULL) / nullif(count(*), 0) AS rate,
           count(*) FILTER (WHERE status = 'failed') AS failed, CAST(NULL AS DOUBLE) AS undefined
    FROM fact_transactions t LEFT JOIN (SELECT DISTINCT transaction_id FROM fact_fraud_alerts) a USING (transaction_id) GROUP BY channel""")
def _(s: Star):
    return warehouse(s).readonly_sql_capped(f"""
        SELECT channel, COUNT(*) AS total, SUM(CASE WHEN hit = TRUE THEN 1 ELSE 0 END) AS alerted,
               SAFE_DIVIDE(SUM(CASE WHEN hit = TRUE THEN 1 ELSE 0 END), COUNT(*)) AS rate,
               COUNTIF(status = 'failed') AS failed, SAFE_DIVIDE(COUNT(*), SAFE_DIVIDE(0, COUNT(*))) AS undefined
        FROM (SELECT t.channel, t.status, a.transaction_id IS NOT NULL AS hit FROM {of('fact_transactions')} AS t
              LEFT JOIN (SELECT DISTINCT transaction_id FROM {of('fact_fraud_alerts')}) AS a USING (transaction_id))
        GROUP BY channel ORDER BY rate DESC""")


@query("warehouse_high_value", sql="""
    WITH spent AS (SELECT customer_id, sum(amount) AS moved FROM fact_transactions GROUP BY 1),
         lent AS (SELECT customer_id, sum(principal_amount) AS owed FROM fact_loans GROUP BY 1)
    SELECT c.customer_id, c.region, CAST(coalesce(moved, 0) AS DECIMAL(38,2)) AS moved, CAST(coalesce(owed, 0) AS DECIMAL(38,2)) AS owed
    FROM dim_customers c LEFT JOIN spent USING (customer_id) LEFT JOIN lent USING (customer_id)
    ORDER BY 3 DESC, 4 DESC, 1 LIMIT 50""")
def _(s: Star):
    return warehouse(s).readonly_sql_capped(f"""
        WITH spent AS (SELECT customer_id, SUM(amount) AS moved FROM {of('fact_transactions')} GROUP BY customer_id),
             lent AS (SELECT customer_id, SUM(principal_amount) AS owed FROM {DATASET}.fact_loans GROUP BY customer_id)
        SELECT dim_customers.customer_id, dim_customers.region, CAST(IFNULL(spent.moved, 0) AS DECIMAL(38,2)) AS moved,
               SAFE_CAST(IFNULL(lent.owed, 0) AS DECIMAL(38,2)) AS owed
        FROM {of('dim_customers')} LEFT JOIN spent USING (customer_id) LEFT JOIN lent USING (customer_id)
        ORDER BY moved DESC, owed DESC, customer_id LIMIT 50""")


@query("warehouse_samples", sql="""
    SELECT source, count(*) AS texts, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lower(lang) LIKE 'e%' GROUP BY source""")
def _(s: Star):
    return warehouse(s).readonly_sql_capped(f"""
        SELECT texts.source, COUNT(*) AS texts, SUM(n_chars) AS chars FROM {of('texts', 'samples')}
        WHERE LOWER(lang) LIKE 'e%' GROUP BY texts.source""")


@query("warehouse_listing", sql=" UNION ALL ".join([
    *[f"SELECT '{t}' AS table_name, 'BASE TABLE' AS table_type, '{PROJECT}' AS project, true AS now, n FROM (SELECT count(*) AS n FROM {t})" for t in TABLES],
    f"SELECT 'lenders', 'VIEW', '{PROJECT}', true, n FROM (SELECT count(DISTINCT customer_id) AS n FROM fact_loans)"]))
def _(s: Star):
    space = warehouse(s)
    space.create_view(f"CREATE VIEW {of('lenders')} AS SELECT DISTINCT customer_id FROM {of('fact_loans')}")
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {of(t)}" for t in (*TABLES, "lenders"))
    return space.readonly_sql_capped(f"""
        SELECT table_name, table_type, @@project_id AS project, CURRENT_TIMESTAMP() > TIMESTAMP '2024-01-01 00:00:00' AS now, n
        FROM `{PROJECT}.{DATASET}.INFORMATION_SCHEMA.TABLES` JOIN ({counts}) USING (table_name)
        WHERE table_schema = '{DATASET}' ORDER BY table_name""")
