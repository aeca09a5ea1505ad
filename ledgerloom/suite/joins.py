"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.text import label_or
from ledgerloom.operators import joins
from ledgerloom.operators import registry as reg
from ledgerloom.plans.sql_workspace import SqlWorkspace
from ledgerloom.suite.aggregates import merchants
from ledgerloom.suite.core import Star, query


@query("join_merchant_lookup", sql="""
    SELECT t.transaction_id, t.merchant_id, t.amount,
           coalesce(m.merchant_name, CAST(t.merchant_id AS VARCHAR)) AS merchant_name
    FROM fact_transactions t LEFT JOIN dim_merchants m ON m.merchant_id = t.merchant_id""")
def _(s: Star):
    tx = s.fact_transactions.select("transaction_id", "merchant_id", "amount")
    return joins.merchant_lookup(tx, s.dim_merchants, "merchant_id")


@query("join_merchant_left", sql="SELECT * FROM kpi_top_merchants")
def _(s: Star):
    return merchants(s)


@query("join_tx_fraud_left", sql="""
    SELECT t.transaction_id, t.customer_id, t.amount, f.alert_id, f.alert_status
    FROM fact_transactions t LEFT JOIN fact_fraud_alerts f ON f.transaction_id = t.transaction_id""")
def _(s: Star):
    tx = s.fact_transactions.select("transaction_id", "customer_id", "amount")
    return joins.tx_with_alerts(tx, s.fact_fraud_alerts)


@query("null_default", sql="""
    SELECT e.event_id, coalesce(nullif(trim(CASE WHEN e.event_id % 3 = 0 THEN '  ' WHEN e.event_id % 3 = 1 THEN e.event_type END), ''), '(empty)') AS label,
           coalesce(nullif(r.pipeline_status, ''), 'unknown') AS status, coalesce(l.n, 0) AS loan_count
    FROM events e JOIN dataset_registry r ON r.seq = e.event_id
    LEFT JOIN (SELECT customer_id, count(*) AS n FROM fact_loans GROUP BY 1) l ON l.customer_id = e.user_id""")
def _(s: Star):
    shown = F.when(F.col("event_id") % 3 == 0, "  ").when(F.col("event_id") % 3 == 1, F.col("event_type"))
    status = F.when(F.col("event_type") == "signup", "landed").when(F.col("event_type") == "purchase", "analytics_ready").when(
        F.col("event_type") == "error", "failed")
    rows = s.table("events").select(
        "event_id", F.col("user_id").alias("customer_id"), label_or(shown, "(empty)").alias("label"), label_or(status, "unknown").alias("status"))
    return joins.preagg_loans(rows, s.fact_loans).select("event_id", "label", "status", "loan_count")


@query("join_preagg_loans", sql="""
    SELECT c.customer_id, c.full_name, coalesce(l.n, 0) AS loan_count FROM dim_customers c
    LEFT JOIN (SELECT customer_id, count(*) AS n FROM fact_loans GROUP BY 1) l ON l.customer_id = c.customer_id""")
def _(s: Star):
    return joins.preagg_loans(s.dim_customers.select("customer_id", "full_name"), s.fact_loans)


@query("join_inner_merchant", sql="""
    SELECT merchant_name, txn_count, total_amount_ugx FROM (
      SELECT m.merchant_id, m.merchant_name, count(t.transaction_id) AS txn_count,
             CAST(sum(t.amount) AS DECIMAL(38,2)) AS total_amount_ugx
      FROM fact_transactions t JOIN dim_merchants m ON t.merchant_id = m.merchant_id
      GROUP BY 1, 2 ORDER BY txn_count DESC, m.merchant_id, m.merchant_name LIMIT 15)""")
def _(s: Star):
    return joins.inner_merchant_totals(s.fact_transactions, s.dim_merchants)


@query("join_left_count_accounts", sql="""
    SELECT c.customer_id, c.full_name, count(a.account_id) AS account_count
    FROM dim_customers c LEFT JOIN dim_accounts a ON c.customer_id = a.customer_id
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25""")
def _(s: Star):
    return joins.accounts_per_customer(s.dim_customers, s.dim_accounts)


@query("join_left_count_alerts_having", sql="""
    SELECT c.customer_id, c.full_name, count(f.alert_id) AS alert_count
    FROM dim_customers c LEFT JOIN fact_fraud_alerts f ON c.customer_id = f.customer_id
    GROUP BY 1, 2 HAVING count(f.alert_id) > 0 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def _(s: Star):
    return joins.alerted_customers(s.dim_customers, s.fact_fraud_alerts)


@query("join_cte_inner", sql="""
    WITH per_customer AS (SELECT customer_id, count(*) AS n FROM dim_accounts GROUP BY customer_id)
    SELECT c.full_name, p.n AS account_count FROM per_customer p
    JOIN dim_customers c ON c.customer_id = p.customer_id
    ORDER BY p.n DESC, c.customer_id, c.full_name LIMIT 15""")
def _(s: Star):
    return joins.account_holders(s.dim_customers, s.dim_accounts)


@query("join_multi_left_using", sql="""
    WITH spent AS (SELECT customer_id, sum(amount) AS a FROM fact_transactions GROUP BY 1),
    lent AS (SELECT customer_id, sum(principal_amount) AS b FROM fact_loans GROUP BY 1)
    SELECT customer_id, full_name, region, CAST(coalesce(a, 0) AS DECIMAL(38,2)) AS total_tx_ugx,
           CAST(coalesce(b, 0) AS DECIMAL(38,2)) AS total_loans_ugx
    FROM dim_customers LEFT JOIN spent USING (customer_id) LEFT JOIN lent USING (customer_id)
    ORDER BY total_tx_ugx DESC, total_loans_ugx DESC, customer_id LIMIT 50""")
def _(s: Star):
    return joins.high_value_customers(s.dim_customers, s.fact_transactions, s.fact_loans)


@query("join_project_left", sql="""
    SELECT c.customer_id, c.full_name, a.account_id
    FROM dim_customers c LEFT JOIN dim_accounts a ON c.customer_id = a.customer_id
    ORDER BY 1, 2, 3 NULLS FIRST LIMIT 20""")
def _(s: Star):
    return joins.customer_accounts(s.dim_customers, s.dim_accounts)


@query("join_cross_zone", sql="""
    SELECT c.region, e.event_type, count(*) AS event_count
    FROM dim_customers c JOIN events e ON e.user_id = c.customer_id GROUP BY 1, 2 ORDER BY 1, 2""")
def _(s: Star):
    space = SqlWorkspace(s.spark)
    own = Star(space.spark, s.folder)
    space.register("dim_customers.csv", own.dim_customers)
    space.register("Site Events.csv", own.table("events"))
    return space.readonly_sql("""
        SELECT c.region, e.event_type, sum(e.n) AS event_count
        FROM dim_customers c
        JOIN (SELECT user_id, event_type, count(*) AS n FROM site_events GROUP BY user_id, event_type) e
          ON e.user_id = c.customer_id
        GROUP BY c.region, e.event_type ORDER BY c.region, e.event_type""", 1000)


@query("anti_hidden", sql="""
    SELECT seq, dataset, pipeline_status FROM dataset_registry r
    WHERE NOT EXISTS (SELECT 1 FROM dataset_registry h
                      WHERE h.dataset = r.dataset AND h.status = 'failed' AND h.row_count >= 200)""")
def _(s: Star):
    hidden = s.registry.filter((F.col("status") == "failed") & (F.col("row_count") >= 200))
    return joins.anti_hidden(s.registry.select("seq", "dataset", "pipeline_status"), hidden)


@query("reconcile_job_status", sql="""
    SELECT job_id, run_id,
           CASE WHEN settled OR new_state = '' THEN status WHEN new_state = 'success' THEN 'completed'
                WHEN new_state IN ('failed', 'upstream_failed') THEN 'failed'
                WHEN new_state IN ('running', 'queued', 'scheduled') THEN 'queued' ELSE status END AS status,
           CASE WHEN settled OR new_state = '' THEN state ELSE new_state END AS state,
           CASE WHEN settled OR new_state = '' THEN message
                WHEN new_state = 'success' AND status <> 'completed' THEN 'Run completed successfully.'
                WHEN new_state IN ('failed', 'upstream_failed') AND status <> 'failed'
                  THEN concat('Run ended in state: ', new_state, '.') ELSE message END AS message
    FROM (
      SELECT event_id AS job_id, event_id AS run_id,
             CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'queued' END AS status,
             CASE event_type WHEN 'purchase' THEN 'success' ELSE 'running' END AS state,
             CAST(NULL AS VARCHAR) AS message, event_type = 'purchase' AS settled,
             CASE event_type WHEN 'signup' THEN 'success' WHEN 'error' THEN 'upstream_failed'
                             WHEN 'click' THEN 'scheduled' WHEN 'purchase' THEN 'failed' ELSE '' END AS new_state
      FROM events)""")
def _(s: Star):
    kind = F.col("event_type")
    jobs = s.table("events").select(
        F.col("event_id").alias("job_id"), F.col("event_id").alias("run_id"),
        F.when(kind == "purchase", "completed").otherwise("queued").alias("status"),
        F.when(kind == "purchase", "success").otherwise("running").alias("state"),
        F.lit(None).cast("string").alias("message"),
    )
    runs = s.table("events").select(
        F.col("event_id").alias("run_id"),
        F.when(kind == "signup", "success").when(kind == "error", "upstream_failed")
        .when(kind == "click", "scheduled").when(kind == "purchase", "failed").otherwise("").alias("new_state"),
    )
    return joins.reconcile_job_status(jobs, runs)


@query("registry_update", "upsert_registry", sql="""
    SELECT r.seq, r.dataset, r.status, CASE WHEN u.seq IS NOT NULL THEN 'analytics_ready' ELSE r.pipeline_status END
             AS pipeline_status,
           CASE WHEN u.seq IS NOT NULL THEN u.row_count + 1 ELSE r.row_count END AS row_count
    FROM dataset_registry r LEFT JOIN (
      SELECT max(seq) AS seq, uploaded_at, dataset, max(row_count) AS row_count FROM dataset_registry
      WHERE pipeline_status = 'landed' AND classification = 'finance' GROUP BY uploaded_at, dataset) u
    ON u.seq = r.seq""")
def _(s: Star):
    done = s.registry.filter(
        (F.col("pipeline_status") == "landed") & (F.col("classification") == "finance")
    ).groupBy("uploaded_at", "dataset").agg((F.max("row_count") + 1).alias("row_count"))
    updates = done.withColumn("pipeline_status", F.lit("analytics_ready")).withColumn(
        "status", F.lit(None).cast("string"))
    return reg.registry_update(s.registry, updates).select(
        "seq", "dataset", "status", "pipeline_status", "row_count")
