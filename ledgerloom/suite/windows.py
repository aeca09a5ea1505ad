"""Window, chart, sort and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import limits
from ledgerloom.operators import registry as reg
from ledgerloom.operators import windows as win
from ledgerloom.operators.predicates import chart_series
from ledgerloom.plans import validation
from ledgerloom.suite.aggregates import daily, merchants
from ledgerloom.suite.core import Star, query

POINTS_SQL = """
    SELECT CAST(row_number() OVER (ORDER BY n DESC, o_orderpriority) - 1 AS INTEGER) AS ord,
           o_orderpriority AS label, CAST(n AS DOUBLE) AS value
    FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) QUALIFY ord < 20"""


def points(s: Star):
    counts = s.table("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return chart_series(counts, "o_orderpriority", "n", [F.desc("value"), F.asc("label")])


@query("chart_series", sql=POINTS_SQL)
def _(s: Star):
    return points(s)


@query("share_of_total", sql=f"""
    SELECT ord, label, value, value / sum(value) OVER () AS share FROM ({POINTS_SQL}) QUALIFY ord < 10""")
def _(s: Star):
    return win.share_of_total(points(s)).drop("share_start", "share_end")


@query("running_share", sql=f"""
    SELECT ord, label, coalesce(lag(share_end) OVER (ORDER BY ord), 0.0) AS share_start, share_end FROM (
      SELECT ord, label, sum(share) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS share_end
      FROM (SELECT ord, label, value / sum(value) OVER () AS share FROM ({POINTS_SQL}))) WHERE ord < 10""")
def _(s: Star):
    return win.share_of_total(points(s)).select(
        "ord", "label", "share_start", "share_end")


@query("scale_to_max", sql=f"""
    SELECT ord, label, value, value / greatest(1.0, max(value) OVER ()) AS scaled FROM ({POINTS_SQL})""")
def _(s: Star):
    return win.scale_to_max(points(s))


@query("concentration_top3_of_top10", sql="""
    WITH ranked AS (
      SELECT total_amount_ugx, row_number() OVER (ORDER BY total_amount_ugx DESC, merchant_id) AS rnk
      FROM kpi_top_merchants)
    SELECT round(CAST(100 * sum(CASE WHEN rnk <= 3 THEN total_amount_ugx ELSE 0 END) AS DOUBLE)
           / nullif(CAST(sum(total_amount_ugx) AS DOUBLE), 0), 2) AS pct_top3_of_top10
    FROM ranked WHERE rnk <= 10""")
def _(s: Star):
    return win.concentration_top3_of_top10(merchants(s))


@query("latest_landed", sql="""
    SELECT dataset, seq, status, row_count FROM dataset_registry WHERE pipeline_status = 'landed'
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY uploaded_at DESC, seq DESC) = 1""")
def _(s: Star):
    return win.latest_landed(s.registry).select("dataset", "seq", "status", "row_count")


@query("dim_last_wins", sql="""
    SELECT user_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def _(s: Star):
    return win.last_wins(s.table("events"), "user_id", "event_type", "event_id")


@query("sort_multi", sql="""
    SELECT * FROM kpi_top_merchants ORDER BY transaction_count DESC, total_amount_ugx DESC, merchant_id""")
def _(s: Star):
    return merchants(s).orderBy(F.desc("transaction_count"), F.desc("total_amount_ugx"), "merchant_id")


@query("topk_accounts_balance", sql="""
    SELECT account_id, customer_id, current_balance FROM dim_accounts
    ORDER BY current_balance DESC, account_id LIMIT 15""")
def _(s: Star):
    accounts = s.dim_accounts.select("account_id", "customer_id", "current_balance")
    return limits.top_k(accounts, 15, F.desc("current_balance"), "account_id")


@query("sorted_names", sql="""
    SELECT merchant_id, merchant_name FROM dim_merchants ORDER BY merchant_name, merchant_id LIMIT 20""")
def _(s: Star):
    return limits.top_k(s.dim_merchants.select("merchant_id", "merchant_name"), 20, "merchant_name", "merchant_id")


@query("limit_sample", sql="""
    SELECT customer_id, full_name, region FROM dim_customers ORDER BY customer_id LIMIT 15""")
def _(s: Star):
    return limits.top_k(s.dim_customers.select("customer_id", "full_name", "region"), 15, "customer_id")


@query("top_merchants_curated", sql="""
    SELECT merchant_id, merchant_name, transaction_count, total_amount_ugx FROM kpi_top_merchants
    ORDER BY transaction_count DESC, total_amount_ugx DESC, merchant_id LIMIT 10""")
def _(s: Star):
    return validation.top_merchants_curated(merchants(s))


@query("daily_trend", sql="SELECT * FROM kpi_daily_transactions ORDER BY transaction_date DESC LIMIT 14")
def _(s: Star):
    return validation.daily_trend(daily(s))


@query("limit_clamped", sql="SELECT loan_id, principal_amount FROM fact_loans ORDER BY loan_id LIMIT 200")
def _(s: Star):
    return limits.limit_clamped(s.fact_loans.select("loan_id", "principal_amount"), 5000, 1, 200, "loan_id")


@query("rows_per_page", sql="SELECT loan_id, loan_status FROM fact_loans ORDER BY loan_id DESC LIMIT 50")
def _(s: Star):
    return limits.rows_per_page(s.fact_loans.select("loan_id", "loan_status").orderBy(F.desc("loan_id")), 50)


@query("last_days", sql="""
    SELECT transaction_date, transaction_count FROM (
      SELECT * FROM kpi_daily_transactions ORDER BY transaction_date DESC LIMIT 14) ORDER BY transaction_date""")
def _(s: Star):
    return limits.last_days(daily(s).select("transaction_date", "transaction_count"), "transaction_date", 14)


@query("newest_n", sql="SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 300")
def _(s: Star):
    return limits.newest_n(s.table("events").select("event_id", "event_type", "user_id"), reg.SHOWN, F.desc("event_id"))
