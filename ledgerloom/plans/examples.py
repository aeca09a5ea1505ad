"""Ad-hoc queries over the registered tables that between them use what the SQL workspace supports."""

from __future__ import annotations

TABLES = (
    "dim_customers", "dim_accounts", "dim_merchants", "dim_branches",
    "fact_transactions", "fact_fraud_alerts", "fact_loans",
)

EXAMPLES: dict[str, str] = {
    # CTE over a CTE, scalar subquery
    "days above the mean": """
        WITH per_day AS (SELECT transaction_date AS d, SUM(CAST(amount AS REAL)) AS moved
                         FROM fact_transactions WHERE status <> 'failed' GROUP BY transaction_date),
             level AS (SELECT AVG(moved) AS usual FROM per_day)
        SELECT d, moved FROM per_day WHERE moved > (SELECT usual FROM level)""",
    # USING, aggregate over a join
    "channel use by region": """
        SELECT region, channel, COUNT(*) AS uses
        FROM fact_transactions JOIN dim_customers USING (customer_id) GROUP BY region, channel""",
    # HAVING on an alias
    "failing channels": """
        SELECT channel, SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failures
        FROM fact_transactions GROUP BY channel HAVING failures > 0""",
    # UNION ALL of filters
    "outlying loans": """
        SELECT 'small' AS size, loan_id FROM fact_loans WHERE principal_amount < 2000
        UNION ALL SELECT 'large', loan_id FROM fact_loans WHERE principal_amount > 200000""",
    # EXISTS
    "borrowers with an open account": """
        SELECT l.loan_status, COUNT(*) AS loans FROM fact_loans l
        WHERE EXISTS (SELECT 1 FROM dim_accounts a WHERE a.customer_id = l.customer_id) GROUP BY l.loan_status""",
    # window
    "latest alert per customer": """
        SELECT customer_id, alert_id FROM (
          SELECT customer_id, alert_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY alert_date DESC, alert_id DESC) AS k
          FROM fact_fraud_alerts) x WHERE k = 1""",
    # anti join
    "merchants without sales": """
        SELECT m.merchant_id FROM dim_merchants m LEFT JOIN fact_transactions t ON t.merchant_id = m.merchant_id
        WHERE t.transaction_id IS NULL OR t.status = 'failed'""",
    # CAST to TEXT, LIKE
    "accounts by leading digit": """
        SELECT SUBSTR(CAST(account_id AS TEXT), 1, 1) AS lead_digit, COUNT(*) AS accounts
        FROM dim_accounts WHERE CAST(account_id AS TEXT) LIKE '1%' GROUP BY 1""",
    # COUNT DISTINCT, quoted name
    "branches and regions": """
        SELECT COUNT(DISTINCT region) AS "regions covered", COUNT(*) AS branches FROM dim_branches""",
    # IN over a subquery, ORDER BY and LIMIT
    "loans of alerted customers": """
        SELECT loan_id, principal_amount FROM fact_loans
        WHERE customer_id IN (SELECT customer_id FROM fact_fraud_alerts) ORDER BY principal_amount DESC, loan_id LIMIT 40""",
}
