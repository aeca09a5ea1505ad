"""Projection, filter and SQL-guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.numbers import lenient_double
from ledgerloom.operators import predicates as pred
from ledgerloom.plans import validation
from ledgerloom.plans.sql_workspace import SqlWorkspace
from ledgerloom.sources.contracts import REQUIRED_COLUMNS
from ledgerloom.sources.csv_files import FIELDS, ragged_kind, scan_csv_raw
from ledgerloom.session import shared_folder
from ledgerloom.suite.aggregates import TODAY, daily, risk
from ledgerloom.suite.core import SQL_WHITESPACE, Star, query

# Dirty text made from every event: nulls, blanks, padded, broken and grouped numbers.
DIRTY_SQL = """
    SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN E' \\t '
             WHEN 'error' THEN concat(E' \\t', CAST(user_id AS VARCHAR), E'.25\\n')
             WHEN 'signup' THEN concat(CAST(user_id AS VARCHAR), CASE WHEN user_id % 3 = 0 THEN 'd' ELSE 'e2' END)
             ELSE concat('-1_', CAST(100 + user_id AS VARCHAR)) END AS note FROM events"""
# Dataset names dealt over the events: the ten known ones and four others.
NAMES = [*REQUIRED_COLUMNS, "survey.csv", "weather.csv", "notes.csv", "dim_customers.tsv"]
NAME_LIST_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def dirty(s: Star):
    kind, user = F.col("event_type"), F.col("user_id")
    text = user.cast("string")
    note = (
        F.when(kind == "view", F.lit(None).cast("string")).when(kind == "click", " \t ")
        .when(kind == "error", F.concat(F.lit(" \t"), text, F.lit(".25\n")))
        .when(kind == "signup", F.concat(text, F.when(user % 3 == 0, "d").otherwise("e2")))
        .otherwise(F.concat(F.lit("-1_"), (user + 100).cast("string")))
    )
    return s.table("events").select("event_id", note.alias("note"))


def dealt_names(s: Star):
    names = F.array(*[F.lit(n) for n in NAMES])
    return s.registry.withColumn(
        "dataset", F.element_at(names, (F.col("seq") % len(NAMES) + 1).cast("int"))
    )


@query("project_tx", sql="""
    SELECT transaction_id, customer_id, merchant_id, transaction_date, status, CAST(amount AS DOUBLE) AS amount
    FROM fact_transactions""")
def _(s: Star):
    text = s.fact_transactions.withColumn("amount", F.col("amount").cast("string"))
    return pred.project_tx(text)


@query("project_alerts", sql="SELECT transaction_id, alert_status FROM fact_fraud_alerts")
def _(s: Star):
    return pred.project_alerts(s.fact_fraud_alerts)


@query("project_loans", sql="SELECT customer_id, loan_id FROM fact_loans")
def _(s: Star):
    return pred.project_loans(s.fact_loans)


@query("lenient_double", sql=f"""
    SELECT event_id, CASE WHEN regexp_matches(t, '^[+-]?[0-9_]+(\\.[0-9]+)?(e[0-9]+)?$')
                          THEN CAST(replace(t, '_', '') AS DOUBLE) END AS value
    FROM (SELECT event_id, trim(note, {SQL_WHITESPACE}) AS t FROM ({DIRTY_SQL}))""")
def _(s: Star):
    return dirty(s).select("event_id", lenient_double(F.col("note")).alias("value"))


@query("trim_all", sql=f"SELECT event_id, trim(note, {SQL_WHITESPACE}) AS note FROM ({DIRTY_SQL})")
def _(s: Star):
    return pred.trim_all(dirty(s))


@query("null_or_empty", sql=f"""
    SELECT event_id FROM ({DIRTY_SQL}) WHERE coalesce(trim(note, {SQL_WHITESPACE}), '') = ''""")
def _(s: Star):
    return pred.null_or_empty(dirty(s), "note").select("event_id")


@query("nonempty_key", sql="""
    SELECT pipeline_status, count(*) AS n FROM dataset_registry WHERE coalesce(pipeline_status, '') <> '' GROUP BY 1""")
def _(s: Star):
    return pred.nonempty_key(s.registry, "pipeline_status").groupBy("pipeline_status").agg(
        F.count("*").alias("n"))


@query("required_columns", sql=f"""
    SELECT dataset, missing, count(*) AS landings FROM (
      SELECT dataset, CASE dataset WHEN 'dim_customers.csv' THEN 'full_name' WHEN 'dim_accounts.csv' THEN 'account_id'
        WHEN 'dim_merchants.csv' THEN 'merchant_id,merchant_name' WHEN 'dim_cards.csv' THEN 'card_id,account_id'
        WHEN 'dim_branches.csv' THEN 'branch_id,branch_name' WHEN 'dim_date.csv' THEN 'date_key,full_date'
        WHEN 'fact_transactions.csv' THEN 'transaction_id,account_id,merchant_id'
        WHEN 'fact_fraud_alerts.csv' THEN 'alert_id,transaction_id,account_id' WHEN 'fact_loans.csv' THEN 'loan_id'
        WHEN 'fact_loan_repayments.csv' THEN 'repayment_id,loan_id' ELSE '' END
        || CASE WHEN seq % 2 = 0 AND dataset IN ('fact_transactions.csv', 'fact_loan_repayments.csv') THEN ',amount'
                WHEN seq % 2 = 0 AND dataset = 'fact_loans.csv' THEN ',principal_amount' ELSE '' END AS missing
      FROM (SELECT event_id AS seq, {NAME_LIST_SQL}[event_id % {len(NAMES)} + 1] AS dataset FROM events))
    GROUP BY 1, 2""")
def _(s: Star):
    odd = F.array(F.lit("customer_id"), F.lit("amount"), F.lit("principal_amount"))
    even = F.array(F.lit("customer_id"), F.lit("region"))
    landings = dealt_names(s).select(
        "dataset", F.when(F.col("seq") % 2 == 0, even).otherwise(odd).alias("columns"))
    return (
        pred.required_columns(landings).select("dataset", F.concat_ws(",", "missing").alias("missing"))
        .groupBy("dataset", "missing").agg(F.count("*").alias("landings"))
    )


RAGGED = "c_custkey % 10"


@query("ragged_rows", sql="""
    SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS full_name,
           CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS segment,
           CASE c_custkey % 10 WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'ok' END AS kind FROM customer""")
def _(s: Star):
    path = f"{shared_folder(s.spark, 'ragged')}/customers.csv"
    key = F.col("c_custkey")
    record = F.concat_ws(
        ",", key.cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')),
        F.when(key % 10 != 0, F.col("c_mktsegment")), F.when(key % 10 == 1, F.lit('"spare, cell"')))
    (s.table("customer").select(record.alias("customer_id,full_name,segment"))
     .write.options(header=True, quote="", escape="", delimiter="\x01").csv(path))
    rows = scan_csv_raw(s.spark, path, keep_field_count=True)
    return rows.withColumn("kind", ragged_kind(3)).drop(FIELDS)


@query("reject_empty", sql="SELECT loan_id, customer_id FROM fact_loans")
def _(s: Star):
    return pred.reject_empty(s.fact_loans.select("loan_id", "customer_id"))


@query("status_landed", sql="SELECT seq, dataset FROM dataset_registry WHERE pipeline_status = 'landed'")
def _(s: Star):
    return pred.status_landed(s.registry).select("seq", "dataset")


@query("status_ready", sql="""
    SELECT seq, dataset FROM dataset_registry
    WHERE pipeline_status = 'analytics_ready' OR (status = 'success' AND coalesce(pipeline_status, '') = '')""")
def _(s: Star):
    return pred.status_ready(s.registry).select("seq", "dataset")


@query("status_failed", sql="SELECT seq, dataset FROM dataset_registry WHERE status = 'failed'")
def _(s: Star):
    return pred.status_failed(s.registry).select("seq", "dataset")


@query("classify", sql=f"""
    SELECT dataset, CASE WHEN i < 10 THEN 'finance' ELSE 'external' END AS classification, count(*) AS n
    FROM (SELECT event_id % {len(NAMES)} AS i, {NAME_LIST_SQL}[event_id % {len(NAMES)} + 1] AS dataset FROM events)
    GROUP BY 1, 2""")
def _(s: Star):
    return dealt_names(s).groupBy("dataset", pred.classify(F.col("dataset")).alias("classification")).agg(
        F.count("*").alias("n"))


@query("dq_bad_daily", sql="""
    SELECT * FROM kpi_daily_transactions WHERE transaction_count IS NULL OR total_amount_ugx IS NULL
       OR (transaction_count = 0 AND total_amount_ugx > 0)""")
def _(s: Star):
    return validation.dq_bad_daily(daily(s))


@query("risk_outliers", sql="""
    SELECT customer_id, fraud_alert_count, loan_count, transaction_count FROM kpi_customer_risk
    WHERE fraud_alert_count > 0 AND loan_count > 0 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25""")
def _(s: Star):
    return validation.risk_outliers(risk(s))


@query("date_range_filter", sql="""
    SELECT transaction_id, transaction_date, amount FROM fact_transactions
    WHERE transaction_date >= DATE '2001-11-04' - INTERVAL 30 DAY""")
def _(s: Star):
    return pred.date_range(s.fact_transactions, "transaction_date", TODAY).select(
        "transaction_id", "transaction_date", "amount")


@query("eq_range_filter", sql="""
    SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000 ORDER BY n_chars DESC, doc_id LIMIT 20""")
def _(s: Star):
    docs = s.table("documents").filter((F.col("lang") == "en") & (F.col("n_chars") > 1000))
    return docs.select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("prefix_like", sql="SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 'blue%'")
def _(s: Star):
    return pred.prefix_like(s.table("part"), "p_name", "Blue").select("p_partkey", "p_name")


@query("search_any_cell", sql="""
    SELECT conv_id, turn, role FROM conversations
    WHERE contains(lower(CAST(conv_id AS VARCHAR)), 'ther') OR contains(lower(CAST(turn AS VARCHAR)), 'ther')
       OR contains(lower(coalesce(role, '')), 'ther') OR contains(lower(coalesce(text, '')), 'ther')""")
def _(s: Star):
    return pred.search_any_cell(s.table("conversations"), " THER ").select("conv_id", "turn", "role")


@query("search_concat", sql="""
    SELECT doc_id, lang, source FROM documents
    WHERE contains(lower(concat(lang, ' ', source, ' ', text)), 'n src1')""")
def _(s: Star):
    return pred.search_concat(s.table("documents"), "N src1", ["lang", "source", "text"]).select(
        "doc_id", "lang", "source")


@query("hide_failed_jobs", sql="""
    SELECT event_id, event_type FROM events WHERE event_type <> 'error'""")
def _(s: Star):
    jobs = s.table("events").select("event_id", "event_type", F.when(
        F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", F.lit(None)).otherwise(
        "completed").alias("status"))
    return pred.hide_failed_jobs(jobs).select("event_id", "event_type")


@query("case_flag", sql="""
    SELECT merchant_id, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed_count
    FROM fact_transactions GROUP BY 1""")
def _(s: Star):
    flag = F.when(F.col("status") == "failed", 1).otherwise(0)
    return s.fact_transactions.groupBy("merchant_id").agg(F.sum(flag).alias("failed_count"))


@query("literal_column", sql="SELECT transaction_id, alert_status, CAST(1 AS INTEGER) AS is_fraud FROM fact_fraud_alerts")
def _(s: Star):
    return s.fact_fraud_alerts.select("transaction_id", "alert_status").withColumn("is_fraud", F.lit(1))


def workspace(s: Star, *names: str) -> SqlWorkspace:
    """A SQL workspace with star-schema views."""
    space = SqlWorkspace(s.spark)
    own = Star(space.spark, s.folder)
    for name in names:
        space.register(name, getattr(own, name))
    return space


@query("readonly_sql", sql="""
    SELECT l.loan_status, c.region, count(*) AS n, CAST(sum(CAST(l.principal_amount AS DOUBLE)) AS DECIMAL(18,0)) AS total
    FROM fact_loans l JOIN dim_customers c ON c.customer_id = l.customer_id GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 200""")
def _(s: Star):
    return workspace(s, "fact_loans", "dim_customers").readonly_sql("""
        WITH lent AS (
          SELECT l.loan_status, l.customer_id, count(*) AS n, sum(CAST(l.principal_amount AS REAL)) AS total
          FROM fact_loans l GROUP BY l.loan_status, l.customer_id)
        SELECT loan_status, c."region", sum(n) AS n, CAST(sum(total) AS decimal(18,0)) AS total
        FROM lent JOIN dim_customers c ON c.customer_id = lent.customer_id
        WHERE loan_status <> 'never; update this'
        GROUP BY loan_status, c."region" ORDER BY loan_status, region -- one row per pair
        ;""")


@query("readonly_sql_capped", sql="""
    SELECT loan_id, principal_amount FROM fact_loans ORDER BY principal_amount DESC, loan_id LIMIT 500""")
def _(s: Star):
    return workspace(s, "fact_loans").readonly_sql_capped(
        "SELECT loan_id, principal_amount FROM fact_loans ORDER BY principal_amount DESC, loan_id", 9999)


@query("numeric_columns", sql="""
    SELECT CAST(0 AS INTEGER) AS position, 'event_id' AS "column", count(*) AS numeric_count FROM events
    UNION ALL SELECT 2, 'number', count(*) FROM events WHERE event_type = 'signup'""")
def _(s: Star):
    cells = s.table("events").select(
        F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.when(F.col("event_type") == "signup", F.col("user_id").cast("string")).otherwise("n/a").alias("number"),
        "props")
    return pred.numeric_columns(cells)
