"""Scan, zone, registry and sink queries. Each runs over CSV copies of whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions.text import table_name
from ledgerloom.operators import registry as reg
from ledgerloom.operators import synth
from ledgerloom.operators.limits import newest_n
from ledgerloom.operators.predicates import trim_all
from ledgerloom.operators.windows import last_wins
from ledgerloom.plans import curate, ingest, kpi
from ledgerloom.plans.sql_workspace import SqlWorkspace
from ledgerloom.session import literal_rows, shared_folder
from ledgerloom.sources import zones as z
from ledgerloom.sources.contracts import AUDIT, GATED, JOB_COLUMNS, KPI_TABLES, REGISTRY
from ledgerloom.sources.csv_files import (
    ROW_ORDER, export_csv, load_warehouse_infer, scan_csv_job, scan_csv_raw, write_csv,
)
from ledgerloom.sources.logs import JsonLog
from ledgerloom.suite.core import SQL_WHITESPACE, Star, csv_copy, query
from ledgerloom.suite.predicates import NAME_LIST_SQL, NAMES, dealt_names

LANDED_AT = dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
DOCS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents"


def zones_with(s: Star, stored: dict[str, str]) -> z.Zones:
    """Zones whose published datasets (file name to frame name) are CSV copies."""
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    for file, frame in stored.items():
        write_csv(getattr(s, frame), zones.published(file))
    return zones


def landed(s: Star, zones: z.Zones, file: str, df, now: dt.datetime = LANDED_AT) -> dict:
    """Upload a CSV copy of a frame and land it."""
    incoming = f"{zones.root}/incoming/{file}"
    write_csv(df, incoming)
    return zones.land(incoming, file, now)


@query("scan_csv_raw", sql=DOCS_SQL)
def _(s: Star):
    return scan_csv_raw(s.spark, csv_copy(s, s.table("documents"), "documents"))


JOB_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS input, CAST({a} AS VARCHAR) AS first, CAST({b} AS VARCHAR) AS second FROM {t}"
    for t, a, b in [("fact_transactions", "transaction_id", "merchant_id"),
                    ("fact_fraud_alerts", "transaction_id", "alert_status"),
                    ("fact_loans", "customer_id", "loan_id"), ("dim_merchants", "merchant_id", "merchant_name")])


@query("scan_csv_job", sql=JOB_SQL)
def _(s: Star):
    firsts = {"fact_transactions": ("transaction_id", "merchant_id"),
              "fact_fraud_alerts": ("transaction_id", "alert_status"),
              "fact_loans": ("customer_id", "loan_id"), "dim_merchants": ("merchant_id", "merchant_name")}
    return z.union_all([
        scan_csv_job(s.spark, csv_copy(s, getattr(s, t), t))
        .select(F.lit(t).alias("input"), F.col(a).alias("first"), F.col(b).alias("second"))
        for t, (a, b) in firsts.items()
    ])


@query("scan_gated", sql="""
    SELECT 'dim_customers.csv' AS dataset, count(*) AS row_count FROM dim_customers
    UNION ALL SELECT 'fact_loans.csv', count(*) FROM fact_loans
    UNION ALL SELECT 'dim_branches.csv', count(*) FROM dim_branches
    UNION ALL SELECT 'fact_fraud_alerts.csv', 0""")
def _(s: Star):
    zones = zones_with(s, {"dim_customers.csv": "dim_customers", "fact_loans.csv": "fact_loans",
                           "dim_branches.csv": "dim_branches"})
    zones.mark_ready("fact_loans.csv", LANDED_AT.isoformat())
    names = ["dim_customers.csv", "fact_loans.csv", "dim_branches.csv", "fact_fraud_alerts.csv"]
    return z.union_all([
        zones.scan_gated(n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("dataset"), "row_count")
        for n in names
    ])


@query("register_tables", sql="""
    SELECT 'dim_customers' AS table_id, count(*) AS row_count FROM dim_customers
    UNION ALL SELECT 'fact_loans', count(*) FROM dim_branches
    UNION ALL SELECT 'my_accounts_2024', count(*) FROM dim_accounts""")
def _(s: Star):
    zones = zones_with(s, {"dim_customers.csv": "dim_customers", "fact_loans.csv": "fact_loans",
                           "Fact-Loans.csv": "dim_branches", "My Accounts (2024).csv": "dim_accounts"})
    space = SqlWorkspace(s.spark)
    tables = space.register_zones(zones.root)
    return space.readonly_sql(" UNION ALL ".join(
        f"SELECT '{t}' AS table_id, count(*) AS row_count FROM {t}" for t in tables))


@query("catalog_list", sql="""
    SELECT table_id, concat('SELECT * FROM ', table_id, ' LIMIT 100') AS select_preview_sql FROM (
      SELECT 'dim_branches' AS table_id WHERE EXISTS (SELECT 1 FROM dim_branches)
      UNION ALL SELECT 'dim_customers' WHERE EXISTS (SELECT 1 FROM dim_customers)
      UNION ALL SELECT 'fact_loans' WHERE EXISTS (SELECT 1 FROM fact_loans)) ORDER BY 1""")
def _(s: Star):
    zones = zones_with(s, {n + ".csv": n for n in ("dim_customers", "fact_loans", "dim_branches")})
    space = SqlWorkspace(s.spark)
    space.register_zones(zones.root)
    return space.catalog_list().select("table_id", "select_preview_sql")


@query("table_name", sql=r"""
    SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(
             regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\.[^.]+$', '\1')),
             '[^a-z0-9_]+', '_', 'g'), '_'), ''), 'dataset') AS table_id FROM pages""")
def _(s: Star):
    return s.table("pages").select("page_id", table_name(F.col("url")).alias("table_id"))


@query("preview", sql="""
    SELECT CAST(loan_id AS VARCHAR) AS loan_id, CAST(customer_id AS VARCHAR) AS customer_id,
           CAST(principal_amount AS VARCHAR) AS principal_amount, loan_status, CAST(issue_date AS VARCHAR) AS issue_date
    FROM fact_loans ORDER BY fact_loans.loan_id LIMIT 25""")
def _(s: Star):
    zones = zones_with(s, {"fact_loans.csv": "fact_loans"})
    return zones.preview("fact_loans.csv", 25, F.col("loan_id").cast("bigint"))


@query("land", sql="""
    SELECT dataset, classification, concat('20240102T030405Z_', dataset) AS landing_file,
           'landed' AS pipeline_status, n AS row_count FROM (
      SELECT 'dim_merchants.csv' AS dataset, 'finance' AS classification, count(*) AS n FROM dim_merchants
      UNION ALL SELECT 'fact_loans.csv', 'finance', count(*) FROM fact_loans
      UNION ALL SELECT 'chats.csv', 'external', count(*) FROM conversations)""")
def _(s: Star):
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    uploads = {"dim_merchants.csv": s.dim_merchants, "fact_loans.csv": s.fact_loans,
               "chats.csv": s.table("conversations")}
    for file, df in uploads.items():
        landed(s, zones, file, df)
    stamp = LANDED_AT.strftime("%Y%m%dT%H%M%SZ")
    counts = z.union_all([
        scan_csv_raw(s.spark, zones.landing(f"{stamp}_{f}")).agg(F.count("*").alias("row_count"))
        .select(F.lit(f).alias("dataset"), "row_count") for f in uploads
    ])
    listed = zones.catalog().select("dataset", "classification", "landing_file", "pipeline_status")
    return listed.join(F.broadcast(counts), "dataset")


@query("write_processed", sql=f"""
    SELECT doc_id, trim(text, {SQL_WHITESPACE}) AS text, lang, source, n_chars FROM ({DOCS_SQL})""")
def _(s: Star):
    padded = s.table("documents").withColumn("text", F.concat(F.lit(" \t"), "text", F.lit("  ")))
    raw = scan_csv_raw(s.spark, csv_copy(s, padded, "documents"), keep_field_count=True)
    path = f"{shared_folder(s.spark, 'processed')}/documents"
    ingest.write_processed(raw, path)
    return z.read_stored(s.spark, path)


def _in_order(s: Star, zones: z.Zones) -> None:
    """Documents landed and published as many files that stand in the order of their ids."""
    ordered = s.table("documents").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    entry = landed(s, zones, "notes.csv", ordered)
    zones.record(**ingest.process_landing(zones, entry["dataset"], entry["landing_file"], entry["uploaded_at"]))


@query("last_wins_over_files", sql="""
    SELECT lang, CAST(max_by(n_chars, doc_id) AS VARCHAR) AS n_chars FROM documents GROUP BY lang""")
def _(s: Star):
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    _in_order(s, zones)
    rows = zones.scan_gated("notes.csv", keep_order=True)
    return last_wins(rows, "lang", "n_chars", ROW_ORDER)


@query("preview_over_files", sql="""
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents ORDER BY documents.doc_id LIMIT 40""")
def _(s: Star):
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    _in_order(s, zones)
    return zones.preview("notes.csv", 40).select("doc_id", "lang", "source")


@query("publish", sql="""
    SELECT 'finance' AS classification, 'fact_loans.csv' AS dataset, count(*) AS row_count,
           CAST(sum(principal_amount) AS DECIMAL(38,2)) AS total FROM fact_loans
    UNION ALL SELECT 'external', 'balances.csv', count(*), CAST(sum(current_balance) AS DECIMAL(38,2)) FROM dim_accounts""")
def _(s: Star):
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    parts = []
    for kind, file, df, amount in [("finance", "fact_loans.csv", s.fact_loans, "principal_amount"),
                                   ("external", "balances.csv", s.dim_accounts, "current_balance")]:
        trim_all(df).write.parquet(zones.processing(file))
        path = ingest.publish(zones, zones.processing(file), file)
        parts.append(s.spark.read.parquet(path).agg(
            F.count("*").alias("row_count"), F.sum(amount).cast("decimal(38,2)").alias("total")
        ).select(F.lit(kind).alias("classification"), F.lit(file).alias("dataset"), "row_count", "total"))
    return z.union_all(parts)


GATED_SQL = f"""
    SELECT dataset, max(stamp) FILTER (WHERE kind = 'ready') AS ready, max(stamp) FILTER (WHERE kind = 'legacy') AS legacy,
           arg_max(kind, seq) = 'ready' AS is_ready
    FROM (SELECT event_id AS seq, {NAME_LIST_SQL}[event_id % {len(NAMES)} + 1] AS dataset, CAST(ts AS VARCHAR) AS stamp,
                 CASE WHEN event_type = 'purchase' THEN 'ready' WHEN event_type IN ('signup', 'error') THEN 'other' ELSE 'legacy' END AS kind
          FROM events)
    WHERE dataset IN ({", ".join(f"'{n}'" for n in GATED)}) GROUP BY dataset"""


def _marked(s: Star) -> z.Zones:
    """Zones with the markers of the gated datasets: an old one for each, a new one if its last run was ready."""
    status = F.col("pipeline_status")
    kind = F.when(status == "analytics_ready", "ready").when(status.isNull(), "legacy").otherwise("other")
    stamp = F.col("uploaded_at").cast("string")
    found = dealt_names(s).filter(F.col("dataset").isin(GATED)).groupBy("dataset").agg(
        F.max(F.when(kind == "ready", stamp)).alias("ready"), F.max(F.when(kind == "legacy", stamp)).alias("legacy"),
        (F.max_by(kind, "seq") == "ready").alias("is_ready"))
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    for row in found.toLocalIterator():  # the six gated datasets
        if row.legacy:
            zones.files.write_marker(zones.marker(row.dataset, "ok"), row.legacy)
        if row.is_ready:
            zones.mark_ready(row.dataset, row.ready)
    return zones


@query("migrate_ok", sql=f"""
    SELECT dataset, coalesce(CASE WHEN is_ready THEN ready END, legacy) AS ready_at, NOT is_ready AS moved
    FROM ({GATED_SQL}) WHERE is_ready OR legacy IS NOT NULL""")
def _(s: Star):
    zones = _marked(s)
    moved = zones.migrate_ok()
    ready = [n for n in GATED if zones.is_ready(n)]
    rows = s.spark.read.text([zones.marker(n) for n in ready], wholetext=True)
    return rows.select(
        F.regexp_replace(F.col("_metadata.file_name"), "[.]analytics_ready$", "").alias("dataset"), F.col("value").alias("ready_at"),
    ).withColumn("moved", F.col("dataset").isin(moved) if moved else F.lit(False))


@query("mark_ready", sql="""
    SELECT 'before' AS step, CAST(NULL AS VARCHAR) AS ready_at, CAST(0 AS BIGINT) AS loans, CAST(0 AS DECIMAL(38,2)) AS total
    UNION ALL SELECT 'first', 't1', count(*), CAST(coalesce(sum(principal_amount), 0) AS DECIMAL(38,2)) FROM fact_loans WHERE loan_status = 'F'
    UNION ALL SELECT 'between', 't1', count(*), CAST(coalesce(sum(principal_amount), 0) AS DECIMAL(38,2)) FROM fact_loans WHERE loan_status = 'F'
    UNION ALL SELECT 'second', 't2', count(*), CAST(sum(principal_amount) AS DECIMAL(38,2)) FROM fact_loans""")
def _(s: Star):
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    name, seen = "fact_loans.csv", []

    def look(step: str) -> None:
        rows = zones.scan_gated(name, strict=True)
        seen.append(rows.agg(
            F.lit(step).alias("step"), F.lit(zones.ready_at(name)).cast("string").alias("ready_at"), F.count("*").alias("loans"),
            F.coalesce(F.sum(F.col("principal_amount").cast("decimal(18,2)")), F.lit(0)).cast("decimal(38,2)").alias("total")))

    def put(df) -> str:
        trim_all(df).write.parquet(zones.processing(name))
        return ingest.publish(zones, zones.processing(name), name)

    first = put(s.fact_loans.filter("loan_status = 'F'"))
    look("before")
    zones.mark_ready(name, "t1", first)
    look("first")
    second = put(s.fact_loans)
    look("between")
    zones.mark_ready(name, "t2", second)
    look("second")
    return z.union_all(seen)


@query("registry_with_ready_times", sql="""
    SELECT r.seq, r.dataset, CAST(coalesce(m.ready, m.legacy) AS VARCHAR) AS ready_at
    FROM dataset_registry r LEFT JOIN (
      SELECT dataset, max(uploaded_at) FILTER (WHERE pipeline_status = 'analytics_ready') AS ready,
             max(uploaded_at) FILTER (WHERE pipeline_status IS NULL) AS legacy
      FROM dataset_registry GROUP BY dataset) m ON m.dataset = r.dataset""")
def _(s: Star):
    status = F.col("pipeline_status")
    markers = s.registry.select(
        "dataset", F.when(status == "analytics_ready", "analytics_ready").when(status.isNull(), "ok").alias("kind"),
        F.col("uploaded_at").alias("stamp"))
    ready = reg.ready_times(markers)
    return reg.mark_ready(s.registry.select("seq", "dataset"), ready).withColumn("ready_at", F.col("ready_at").cast("string"))


CURATED_SQL = """
    SELECT 'daily' AS tab, CAST(transaction_date AS VARCHAR) AS k, CAST(transaction_count AS VARCHAR) AS n,
           CAST(total_amount_ugx AS VARCHAR) AS amount, CAST(failed_count AS VARCHAR) AS rest FROM kpi_daily_transactions
    UNION ALL SELECT 'risk', CAST(customer_id AS VARCHAR), CAST(transaction_count AS VARCHAR),
           CAST(total_amount_ugx AS VARCHAR), concat(fraud_alert_count, '/', loan_count) FROM kpi_customer_risk
    UNION ALL SELECT 'merchants', CAST(merchant_id AS VARCHAR), CAST(transaction_count AS VARCHAR),
           CAST(total_amount_ugx AS VARCHAR), coalesce(merchant_name, '') FROM kpi_top_merchants"""
CURATED_KEYS = [("daily", "kpi_daily_transactions", "transaction_date", ["failed_count"]),
                ("risk", "kpi_customer_risk", "customer_id", ["fraud_alert_count", "loan_count"]),
                ("merchants", "kpi_top_merchants", "merchant_id", ["merchant_name"])]


def _stacked(frames: dict):
    """The three KPI tables as text rows (tab, k, n, amount, rest)."""
    return z.union_all([
        frames[table].select(
            F.lit(tab).alias("tab"), F.col(key).cast("string").alias("k"),
            F.col("transaction_count").cast("string").alias("n"),
            F.col("total_amount_ugx").cast("string").alias("amount"), F.concat_ws("/", *rest).alias("rest"))
        for tab, table, key, rest in CURATED_KEYS
    ])


def _curated(s: Star) -> dict:
    """The three KPI tables; their transactions, a join of lines and orders, are joined once."""
    return kpi.curated_frames(curate.transactions_once(s.frames(*JOB_COLUMNS), shared_folder(s.spark, "transactions")))


@query("curate", sql=CURATED_SQL)
def _(s: Star):
    return _stacked(_curated(s))


@query("write_curated_csv", sql=CURATED_SQL)
def _(s: Star):
    frames = _curated(s)
    paths = curate.write_curated_csv(frames, shared_folder(s.spark, "curated-csv"))
    return _stacked({n: scan_csv_job(s.spark, p) for n, p in paths.items()})


@query("load_curated", sql=CURATED_SQL)
def _(s: Star):
    folder = shared_folder(s.spark, "curated")
    frames = _curated(s)
    # A run before this one, which the second replaces as a whole.
    curate.load_curated({n: f.limit(0) for n, f in frames.items()}, folder)
    curate.load_curated(frames, folder)
    return _stacked(curate.read_curated(s.spark, folder))


@query("curate_and_load", sql="""
    SELECT (SELECT count(*) FROM kpi_daily_transactions) AS daily_rows,
           (SELECT CAST(sum(transaction_count) AS BIGINT) FROM kpi_customer_risk) AS risk_rows,
           (SELECT CAST(sum(fraud_alert_count) AS BIGINT) FROM kpi_customer_risk) AS alerts,
           (SELECT CAST(sum(total_amount_ugx) AS DECIMAL(38,2)) FROM kpi_top_merchants) AS amount""")
def _(s: Star):
    inputs, out = shared_folder(s.spark, "inputs"), shared_folder(s.spark, "curated")
    for name, columns in JOB_COLUMNS.items():
        csv_copy(s, getattr(s, name).select(*columns), name, inputs)
    tables = curate.curate_and_load(s.spark, inputs, out)
    risk = tables["kpi_customer_risk"].agg(
        F.sum("transaction_count").alias("r"), F.sum("fraud_alert_count").alias("a"))
    return tables["kpi_daily_transactions"].agg(F.count("*").alias("daily_rows")).select(
        "daily_rows", risk.select("r").scalar().alias("risk_rows"), risk.select("a").scalar().alias("alerts"),
        tables["kpi_top_merchants"].agg(F.sum("total_amount_ugx").cast("decimal(38,2)")).scalar().alias("amount"))


@query("load_warehouse_infer", sql="SELECT account_id, customer_id, current_balance FROM dim_accounts")
def _(s: Star):
    path = csv_copy(s, s.dim_accounts, "dim_accounts")
    table = load_warehouse_infer(s.spark, path, "wh_dim_accounts", f"{shared_folder(s.spark, 'warehouse')}/t")
    return table.select(F.col("account_id").cast("bigint").alias("account_id"),
                        F.col("customer_id").cast("bigint").alias("customer_id"),
                        F.col("current_balance").cast("decimal(18,2)").alias("current_balance"))


@query("require_inputs", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS input, count(*) AS row_count FROM {t}" for t in JOB_COLUMNS))
def _(s: Star):
    inputs = shared_folder(s.spark, "inputs")
    for name in JOB_COLUMNS:
        csv_copy(s, getattr(s, name), name, inputs)
    paths = z.require_inputs(s.spark, inputs, list(JOB_COLUMNS))
    return z.union_all([
        scan_csv_raw(s.spark, p).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("input"), "row_count")
        for n, p in paths.items()
    ])


def _as_registry(s: Star):
    have = s.registry.withColumn("uploaded_at", F.col("uploaded_at").cast("string"))
    return have.select([
        F.col(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in REGISTRY.fields
    ])


NEWEST_SQL = """
    SELECT seq, dataset, classification, pipeline_status, status, row_count
    FROM dataset_registry ORDER BY seq DESC LIMIT 500"""
SHOWN = ["seq", "dataset", "classification", "pipeline_status", "status", "row_count"]


@query("registry_read", sql=NEWEST_SQL.replace("ORDER BY seq DESC LIMIT 500", ""))
def _(s: Star):
    path = f"{shared_folder(s.spark, 'registry')}/dataset_registry"
    _as_registry(s).write.json(path)
    return z.registry_read(s.spark, path).select(*SHOWN)


@query("registry_append", sql=NEWEST_SQL)
def _(s: Star):
    log = JsonLog(s.spark, f"{shared_folder(s.spark, 'registry')}/dataset_registry", REGISTRY)
    rows = _as_registry(s)
    log.append_rows(rows.filter("seq % 2 = 0"))
    log.snapshot()
    log.append_rows(rows.filter("seq % 2 = 1"))
    return log.newest(reg.KEPT).select(*SHOWN)


@query("log_append", sql="""
    SELECT seq, username, action, outcome, details FROM (
      SELECT event_id AS seq, concat('user', CAST(user_id AS VARCHAR)) AS username, event_type AS action,
             CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS outcome, props AS details FROM events)
    ORDER BY seq DESC LIMIT 500""")
def _(s: Star):
    audit = s.table("events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("string").alias("timestamp"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("outcome"),
        F.col("props").alias("details"))
    log = JsonLog(s.spark, f"{shared_folder(s.spark, 'audit')}/log", AUDIT)
    for part in (audit.filter("seq % 2 = 0"), audit.filter("seq % 2 = 1")):
        log.append_rows(part)
    return log.newest(reg.KEPT).drop("timestamp")


@query("kpi_sources", sql="""
    SELECT 'dim_customers.csv' AS name, 'published/finance/dim_customers.csv' AS path, true AS analytics_ready, count(*) AS row_count FROM dim_customers
    UNION ALL SELECT 'dim_accounts.csv', NULL, false, 0
    UNION ALL SELECT 'fact_transactions.csv', 'published/finance/fact_transactions.csv', false, count(*) FROM fact_transactions
    UNION ALL SELECT 'fact_loans.csv', 'published/finance/fact_loans.csv', true, count(*) FROM fact_loans
    UNION ALL SELECT 'fact_fraud_alerts.csv', NULL, false, 0""")
def _(s: Star):
    # By hand and unmarked, by hand and marked, published and marked, published and not yet marked, missing.
    zones = zones_with(s, {"fact_transactions.csv": "fact_transactions", "fact_loans.csv": "fact_loans"})
    zones.mark_ready("fact_loans.csv")
    for file, df in (("dim_customers.csv", s.dim_customers), ("dim_accounts.csv", s.dim_accounts)):
        df.write.parquet(zones.processing(file))
        generation = ingest.publish(zones, zones.processing(file), file)
        if file == "dim_customers.csv":
            zones.mark_ready(file, generation=generation)
    listed = zones.kpi_sources(KPI_TABLES).withColumn("path", F.replace("path", F.lit(f"{zones.root}/"), F.lit("")))
    counts = z.union_all([
        zones.scan_gated(n).agg(F.lit(n).alias("name"), F.count("*").alias("row_count")) for n in KPI_TABLES])
    return listed.join(F.broadcast(counts), "name")


@query("retire_dataset", sql="""
    SELECT 'registry' AS what, dataset AS name, count(DISTINCT uploaded_at) AS n FROM dataset_registry WHERE dataset <> 'ds_7' GROUP BY dataset
    UNION ALL SELECT 'registry', 'dim_customers.csv', 1
    UNION ALL SELECT 'rows', 'dim_customers.csv', count(*) FROM dim_customers
    UNION ALL SELECT 'rows', 'fact_loans.csv', 0
    UNION ALL SELECT 'marker', 'dim_customers.csv', 1
    UNION ALL SELECT 'landed', '20240102T030405Z_dim_customers.csv', 1
    UNION ALL SELECT 'removed', 'ds_7', count(DISTINCT uploaded_at) FROM dataset_registry WHERE dataset = 'ds_7'
    UNION ALL SELECT 'removed', 'fact_loans.csv', 2
    UNION ALL SELECT 'not_found', 'nothing.csv', 1""")
def _(s: Star):
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    zones.log.append_rows(_as_registry(s).withColumn("pipeline_status", F.lit("failed")))
    landed(s, zones, "fact_loans.csv", s.fact_loans.filter("loan_status = 'F'"), LANDED_AT - dt.timedelta(days=1))
    landed(s, zones, "fact_loans.csv", s.fact_loans)
    landed(s, zones, "dim_customers.csv", s.dim_customers)
    zones.files.write_marker(zones.marker("fact_loans.csv", "ok"), "2020")
    ingest.process_all(zones, "all")
    facts = []
    for name in ("ds_7", "some/folder/fact_loans.csv", "nothing.csv"):
        done = zones.retire(name)
        facts.append(("removed", done["dataset"], done["removed_entries"]) if done["deleted"] else (done["error"], name, 1))
    facts += [("landed", name, 1) for name in zones.files.names(f"{zones.root}/landing")]
    facts += [("marker", name.removesuffix(".analytics_ready"), 1) for name in zones.files.names(f"{zones.root}/activated")]
    counted = [zones.scan_gated(n).agg(F.lit("rows").alias("what"), F.lit(n).alias("name"), F.count("*").alias("n"))
               for n in ("dim_customers.csv", "fact_loans.csv")]
    listed = zones.registry().groupBy(F.lit("registry").alias("what"), F.col("dataset").alias("name")).agg(F.count("*").alias("n"))
    said = literal_rows(s.spark, facts, "what, name, n").withColumn("n", F.col("n").cast("bigint"))
    return z.union_all([listed, *counted, said])


@query("export_csv", sql="""
    SELECT concat('"', CAST(customer_id AS VARCHAR), '","', replace(concat('a "', full_name, '", b'), '"', '""'),
                  '","', region, '",""') AS line FROM dim_customers""")
def _(s: Star):
    rows = s.dim_customers.select(
        "customer_id", F.concat(F.lit('a "'), "full_name", F.lit('", b')).alias("full_name"), "region",
        F.lit(None).cast("string").alias("note"))
    path = f"{shared_folder(s.spark, 'export')}/customers.csv"
    export_csv(rows, path)
    header = ",".join(f'"{c}"' for c in rows.columns)
    return s.spark.read.text(path).filter(F.col("value") != header).select(F.col("value").alias("line"))


@query("synth_customers", sql="""
    SELECT printf('CUST%05d', i) AS customer_id, concat('Customer ', CAST(i AS VARCHAR)) AS full_name,
           ['Central', 'East', 'West', 'North'][(i - 1) % 4 + 1] AS region FROM (SELECT c_custkey + 1 AS i FROM customer)""")
def _(s: Star):
    return synth.synth_customers(s.table("customer").select((F.col("c_custkey") + 1).alias("i")))


@query("synth_accounts", sql="""
    SELECT printf('ACC%05d', i) AS account_id, printf('CUST%05d', i) AS customer_id,
           CAST(500000 + (i % 1000) * CAST(1000.5 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS current_balance
    FROM (SELECT c_custkey + 1 AS i FROM customer)""")
def _(s: Star):
    return synth.synth_accounts(s.table("customer").select((F.col("c_custkey") + 1).alias("i")))


@query("range_smoke", sql="""
    SELECT count(*) AS range_count, CAST(coalesce(sum(i - 1), 0) AS BIGINT) AS range_sum
    FROM (SELECT row_number() OVER () AS i FROM lineitem)""")
def _(s: Star):
    return synth.range_totals(s.spark, s.table("lineitem").count())
