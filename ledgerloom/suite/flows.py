"""Multi-step dataflows and scalar-function coverage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import numbers as num
from ledgerloom.functions import text as txt
from ledgerloom.plans import ingest
from ledgerloom.plans.examples import EXAMPLES, TABLES
from ledgerloom.session import shared_folder
from ledgerloom.sources import zones as z
from ledgerloom.suite.aggregates import LOAN_COLUMNS, _range_sql
from ledgerloom.suite.core import SQL_WHITESPACE, Star, query
from ledgerloom.suite.predicates import workspace
from ledgerloom.suite.sources import LANDED_AT, landed


@query("process_landing", "fn_nested", sql=" UNION ALL ".join(
    f"SELECT 'fact_loans.csv' AS dataset, 'analytics_ready' AS pipeline_status, 'success' AS status, n.row_count, "
    f"CAST(3 AS INTEGER) AS stage_count, CAST(5 AS INTEGER) AS column_count, '{c}' AS \"column\", "
    f"CAST(0 AS BIGINT) AS null_count, r.min, r.max FROM (SELECT count(*) AS row_count FROM fact_loans) n "
    f"LEFT JOIN ({_range_sql(c) if i < 3 else 'SELECT 0.0 AS min, 0.0 AS max LIMIT 0'}) r ON true"
    for i, c in enumerate(LOAN_COLUMNS)))
def _(s: Star):
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    entry = landed(s, zones, "fact_loans.csv", s.fact_loans)
    done = ingest.process_landing(zones, entry["dataset"], entry["landing_file"], entry["uploaded_at"])
    zones.record(**done)
    numbers = F.try_element_at("insights.numeric_summary", F.col("column"))
    return zones.registry().withColumn("column", F.explode("insights.columns")).select(
        "dataset", "pipeline_status", "status", "row_count", F.size("stages").alias("stage_count"),
        F.size("insights.columns").alias("column_count"), "column",
        F.element_at("insights.null_counts", F.col("column")).alias("null_count"),
        numbers["min"].alias("min"), numbers["max"].alias("max"))


TYPED_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, 'analytics_ready' AS pipeline_status, '{column}' AS \"column\", count(*) AS row_count, "
    f"CAST(count_if({missing}) AS BIGINT) AS null_count, {low} AS min, {high} AS max FROM (SELECT *, trim(text, {SQL_WHITESPACE}) AS t FROM conversations)"
    for name in ("talks.parquet", "talks.jsonl")
    for column, missing, low, high in [
        ("conv_id", "conv_id IS NULL", "CAST(min(conv_id) AS DOUBLE)", "CAST(max(conv_id) AS DOUBLE)"),
        ("said.by.role", "coalesce(role, '') = ''", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
        ("said.turn", "turn IS NULL", "CAST(min(turn) AS DOUBLE)", "CAST(max(turn) AS DOUBLE)"),
        ("said.text", "coalesce(t, '') = ''", "min(try_cast(t AS DOUBLE))", "max(try_cast(t AS DOUBLE))"),
        ("words", "len([x FOR x IN string_split(coalesce(t, ''), ' ') IF x <> '']) = 0", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")])


@query("process_landing_typed", sql=TYPED_SQL)
def _(s: Star):
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    text = txt.strip(F.col("text"))
    talks = s.table("conversations").select(
        "conv_id", F.struct(F.struct("role").alias("by"), "turn", F.concat(F.lit(" "), "text", F.lit("\t")).alias("text")).alias("said"),
        F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda x: x != "").alias("words"))
    for name, write in (("talks.parquet", talks.write.parquet), ("talks.jsonl", talks.write.json)):
        write(f"{zones.root}/incoming/{name}")
        zones.land(f"{zones.root}/incoming/{name}", name, LANDED_AT)
    ingest.process_all(zones, "all")
    numbers = F.try_element_at("insights.numeric_summary", F.col("column"))
    return zones.registry().withColumn("column", F.explode("insights.columns")).select(
        "dataset", "pipeline_status", "column", "row_count", F.element_at("insights.null_counts", F.col("column")).alias("null_count"),
        numbers["min"].alias("min"), numbers["max"].alias("max"))


@query("process_all", sql="""
    SELECT 'dim_customers.csv' AS dataset, 'analytics_ready' AS pipeline_status, count(*) AS row_count FROM dim_customers
    UNION ALL SELECT 'fact_loans.csv', 'analytics_ready', count(*) FROM fact_loans
    UNION ALL SELECT 'fact_loans.csv', 'superseded', NULL
    UNION ALL SELECT 'dim_accounts.csv', 'failed', NULL
    UNION ALL SELECT 'chats.csv', 'analytics_ready', count(*) FROM conversations""")
def _(s: Star):
    zones = z.Zones(s.spark, shared_folder(s.spark, "zones"))
    earlier = LANDED_AT - dt.timedelta(days=1)
    landed(s, zones, "fact_loans.csv", s.fact_loans.filter("loan_status = 'F'"), earlier)
    landed(s, zones, "fact_loans.csv", s.fact_loans)
    landed(s, zones, "dim_customers.csv", s.dim_customers)
    landed(s, zones, "dim_accounts.csv", s.dim_accounts.drop("account_id"))
    landed(s, zones, "chats.csv", s.table("conversations"))
    ingest.process_all(zones, "all")
    return zones.registry().select("dataset", "pipeline_status", "row_count")


@query("validate_examples", sql=" UNION ALL ".join(
    f"SELECT '{name}' AS example, true AS ok, count(*) AS row_count FROM ({sql})"
    for name, sql in EXAMPLES.items()).replace(" AS REAL)", " AS DOUBLE)").replace(" AS TEXT)", " AS VARCHAR)"))
def _(s: Star):
    return workspace(s, *TABLES).validate(EXAMPLES).drop("error")


@query("fn_text", sql="""
    SELECT doc_id, lower(source) AS lowered, substr(text, 1, 24) AS cut, contains(lower(text), 'the') AS has_the,
           regexp_replace(lower(source), '[^a-z]+', '', 'g') AS letters, concat(lang, ' ', source) AS joined,
           printf('%05d', doc_id) AS padded, coalesce(nullif(trim(lang), 'en'), 'unknown') AS lang_or FROM documents""")
def _(s: Star):
    return s.table("documents").select(
        "doc_id", F.lower("source").alias("lowered"), txt.cut(F.col("text"), 24).alias("cut"),
        txt.contains_text(F.col("text"), "THE").alias("has_the"),
        F.regexp_replace(F.lower("source"), "[^a-z]+", "").alias("letters"),
        F.concat_ws(" ", "lang", "source").alias("joined"), F.format_string("%05d", "doc_id").alias("padded"),
        F.coalesce(F.nullif(F.trim("lang"), F.lit("en")), F.lit("unknown")).alias("lang_or"))


@query("fn_numbers", sql="""
    SELECT event_id, CAST(trunc(value) AS BIGINT) AS whole, round(value, 1) AS rounded,
           CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) AS printed, event_id % 7 AS modulo,
           least(greatest(value, 10.0), 100.0) AS clamped, value / nullif(event_id % 5, 0) AS ratio,
           CAST(epoch_us(ts) // 1000 AS DOUBLE) / 1000.0 AS seconds FROM events""")
def _(s: Star):
    value = F.col("value")
    return s.table("events").select(
        "event_id", value.cast("bigint").alias("whole"), F.round("value", 1).alias("rounded"),
        num.whole_text(value).alias("printed"), F.pmod("event_id", F.lit(7)).alias("modulo"),
        F.least(F.greatest(value, F.lit(10.0)), F.lit(100.0)).alias("clamped"),
        F.try_divide(value, F.col("event_id") % 5).alias("ratio"), (F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0).alias("seconds"))


@query("fn_dates", sql="""
    SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) - 30 AS month_ago, substr(CAST(ts AS VARCHAR), 1, 10) AS label,
           strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events""")
def _(s: Star):
    return s.table("events").select(
        "event_id", F.to_date("ts").alias("day"), F.date_sub(F.to_date("ts"), 30).alias("month_ago"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("label"),
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


@query("fn_json", sql="SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def _(s: Star):
    return s.table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
