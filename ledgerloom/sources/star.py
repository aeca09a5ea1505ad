"""The star schema bound to the driver's Parquet tables (FIXTURES.md, section 3)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import MONEY


class Star:
    """Lazy frames; building one reads Parquet footers only."""

    TABLES = (
        "dim_customers", "dim_accounts", "dim_merchants", "dim_branches",
        "fact_transactions", "fact_fraud_alerts", "fact_loans",
    )

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def fact_transactions(self) -> DataFrame:
        lines = self.table("lineitem")
        orders = self.table("orders")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("transaction_id"),
            F.col("o_orderkey").alias("account_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_suppkey").alias("merchant_id"),
            F.col("l_shipdate").cast("date").alias("transaction_date"),
            F.when(F.col("l_linestatus") == "F", "failed").otherwise("completed").alias("status"),
            F.col("o_orderpriority").alias("channel"),
            F.col("l_returnflag").alias("transaction_type"),
            F.col("l_extendedprice").cast(MONEY).alias("amount"),
        )

    @cached_property
    def fact_fraud_alerts(self) -> DataFrame:
        base = F.col("event_id") - F.col("event_id") % 4
        return self.table("events").filter(F.col("event_type") == "error").select(
            F.col("event_id").alias("alert_id"),
            (base * 10 + 1 + base % 7).cast("bigint").alias("transaction_id"),
            F.col("user_id").alias("customer_id"),
            F.col("event_type").alias("alert_status"),
            F.col("ts").cast("date").alias("alert_date"),
        )

    @cached_property
    def fact_loans(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("loan_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").cast(MONEY).alias("principal_amount"),
            F.col("o_orderstatus").alias("loan_status"),
            F.col("o_orderdate").cast("date").alias("issue_date"),
        )

    @cached_property
    def dim_customers(self) -> DataFrame:
        customer, nation, region = (self.table(t) for t in ("customer", "nation", "region"))
        return (
            customer.join(nation, customer.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("full_name"),
                F.col("r_name").alias("region"),
                F.col("c_mktsegment").alias("customer_segment"),
            )
        )

    @cached_property
    def dim_accounts(self) -> DataFrame:
        return self.table("orders").filter(F.col("o_orderstatus") == "O").select(
            F.col("o_orderkey").alias("account_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").cast(MONEY).alias("current_balance"),
        )

    @cached_property
    def dim_merchants(self) -> DataFrame:
        supplier, nation = self.table("supplier"), self.table("nation")
        return (
            supplier.filter(F.col("s_suppkey") % 10 != 3)
            .join(nation, supplier.s_nationkey == nation.n_nationkey)
            .select(
                F.col("s_suppkey").alias("merchant_id"),
                F.col("s_name").alias("merchant_name"),
                F.col("n_name").alias("district"),
            )
        )

    @cached_property
    def dim_branches(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("branch_id"),
            F.col("n_name").alias("branch_name"),
            F.col("r_name").alias("region"),
        )

    @cached_property
    def registry(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("ds_"), F.col("user_id").cast("string")).alias("dataset"),
            F.when(F.col("user_id") % 2 == 0, "finance").otherwise("external").alias("classification"),
            F.col("ts").alias("uploaded_at"),
            F.when(kind == "signup", "landed").when(kind == "purchase", "analytics_ready")
            .when(kind == "error", "failed").alias("pipeline_status"),
            F.when(kind == "signup", "landed").when(kind == "error", "failed")
            .otherwise("success").alias("status"),
            F.floor("value").cast("bigint").alias("row_count"),
        )

    def frames(self, *names: str) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in names or self.TABLES}
