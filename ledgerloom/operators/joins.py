"""Joins. The many-row side is aggregated to the join key first wherever the result allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import as_money, total
from ledgerloom.operators.aggregates import named_merchants
from ledgerloom.operators.skew import HEAVY_SHARE, heavy_shares, lookup_join, row_hash, slots_of


def merchant_lookup(tx: DataFrame, merchants: DataFrame, seq: str | None = None) -> DataFrame:
    """Every transaction with its merchant name, or the id where there is none."""
    return named_merchants(tx, merchants, seq, many=True)


def alerts_per_transaction(alerts: DataFrame) -> DataFrame:
    """One row per alerted transaction id."""
    return (
        alerts.filter(F.col("transaction_id").isNotNull())
        .groupBy("transaction_id").agg(F.count("*").alias("alert_count"))
    )


def tx_alert_weights(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """Transactions left-joined to alerts, with the fan-out as a number.

    A plain left join would repeat a transaction once per alert. ``row_weight`` says how
    often; sums weighted by it equal sums over the repeated rows, which are never built.
    """
    joined = lookup_join(tx, alerts_per_transaction(alerts), "transaction_id")
    return (
        joined.withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))
        .withColumn("row_weight", F.greatest("alert_count", F.lit(1)))
        .withColumn("is_fraud", F.when(F.col("alert_count") > 0, 1))
    )


def tx_with_alerts(tx: DataFrame, alerts: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Every transaction with each of its alerts (``alert_id``, ``alert_status``), or with nulls.

    An id that holds ``share`` of the transactions or of the alerts is dealt to slots on that side, as
    many as its share asks for; the other side's rows of the id go to each of them. Both
    sides are read once for the join, after a narrow pass over their ids.
    """
    digest = F.xxhash64("transaction_id")
    alerts = alerts.filter("transaction_id IS NOT NULL").select("transaction_id", "alert_id", "alert_status", F.lit(True).alias("_hit"))
    of_tx, of_alerts = (slots_of(digest, heavy_shares(df, digest, share)) for df in (tx, alerts))

    def own(df: DataFrame, slots: Column) -> Column:
        return F.pmod(row_hash(df), slots).cast("int")

    def every(slots: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), slots - 1))

    left = tx.withColumn("_tx_slot", own(tx, of_tx)).withColumn("_alert_slot", every(of_alerts))
    right = alerts.withColumn("_alert_slot", own(alerts, of_alerts)).withColumn("_tx_slot", every(of_tx))
    joined = left.join(right, ["transaction_id", "_tx_slot", "_alert_slot"], "left")
    # A transaction that was sent to several slots of alerts found none in some of them. It has alerts
    # in others, unless only the hash of its id is that of a heavy one.
    heavy = [r[0] for r in alerts.filter(of_alerts > 1).select("transaction_id").distinct().toLocalIterator()]
    alerted = F.col("transaction_id").isin(heavy) if heavy else F.lit(False)
    spare = F.col("_hit").isNull() & F.when(F.coalesce(alerted, F.lit(False)), True).otherwise(F.col("_alert_slot") > 0)
    return joined.filter(~spare).select(*tx.columns, "alert_id", "alert_status")


def loans_per_customer(loans: DataFrame) -> DataFrame:
    return (
        loans.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id").agg(F.count("*").alias("loan_count"))
    )


def preagg_loans(customers: DataFrame, loans: DataFrame, many: bool = True) -> DataFrame:
    """Add the loan count of each customer, 0 without loans.

    ``many`` says that ``customers`` may hold many rows per customer.
    """
    counts = loans_per_customer(loans)
    joined = (
        lookup_join(customers, counts, "customer_id") if many
        else customers.join(counts, "customer_id", "left")
    )
    return joined.withColumn("loan_count", F.coalesce("loan_count", F.lit(0)))


def _per_key(children: DataFrame, key: str, counted: str) -> DataFrame:
    return (
        children.filter(F.col(key).isNotNull())
        .groupBy(key).agg(F.count(counted).alias("_n"))
    )


def inner_merchant_totals(tx: DataFrame, merchants: DataFrame, k: int = 15) -> DataFrame:
    """Transactions per named merchant, count and sum; transactions merge before the join."""
    per_id = (
        tx.filter(F.col("merchant_id").isNotNull()).groupBy("merchant_id")
        .agg(F.count("transaction_id").alias("n"), total(as_money(tx, "amount")).alias("s"))
    )
    named = lookup_join(merchants.select("merchant_id", "merchant_name"), per_id, "merchant_id")
    return (
        named.filter("n IS NOT NULL").groupBy("merchant_id", "merchant_name")
        .agg(F.sum("n").alias("txn_count"), F.sum("s").cast("decimal(38,2)").alias("total_amount_ugx"))
        .orderBy(F.desc("txn_count"), "merchant_id", "merchant_name").limit(k)
        .select("merchant_name", "txn_count", "total_amount_ugx")
    )


def accounts_per_customer(customers: DataFrame, accounts: DataFrame, k: int = 25) -> DataFrame:
    """Customers with their account count, 0 without accounts; most accounts first."""
    counts = _per_key(accounts, "customer_id", "account_id")
    return (
        lookup_join(customers.select("customer_id", "full_name"), counts, "customer_id")
        .groupBy("customer_id", "full_name")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("account_count"))
        .orderBy(F.desc("account_count"), "customer_id", "full_name").limit(k)
    )


def alerted_customers(customers: DataFrame, alerts: DataFrame, k: int = 20) -> DataFrame:
    """Customers with at least one alert; ``HAVING count > 0`` makes this an inner join."""
    counts = _per_key(alerts, "customer_id", "alert_id").filter("_n > 0")
    alerted = lookup_join(customers.select("customer_id", "full_name"), counts, "customer_id")
    return (
        alerted.filter("_n > 0")
        .groupBy("customer_id", "full_name").agg(F.sum("_n").alias("alert_count"))
        .orderBy(F.desc("alert_count"), "customer_id", "full_name").limit(k)
    )


def account_holders(customers: DataFrame, accounts: DataFrame, k: int = 15) -> DataFrame:
    """Customer names by account count (a staged aggregate, then an inner join)."""
    counts = (
        accounts.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id").agg(F.count("*").alias("account_count"))
    )
    held = lookup_join(customers.select("customer_id", "full_name"), counts, "customer_id")
    return (
        held.filter("account_count IS NOT NULL")
        .orderBy(F.desc("account_count"), "customer_id", "full_name").limit(k)
        .select("full_name", "account_count")
    )


def high_value_customers(
    customers: DataFrame, tx: DataFrame, loans: DataFrame, k: int = 50
) -> DataFrame:
    """Customers with transaction and loan totals, both pre-aggregated per customer."""
    spent = tx.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        total(as_money(tx, "amount")).alias("total_tx_ugx")
    )
    lent = loans.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        total(as_money(loans, "principal_amount")).alias("total_loans_ugx")
    )
    zero = F.lit(0).cast("decimal(38,2)")
    named = customers.select("customer_id", "full_name", "region")
    return (
        lookup_join(named, [spent, lent], "customer_id")
        .withColumn("total_tx_ugx", F.coalesce("total_tx_ugx", zero))
        .withColumn("total_loans_ugx", F.coalesce("total_loans_ugx", zero))
        .orderBy(F.desc("total_tx_ugx"), F.desc("total_loans_ugx"), "customer_id").limit(k)
    )


def customer_accounts(customers: DataFrame, accounts: DataFrame, k: int = 20) -> DataFrame:
    """Customer and account ids side by side, in a fixed order so the limit is stable.

    No more than ``k`` customers can appear, so accounts meet only the first ``k`` of
    them by broadcast. Matches cut by the limit sort after all that are kept.
    """
    order = ["customer_id", "full_name", "account_id"]
    first = customers.select("customer_id", "full_name").orderBy("customer_id", "full_name").limit(k)
    matched = (
        accounts.select("customer_id", "account_id").join(F.broadcast(first), "customer_id")
        .select(*order).orderBy(*order).limit(k)
    )
    id_type = accounts.schema["account_id"].dataType
    alone = first.join(matched.select("customer_id").distinct(), "customer_id", "left_anti")
    return matched.unionByName(
        alone.withColumn("account_id", F.lit(None).cast(id_type))
    ).orderBy(*order).limit(k)


def anti_hidden(rows: DataFrame, hidden: DataFrame, key: str = "dataset") -> DataFrame:
    """Rows whose dataset is not in the hide list."""
    listed = hidden.select(key).filter(F.col(key).isNotNull()).distinct()
    flagged = lookup_join(rows, listed.withColumn("_hidden", F.lit(True)), key)
    return flagged.filter(F.col("_hidden").isNull()).select(*rows.columns)


def reconcile_job_status(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Job rows with the state of their orchestrator run folded into the status.

    ``jobs``: job_id, run_id, status, state, message. ``runs``: run_id, new_state (one row
    per run). Jobs without a run, and jobs already settled, stay as they are.
    """
    joined = lookup_join(jobs, runs, "run_id")
    old = F.lower(F.trim(F.coalesce("state", F.lit(""))))
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    settled = old.isin("success", "failed") & status.isin("completed", "failed")
    state = F.when(~settled, F.nullif(F.col("new_state"), F.lit("")))
    success = state == "success"
    failed = state.isin("failed", "upstream_failed")
    waiting = state.isin("running", "queued", "scheduled")
    target = F.when(success, "completed").when(failed, "failed").when(waiting, "queued")
    said = F.nullif(F.col("message"), F.lit(""))
    changed = F.coalesce(F.col("status"), F.lit("")) != target
    message = (
        F.when(success & changed, F.coalesce(said, F.lit("Run completed successfully.")))
        .when(failed & changed, F.coalesce(said, F.concat(F.lit("Run ended in state: "), state, F.lit("."))))
        .otherwise(F.col("message"))
    )
    return joined.select(
        "job_id", "run_id",
        F.coalesce(target, F.col("status")).alias("status"),
        F.coalesce(state, F.col("state")).alias("state"),
        message.alias("message"),
    )
