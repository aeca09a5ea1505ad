from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators import joins, skew
from ledgerloom.operators import registry as reg
from ledgerloom.operators.aggregates import top_merchants
from ledgerloom.operators.windows import concentration_top3_of_top10, last_wins, latest_landed, scale_to_max, share_of_total
from ledgerloom.plans import kpi


@pytest.fixture
def no_broadcast(spark):
    """As if no join side were small enough to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


@pytest.fixture(scope="module")
def skewed():
    """Transactions of which a third share one id and some have none, and alerts on them."""
    rnd = random.Random(7)
    tx = [(rnd.choice([None, 1, 1, 1, *range(2, 8)]) if i % 2 else i, f"C{rnd.randrange(9)}",
           Decimal(rnd.randrange(10000)) / 100) for i in range(600)]
    alerts = [(rnd.choice([None, 1, 1, 5, *range(0, 600, 7)]), "open") for _ in range(300)]
    loans = [(rnd.choice([None, *[f"C{n}" for n in range(6)]]), i) for i in range(40)]
    return tx, alerts, loans


def frames(spark, skewed):
    tx, alerts, loans = skewed
    return (
        spark.createDataFrame(tx, "transaction_id bigint, customer_id string, amount decimal(18,2)"),
        spark.createDataFrame(alerts, "transaction_id bigint, alert_status string"),
        spark.createDataFrame(loans, "customer_id string, loan_id bigint"),
    )


def naive_risk(skewed):
    """The fan-out built row by row."""
    tx, alerts, loans = skewed
    found = Counter(a for a, _ in alerts if a is not None)
    lent = Counter(c for c, _ in loans if c is not None)
    out = defaultdict(lambda: [0, Decimal(0), 0])
    for tid, cust, amount in tx:
        hits = found.get(tid, 0)
        for copy in range(max(1, hits)):
            out[cust][0] += 1
            out[cust][1] += amount
            out[cust][2] += copy < hits
    return {c: (*v, lent.get(c, 0)) for c, v in out.items()}


def test_customer_risk_counts_the_fan_out(spark, skewed):
    got = {r[0]: tuple(r)[1:] for r in kpi.kpi_customer_risk(*frames(spark, skewed)).collect()}
    assert got == naive_risk(skewed)


def test_customer_risk_without_broadcast(spark, skewed, no_broadcast):
    got = {r[0]: tuple(r)[1:] for r in kpi.kpi_customer_risk(*frames(spark, skewed)).collect()}
    assert got == naive_risk(skewed)


def test_dedup_variant_counts_each_row_once(spark, skewed):
    tx, alerts, _ = skewed
    hit = {a for a, _ in alerts if a is not None}
    want = defaultdict(lambda: [0, 0])
    for tid, cust, _ in tx:
        want[cust][0] += 1
        want[cust][1] += tid in hit
    got = kpi.kpi_customer_risk_dedup(*frames(spark, skewed)).collect()
    assert {r.customer_id: [r.transaction_count, r.fraud_alert_count] for r in got} == dict(want)


@pytest.mark.parametrize("share", [0.02, 0.1])
def test_lookup_join_equals_left_join(spark, skewed, no_broadcast, share):
    tx, alerts, _ = frames(spark, skewed)
    right = joins.alerts_per_transaction(alerts)
    assert skew.heavy_hashes(tx, F.xxhash64("transaction_id"), share)
    got = skew.lookup_join(tx, right, "transaction_id", share)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = tx.join(right, "transaction_id", "left")
    assert Counter(rows(got)) == Counter(rows(want))
    assert plan.count("SortMergeJoin") == 1 and "Union" not in plan  # the left side is read once for the join


def test_several_lookups_move_the_left_side_once(spark, skewed, no_broadcast):
    tx, alerts, _ = frames(spark, skewed)
    counts = joins.alerts_per_transaction(alerts)
    other = alerts.filter("transaction_id IS NOT NULL").groupBy("transaction_id").agg(F.max("alert_status").alias("s"))
    got = skew.lookup_join(tx, [counts, other], "transaction_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line and "_slot" in line]
    want = tx.join(counts, "transaction_id", "left").join(other, "transaction_id", "left")
    assert Counter(rows(got)) == Counter(rows(want)) and got.columns == want.columns
    assert plan.count("SortMergeJoin") == 2 and len(moved) == 3  # the left side and the two others


def test_slots_follow_the_share(spark):
    shares = {5: 1 / 3, 7: 0.02, 9: 0.0201}
    got = {r.h: r.n for r in spark.createDataFrame([(5,), (7,), (9,), (11,)], "h long").select("h", skew.slots_of(F.col("h"), shares).alias("n")).collect()}
    assert got == {5: 34, 7: 2, 9: 3, 11: 1}


@pytest.fixture
def apart(spark):
    """Partitions as they were dealt, not put together because they are small."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("tx_heavy,alerts_heavy", [(True, False), (False, True), (True, True), (False, False)])
def test_ids_heavy_on_either_side_are_spread(spark, no_broadcast, apart, tx_heavy, alerts_heavy):
    from ledgerloom.operators.joins import tx_with_alerts

    tx = spark.range(3000).select(F.when((F.col("id") % 3 == 0) & F.lit(tx_heavy), 1).otherwise(F.col("id") % 400).alias("transaction_id"), F.col("id").alias("n"))
    alerts = spark.range(300).select(
        F.when((F.col("id") % 3 == 0) & F.lit(alerts_heavy), 2).when((F.col("id") % 7 == 0) & F.lit(tx_heavy), 1).otherwise(F.col("id") % 90 * 5).alias("transaction_id"),
        F.col("id").alias("alert_id"), F.lit("open").alias("alert_status"))
    tx = tx.unionByName(spark.createDataFrame([(None, -1), (None, -2), (777_777, -3)], "transaction_id long, n long"))
    alerts = alerts.unionByName(spark.createDataFrame([(None, -1, "x")], "transaction_id long, alert_id long, alert_status string"))
    got = tx_with_alerts(tx, alerts)
    assert Counter(rows(got)) == Counter(rows(tx.join(alerts, "transaction_id", "left")))
    heavy = got.filter("transaction_id IN (1, 2)")
    parts = heavy.groupBy("transaction_id", F.spark_partition_id().alias("p")).count().collect()
    spread = {i: len([r for r in parts if r.transaction_id == i]) for i in (1, 2)}
    if tx_heavy:
        assert spread[1] > 1
    if alerts_heavy:
        assert spread[2] > 1


def test_lookup_join_on_two_keys_with_nulls(spark, no_broadcast):
    left = spark.createDataFrame([("a", 1)] * 20 + [("b", None)] * 10 + [(None, None)] * 10 + [("c", 3)],
                                 "k string, n int")
    right = spark.createDataFrame([("a", 1, "x"), ("c", 3, "y"), ("b", 2, "z")], "k string, n int, v string")
    got = Counter(rows(skew.lookup_join(left, right, ["k", "n"], 0.1)))
    assert got == Counter(rows(left.join(right, ["k", "n"], "left")))


def test_heavy_hashes_are_bounded(spark):
    df = spark.range(5000).select(F.col("id") % 40)
    assert len(skew.heavy_hashes(df, F.xxhash64("(id % 40)"), 0.02)) <= 50


def test_no_heavy_key_means_one_plain_join(spark, no_broadcast):
    left = spark.range(1000).withColumnRenamed("id", "k")
    right = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    got = skew.lookup_join(left, right, "k")
    assert got.filter("v = 1").count() == 500 and got.count() == 1000


def test_top_merchants_names_ties_and_bad_amounts(spark):
    tx = spark.createDataFrame(
        [("m1", "10.9"), ("m1", "bad"), ("m2", "5.5"), ("m2", "-0.9"), ("m3", "1"), ("", "9"), (None, "9"), ("m4", "8")],
        "merchant_id string, amount string")
    dims = spark.createDataFrame(
        [(1, "m1", "old"), (2, "m2", "two"), (3, "m1", "new")], "seq int, merchant_id string, merchant_name string")
    assert rows(top_merchants(tx, dims, 4, "seq")) == [
        ("m1", "new", 2, 10), ("m2", "two", 2, 5), ("m4", "m4", 1, 8), ("m3", "m3", 1, 1)]
    assert top_merchants(tx, dims, 99, "seq").count() == 4
    assert top_merchants(tx, dims, 0, "seq").count() == 1


def test_curated_merchants_repeat_for_duplicate_names(spark):
    tx = spark.createDataFrame([("m1", "1.005"), ("m2", "2")], "merchant_id string, amount string")
    dims = spark.createDataFrame([("m1", "a"), ("m1", "b")], "merchant_id string, merchant_name string")
    got = kpi.kpi_top_merchants(tx, dims).select("merchant_id", "merchant_name", "transaction_count")
    assert sorted(rows(got), key=str) == [("m1", "a", 1), ("m1", "b", 1), ("m2", None, 1)]


def test_join_project_left_keeps_customers_without_accounts(spark):
    customers = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "customer_id int, full_name string")
    accounts = spark.createDataFrame([(10, 2), (11, 2), (12, 9)], "account_id int, customer_id int")
    want = [(1, "a", None), (2, "b", 10), (2, "b", 10), (2, "b", 11), (2, "b", 11), (3, "c", None)]
    assert rows(joins.customer_accounts(customers, accounts)) == want
    for k in range(1, 6):
        assert rows(joins.customer_accounts(customers, accounts, k)) == want[:k]


def test_account_counts_include_zero(spark):
    customers = spark.createDataFrame([(1, "a"), (2, "b")], "customer_id int, full_name string")
    accounts = spark.createDataFrame([(10, 2), (11, 2), (None, 2), (12, None)], "account_id int, customer_id int")
    assert rows(joins.accounts_per_customer(customers, accounts)) == [(2, "b", 2), (1, "a", 0)]


def test_anti_hidden_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "dataset string")
    hidden = spark.createDataFrame([("a",), ("a",), (None,)], "dataset string")
    assert sorted(rows(joins.anti_hidden(df, hidden)), key=str) == [("b",), (None,)]


def test_reconcile(spark):
    jobs = spark.createDataFrame([
        (1, "r1", "queued", "queued", None), (2, "r2", "queued", "running", "kept"), (3, "r3", "completed", "success", None),
        (4, None, "queued", None, None), (5, "r5", "completed", "running", None), (6, "r6", "queued", "queued", None)],
        "job_id int, run_id string, status string, state string, message string")
    runs = spark.createDataFrame(
        [("r1", "success"), ("r2", "failed"), ("r3", "failed"), ("r5", "scheduled"), ("r6", "odd")],
        "run_id string, new_state string")
    assert rows(joins.reconcile_job_status(jobs, runs).orderBy("job_id")) == [
        (1, "r1", "completed", "success", "Run completed successfully."), (2, "r2", "failed", "failed", "kept"),
        (3, "r3", "completed", "success", None), (4, None, "queued", None, None),
        (5, "r5", "queued", "scheduled", None), (6, "r6", "queued", "odd", None)]


def test_registry_update_touches_the_newest_row_only(spark):
    registry = spark.createDataFrame(
        [(1, "t", "d", "landed", 5), (2, "t", "d", "landed", 6), (3, "u", "d", "landed", 7)],
        "seq bigint, uploaded_at string, dataset string, pipeline_status string, row_count bigint")
    updates = spark.createDataFrame([("t", "d", "ready", None), ("x", "d", "ready", 1)],
                                    "uploaded_at string, dataset string, pipeline_status string, row_count bigint")
    assert rows(reg.registry_update(registry, updates).orderBy("seq")) == [
        (1, "t", "d", "landed", 5), (2, "t", "d", "ready", 6), (3, "u", "d", "landed", 7)]


def test_latest_landed_ties_and_last_wins(spark):
    registry = spark.createDataFrame(
        [(1, "d", "t1", "landed"), (2, "d", "t2", "landed"), (3, "d", "t2", "landed"), (4, "d", "t9", "failed"),
         (5, "", "t1", "landed"), (6, "e", None, "landed")],
        "seq bigint, dataset string, uploaded_at string, pipeline_status string")
    assert sorted(rows(latest_landed(registry).select("dataset", "seq"))) == [("d", 3), ("e", 6)]
    assert sorted(rows(last_wins(registry, "dataset", "pipeline_status", "seq"))) == [
        ("", "landed"), ("d", "failed"), ("e", "landed")]


def test_shares_and_concentration_edge_cases(spark):
    zero = spark.createDataFrame([(0, "a", 0.0), (1, "b", 0.0)], "ord int, label string, value double")
    assert [r.share for r in share_of_total(zero).collect()] == [0.0, 0.0]
    small = spark.createDataFrame([(0, "a", 0.5)], "ord int, label string, value double")
    assert scale_to_max(small).first().scaled == 0.5
    none = spark.createDataFrame([("m", Decimal(0))], "merchant_id string, total_amount_ugx decimal(18,2)")
    assert concentration_top3_of_top10(none).first()[0] is None


def test_uploads_by_day_and_mix_on_text(spark):
    registry = spark.createDataFrame(
        [("2024-01-02T03:04:05+00:00", "landed"), ("2024-01-02T09:00:00+00:00", ""), ("2024-02-01T00:00:00+00:00", None),
         ("", "landed"), (None, "failed")], "uploaded_at string, pipeline_status string")
    assert rows(reg.uploads_by_day(registry, 14)) == [("2024-01-02", 2.0), ("2024-02-01", 1.0)]
    assert rows(reg.uploads_by_day(registry, 1)) == [("2024-02-01", 1.0)]
    assert dict(rows(reg.status_mix(registry))) == {"landed": 2.0, "unknown": 2.0, "failed": 1.0}


def test_ready_times_prefer_the_newer_marker(spark):
    marks = spark.createDataFrame(
        [("a", "ok", "2"), ("a", "analytics_ready", "1"), ("b", "ok", "3"), ("c", None, "9")],
        "dataset string, kind string, stamp string")
    assert sorted(rows(reg.ready_times(marks))) == [("a", "1"), ("b", "3")]


def test_transactions_keep_every_alert_with_heavy_ids(spark):
    from ledgerloom.operators.joins import tx_with_alerts

    tx = spark.createDataFrame([(1, i) for i in range(60)] + [(None, -1), (2, 100), (3, 101)], "transaction_id long, n long")
    alerts = spark.createDataFrame([(1, 7, "a"), (1, 8, "b"), (2, 9, None), (None, 5, "x")], "transaction_id long, alert_id long, alert_status string")
    got = tx_with_alerts(tx, alerts).collect()
    want = [(1, i, a, s) for i in range(60) for a, s in ((7, "a"), (8, "b"))] + [(None, -1, None, None), (2, 100, 9, None), (3, 101, None, None)]
    assert sorted(map(str, ((r.transaction_id, r.n, r.alert_id, r.alert_status) for r in got))) == sorted(map(str, want))
