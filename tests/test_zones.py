from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators.synth import index_range, range_smoke, synth_accounts, synth_customers
from ledgerloom.plans import curate
from ledgerloom.plans.ingest import process_all
from ledgerloom.sources.zones import Zones, registry_read, require_inputs
from ledgerloom.streaming.landing import process_new_landings

DAY = dt.datetime(2024, 5, 1, 12, 0, 0, tzinfo=dt.timezone.utc)
LOANS = "loan_id,customer_id,principal_amount\n 1 ,C1,5\n2,C2,\n3,\"C\n3\",abc\n"


@pytest.fixture
def zones(spark, folder):
    return Zones(spark, f"{folder.root}/zones")


def land(zones, folder, name, text, when=DAY):
    return zones.land(folder(f"in/{name}", text), name, when)


def statuses(zones):
    return sorted((r.dataset, r.pipeline_status, r.status) for r in zones.registry().collect())


def test_land_process_publish(zones, folder):
    entry = land(zones, folder, "fact_loans.csv", LOANS)
    assert entry["landing_file"] == "20240501T120000Z_fact_loans.csv"
    assert statuses(zones) == [("fact_loans.csv", "landed", "landed")]
    done = process_all(zones, "single", "some/folder/fact_loans.csv")
    assert done["errors"] == [] and done["processed"][0]["payload"]["row_count"] == 3
    assert rows(zones.scan_gated("fact_loans.csv").orderBy("loan_id")) == [
        ("1", "C1", "5"), ("2", "C2", ""), ("3", "C\n3", "abc")]
    row = zones.registry().first()
    assert (row.pipeline_status, row.classification, row.row_count) == ("analytics_ready", "finance", 3)
    assert [s.stage for s in row.stages] == ["processing_stage", "result_stage", "analytics_ready_stage"]
    assert row.insights.null_counts == {"loan_id": 0, "customer_id": 0, "principal_amount": 1}
    assert {k: tuple(v) for k, v in row.insights.numeric_summary.items()} == {
        "loan_id": (1.0, 3.0, 2.0), "principal_amount": (5.0, 5.0, 5.0)}
    assert zones.is_ready("fact_loans.csv")
    assert zones.files.names(f"{zones.root}/processing") == []


@pytest.mark.parametrize("name,text,error", [
    ("fact_loans.csv", "loan_id,customer_id\n1,2\n", "Required columns are missing: principal_amount"),
    ("dim_cards.csv", "x\n1\n", "Required columns are missing: card_id, account_id, customer_id"),
    ("other.csv", "a,b\n", "no rows"),
    ("other.csv", "a,b\n1,2\n1,2,3\n", "more fields than the header"),
])
def test_bad_files_are_recorded_and_not_published(zones, folder, name, text, error):
    land(zones, folder, name, text)
    done = process_all(zones, "all")
    assert error in done["errors"][0]
    row = zones.registry().first()
    assert (row.pipeline_status, row.status) == ("failed", "failed") and error in row.error
    assert not zones.files.exists(zones.published(name)) and not zones.is_ready(name)


def test_empty_upload_fails_on_landing(zones, folder):
    entry = land(zones, folder, "x.csv", "")
    assert (entry["status"], entry["error"]) == ("failed", "The uploaded file has no content.")
    assert zones.files.names(f"{zones.root}/failed") == ["20240501T120000Z_x.csv"]


def test_other_datasets_go_on_and_older_landings_never_win(zones, folder):
    land(zones, folder, "a.csv", "k\nold\n", DAY)
    land(zones, folder, "a.csv", "k\nnew\n", DAY + dt.timedelta(hours=1))
    land(zones, folder, "fact_loans.csv", "bad\n1\n")
    done = process_all(zones, "all")
    assert len(done["errors"]) == 1
    assert rows(zones.scan_gated("a.csv")) == [("new",)]
    assert statuses(zones) == [("a.csv", "analytics_ready", "success"), ("a.csv", "superseded", "landed"),
                               ("fact_loans.csv", "failed", "failed")]
    assert process_all(zones, "all")["error"] == "nothing_pending"


def test_error_codes(zones):
    assert process_all(zones, "some")["error"] == "invalid_mode"
    assert process_all(zones)["error"] == "dataset_required"
    assert process_all(zones, "single", "x.csv")["error"] == "not_found"
    assert process_all(zones, " ALL ")["error"] == "nothing_pending"


def test_missing_landing_file(zones, folder):
    entry = land(zones, folder, "a.csv", "k\n1\n")
    zones.files.remove(zones.landing(entry["landing_file"]))
    assert "landed file is gone" in process_all(zones, "all")["errors"][0]


def test_preview_order_and_bounds(zones, folder):
    with pytest.raises(ValueError, match="No stored copy"):
        zones.preview("a.csv")
    land(zones, folder, "a.csv", "k\n" + "\n".join(map(str, range(300))) + "\n")
    assert zones.preview("x/a.csv", 9999).count() == 200
    assert zones.preview("a.csv", 0).count() == 1
    process_all(zones, "all")
    assert rows(zones.preview("a.csv", 3, F.col("k").cast("int"))) == [("0",), ("1",), ("2",)]


def test_gate(zones, folder):
    assert zones.scan_gated("fact_loans.csv").count() == 0
    folder("zones/published/finance/fact_loans.csv", "loan_id\n1\n")
    assert zones.scan_gated("fact_loans.csv").count() == 1
    assert zones.scan_gated("fact_loans.csv", strict=True).count() == 0
    zones.mark_ready("fact_loans.csv")
    assert zones.scan_gated("fact_loans.csv", strict=True).count() == 1
    folder("zones/published/finance/dim_branches.csv", "branch_id\n1\n")
    assert zones.scan_gated("dim_branches.csv", strict=True).count() == 1
    folder("zones/published/finance/dim_accounts.csv", "")
    assert zones.scan_gated("dim_accounts.csv").columns == ["account_id", "customer_id"]


def test_legacy_markers(zones, folder):
    folder("zones/activated/fact_loans.csv.ok", "2020")
    folder("zones/activated/dim_accounts.csv.ok", "2020")
    folder("zones/activated/dim_accounts.csv.analytics_ready", "2021")
    folder("zones/activated/unknown.csv.ok", "2020")
    assert zones.migrate_ok() == ["fact_loans.csv"]
    assert zones.files.read_marker(zones.marker("fact_loans.csv")) == "2020"
    assert zones.files.read_marker(zones.marker("dim_accounts.csv")) == "2021"


def test_retire(zones, folder):
    assert zones.retire("a.csv")["error"] == "not_found"
    land(zones, folder, "a.csv", "k\n1\n")
    land(zones, folder, "a.csv", "k\n2\n", DAY + dt.timedelta(days=1))
    land(zones, folder, "b.csv", "k\n3\n")
    process_all(zones, "all")
    assert zones.retire("/tmp/a.csv") == {"deleted": True, "dataset": "a.csv", "removed_entries": 2}
    assert statuses(zones) == [("b.csv", "analytics_ready", "success")]
    assert not zones.files.exists(zones.published("a.csv")) and not zones.is_ready("a.csv")


def test_compact_keeps_the_registry(zones, folder):
    land(zones, folder, "a.csv", "k\n1\n")
    process_all(zones, "all")
    before = rows(zones.registry())
    zones.compact()
    assert rows(zones.registry()) == before
    land(zones, folder, "b.csv", "k\n1\n")
    assert statuses(zones) == [("a.csv", "analytics_ready", "success"), ("b.csv", "landed", "landed")]


def test_registry_read_forms(spark, folder):
    array = folder("a.json", '[{"dataset": "x", "row_count": 3, "stages": [{"stage": "s"}]}, {"dataset": "y"}]')
    lines = folder("l.json", '{"dataset": "x"}\n{"dataset": "y", "unknown": 1}\n')
    broken = folder("b.json", '[{"dataset": "x"')
    assert [r.dataset for r in registry_read(spark, array).collect()] == ["x", "y"]
    assert [r.dataset for r in registry_read(spark, lines).collect()] == ["x", "y"]
    assert registry_read(spark, broken).count() == 0


def test_stream_processes_each_landing_once(zones, folder):
    checkpoint = f"{folder.root}/checkpoint"
    land(zones, folder, "a.csv", "k\n1\n")
    process_new_landings(zones, checkpoint).awaitTermination()
    assert rows(zones.scan_gated("a.csv")) == [("1",)]
    land(zones, folder, "a.csv", "k\n2\n", DAY + dt.timedelta(days=1))
    land(zones, folder, "b.csv", "k\n3\n")
    process_new_landings(zones, checkpoint).awaitTermination()
    assert rows(zones.scan_gated("a.csv")) == [("2",)] and rows(zones.scan_gated("b.csv")) == [("3",)]
    process_new_landings(zones, checkpoint).awaitTermination()
    assert [s[1] for s in statuses(zones)] == ["analytics_ready"] * 3


TX = ("transaction_id,account_id,customer_id,merchant_id,transaction_date,status,amount\n"
      "t1,a,c1,m1,2024-01-01,failed,10.50\nt2,a,c1,m1,2024-01-02,ok,bad\nt3,a,c2,m2,2024-01-01,ok,1\n")


def job_inputs(folder):
    folder("job/fact_transactions.csv", TX)
    folder("job/fact_fraud_alerts.csv", "alert_id,transaction_id,alert_status\n1,t1,open\n2,t1,shut\n")
    folder("job/fact_loans.csv", "loan_id,customer_id\nl1,c1\n")
    return f"{folder.root}/job"


def test_job_end_to_end_twice(spark, folder):
    job_inputs(folder)
    with pytest.raises(FileNotFoundError, match="dim_merchants.csv"):
        require_inputs(spark, f"{folder.root}/job", list(curate.JOB_COLUMNS))
    folder("job/dim_merchants.csv", "merchant_id,merchant_name\nm1,One\n")
    for _ in range(2):
        tables = curate.curate_and_load(spark, f"{folder.root}/job", f"{folder.root}/out")
    text = {n: sorted(tuple(map(str, r)) for r in t.collect()) for n, t in tables.items()}
    assert text["kpi_daily_transactions"] == [("2024-01-01", "2", "11.50", "1"), ("2024-01-02", "1", "None", "0")]
    assert text["kpi_customer_risk"] == [("c1", "3", "21.00", "2", "1"), ("c2", "1", "1.00", "0", "0")]
    assert text["kpi_top_merchants"] == [("m1", "2", "10.50", "One"), ("m2", "1", "1.00", "None")]
    assert tables["kpi_daily_transactions"].dtypes == [
        ("transaction_date", "date"), ("transaction_count", "bigint"), ("total_amount_ugx", "decimal(18,2)"),
        ("failed_count", "bigint")]


def test_job_names_missing_columns(spark, folder):
    job_inputs(folder)
    folder("job/dim_merchants.csv", "merchant_id\nm1\n")
    with pytest.raises(ValueError, match="dim_merchants: missing columns merchant_name"):
        curate.curate_and_load(spark, f"{folder.root}/job", f"{folder.root}/out")


def test_smoke_and_synthetic_rows(spark):
    assert range_smoke(spark) == (1000, 45)
    assert rows(synth_customers(index_range(spark, 5)).orderBy("customer_id"))[-1] == ("CUST00005", "Customer 5", "Central")
    balances = [str(r.current_balance) for r in synth_accounts(index_range(spark, 1001)).orderBy("account_id").collect()]
    assert balances[0] == "501000.50" and balances[999] == "500000.00" and balances[1000] == "501000.50"


def test_no_merchant_lists_without_merchants(zones, folder):
    from ledgerloom.operators.aggregates import top_merchants
    from ledgerloom.plans.dashboard import dashboard_charts

    land(zones, folder, "fact_transactions.csv", TX)
    process_all(zones, "all")
    frames = zones.star_frames()
    assert top_merchants(frames["fact_transactions"], frames["dim_merchants"]).count() == 0
    keys = {r.key: r.value for r in dashboard_charts(frames, zones.registry()).collect()}
    assert "merchants_txn" not in keys and keys["txn_amount_bins"] is not None


def test_published_rows_can_be_loaded_as_a_table(spark, zones, folder):
    land(zones, folder, "My Sales.csv", "id,day,amount\n1,2024-01-02, 3.5 \n2,,4\n")
    land(zones, folder, "b.csv", "k\n1\n")
    done = process_all(zones, "single", "My Sales.csv", database="default")
    assert [s[:2] for s in done["processed"][0]["payload"]["stages"]] == [
        ("processing_stage", "passed"), ("result_stage", "passed"), ("warehouse_stage", "passed"),
        ("analytics_ready_stage", "passed")]
    assert spark.table("default.my_sales").dtypes == [("id", "bigint"), ("day", "date"), ("amount", "double")]
    done = process_all(zones, "all", database="nowhere")
    assert done["errors"] == [] and ("warehouse_stage", "failed") in [
        s[:2] for s in done["processed"][0]["payload"]["stages"]]


def test_uploads_feed_dashboard_and_job(spark, zones, folder):
    """Raw text datasets through landing, publishing, overview, charts and the job."""
    from ledgerloom.operators.aggregates import overview_kpis, top_merchants
    from ledgerloom.plans.dashboard import dashboard_charts

    land(zones, folder, "fact_transactions.csv", TX + 't4,a,c2, ,2024-01-03,ok,7.9\n')
    land(zones, folder, "fact_fraud_alerts.csv", "alert_id,transaction_id,account_id,alert_status\n1,t1,a,open\n")
    land(zones, folder, "fact_loans.csv", "loan_id,customer_id,principal_amount\nl1,c1,5\nl2,c2,\n")
    land(zones, folder, "dim_merchants.csv", "merchant_id,merchant_name\nm1,Old\nm2,Two\nm1,New\n")
    land(zones, folder, "dim_customers.csv", "customer_id,full_name,region\nc1,A,North\nc2,B, North \nc3,C,\n")
    assert process_all(zones, "all")["errors"] == []
    frames = zones.star_frames(strict=True)
    assert tuple(overview_kpis(frames).first()) == (3, 0, 4, 2, 1, 19, 5)
    assert rows(top_merchants(frames["fact_transactions"], frames["dim_merchants"])) == [
        ("m1", "New", 2, 10), ("m2", "Two", 1, 1)]
    charts = {}
    for r in dashboard_charts(frames, zones.registry()).orderBy("key", "ord").collect():
        charts.setdefault(r.key, []).append((r.label, r.value))
    assert charts["merchants_txn"] == [("New", 2.0), ("Two", 1.0)]
    assert charts["merchants_amt"] == [("New", 10.0), ("Two", 1.0)]
    assert charts["customers_region"] == [("North", 2.0), ("(empty)", 1.0)]
    assert charts["loan_principal_bins"] == [("0-1", 1.0), ("1-2", 0.0), ("2-3", 0.0), ("3-4", 0.0), ("4-5", 1.0)]
    assert charts["txn_channel"] == charts["loan_status"] == [("—", 0.0)]
    assert charts["entity_counts"] == [
        ("Customers", 3.0), ("Accounts", 0.0), ("Txns", 4.0), ("Loans", 2.0), ("Fraud", 1.0)]
    assert charts["pipeline_status"] == [("analytics_ready", 5.0)]
    tables = curate.curate_and_load(spark, f"{zones.root}/published/finance", f"{folder.root}/out")
    assert sorted(rows(tables["kpi_top_merchants"].select("merchant_id", "merchant_name")), key=str) == [
        ("", None), ("m1", "New"), ("m1", "Old"), ("m2", "Two")]


def test_merchant_ids_are_not_stripped_together(spark, folder):
    from ledgerloom.plans.dashboard import counted_series
    from ledgerloom.sources.star import Star
    from conftest import DATA

    frames = Star(spark, DATA).frames()
    frames["fact_transactions"] = spark.createDataFrame(
        [("m1", "5"), (" m1", "7"), ("m1", "1"), ("", "9"), (None, "9")], "merchant_id string, amount string")
    frames["dim_merchants"] = spark.createDataFrame([("m1", "One"), (" m1", "Other")], "merchant_id string, merchant_name string")
    got = counted_series(frames).filter("key = 'merchants_txn'").orderBy("ord")
    assert rows(got.select("label", "value")) == [("One", 2.0), ("Other", 1.0)]
