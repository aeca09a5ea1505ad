from __future__ import annotations

import pytest
from conftest import rows

from ledgerloom.operators.predicates import hide_failed_jobs, search_concat
from ledgerloom.plans import jobs as j
from ledgerloom.plans.ingest import process_all
from ledgerloom.sources.zones import Zones


@pytest.fixture
def zones(spark, folder):
    return Zones(spark, f"{folder.root}/zones")


def test_job_records_and_run_states(spark, zones, folder):
    zones.land(folder("in/a.csv", "k\n1\n2\n"))
    zones.land(folder("in/fact_loans.csv", "loan_id,customer_id,principal_amount\n1,2,3\n"))
    process_all(zones, "all")
    first = j.record_job(zones, "nightly", "ann", "r1", "queued")
    second = j.record_job(zones, "adhoc", "bob", error="no connection")
    third = j.record_job(zones, "weekly", "ann", "r3", "queued")
    assert [x["status"] for x in (first, second, third)] == ["queued", "completed", "queued"]
    runs = spark.createDataFrame([("r1", "success"), ("r3", "upstream_failed")], "run_id string, new_state string")
    j.sync_jobs(zones, runs)
    j.sync_jobs(zones, runs)
    listed = j.job_list(zones).collect()
    assert [(r.job_name, r.status, r.state) for r in listed] == [
        ("weekly", "failed", "upstream_failed"), ("adhoc", "completed", None), ("nightly", "completed", "success")]
    assert [tuple(r.summary) for r in listed] == [(2, 1, 1, 3)] * 3
    assert listed[1].message == "No run was queued: no connection."
    assert zones.jobs.frame().count() == 5
    shown = hide_failed_jobs(j.job_list(zones))
    assert sorted(r.job_name for r in shown.collect()) == ["adhoc", "nightly"]
    assert search_concat(shown, "ANN", ["job_name", "status", "triggered_by"]).count() == 1


def test_audit_trail_is_newest_first(zones):
    assert j.audit_trail(zones).count() == 0
    for i in range(3):
        j.audit(zones, f"step {i}", "success", 'said "x"\nand y')
    assert rows(j.audit_trail(zones).select("action", "username", "details"))[0] == (
        "step 2", "anonymous", 'said "x"\nand y')
    assert zones.audit.newest(2).count() == 2
