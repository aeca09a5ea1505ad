"""Many landings processed together, and generations that readers see whole."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.plans import ingest
from ledgerloom.plans.ingest import process_all, process_landing
from ledgerloom.sources.csv_files import ROW_ORDER
from ledgerloom.sources.files import Files
from ledgerloom.sources.versions import Versions
from ledgerloom.sources.zones import Zones, read_stored

DAY = dt.datetime(2024, 5, 1, 12, 0, 0, tzinfo=dt.timezone.utc)
FILES = {
    "a one.csv": "k,v\n1, x \n2,\n", "b+two.csv": "k,v\n3,7\n", "c%20.csv": 'k,v\n4,"two\nlines"\n', "long.csv": "k,v\n1,2\n1,2,3\n", "short.csv": "k,v\n1\n\n2,3\n",
    "none.csv": "k,v\n", "blank.csv": "\n \n", "other.csv": "x\n1\n", "quoted.csv": '"k\nk",v\n1,2\n', "fact_loans.csv": "k,v\n1,2\n", "bom.csv": "﻿k,v\n9,8.5\n",
    "dim_cards.csv": "card_id,account_id,customer_id\n1,2,3\n", "twice.csv": "k,k\n1,2\n", "é.csv": "k,v\nü,Ü\n", "commas.csv": 'k,v\n"a,b","c,""d"""\n',
}


@pytest.fixture
def zones(spark, folder):
    return Zones(spark, f"{folder.root}/zones")


def land_all(zones, folder, files):
    for name, text in files.items():
        zones.land(folder(f"in/{name}", text), name, DAY)


def parts_of(zones, folder, name):
    """A landing of several files, each with the header, as Spark writes them."""
    for part in range(3):
        folder(f"in/{name}/part-0000{part}.csv", "k,v\n" + "".join(f"{part},{i}\n" for i in range(4)))
    zones.land(f"{folder.root}/in/{name}", name, DAY)


def picture(zones) -> dict:
    out = {}
    for r in zones.registry().collect():
        stored = zones.stored(r.dataset)
        text = None
        if stored is not None:
            df = read_stored(zones.spark, stored, keep_order=True)
            text = (df.drop(ROW_ORDER).columns, rows(df.orderBy(ROW_ORDER).drop(ROW_ORDER)))
        insights = r.insights and r.insights.asDict(recursive=True)
        out[r.dataset] = (r.pipeline_status, r.status, r.error, r.row_count, r.classification, insights, [s.stage for s in r.stages or []], text, zones.is_ready(r.dataset))
    return out


def test_together_equals_one_by_one(spark, folder, zones, monkeypatch):
    alone = Zones(spark, f"{folder.root}/alone")
    for each in (zones, alone):
        land_all(each, folder, FILES)
        parts_of(each, folder, "folder.csv")
    process_all(zones, "all")

    def refuse(*_):
        raise RuntimeError

    monkeypatch.setattr(ingest, "_process_group", refuse)
    process_all(alone, "all")
    got, want = picture(zones), picture(alone)
    assert set(got) == {*FILES, "folder.csv"}
    for name in want:
        assert got[name] == want[name], name
    assert got["long.csv"][2] == "1 rows have more fields than the header." and got["long.csv"][7] is None
    assert got["a one.csv"][7] == (["k", "v"], [("1", "x"), ("2", "")]) and got["folder.csv"][3] == 12
    assert zones.files.names(f"{zones.root}/processing") == []


def test_the_number_of_jobs_does_not_grow_with_the_landings(spark, folder, zones):
    def jobs_for(n: int, group: str) -> int:
        land_all(zones, folder, {f"{group}{k}.csv": "k,v\n" + f"{k},1\n" * (k % 5 + 1) for k in range(n)})
        spark.sparkContext.setJobGroup(group, group)
        done = process_all(zones, "all")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert done["errors"] == [] and len(done["processed"]) == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs_for(3, "few"), jobs_for(120, "many")
    assert many <= few + 6
    counts = {r.dataset: r.row_count for r in zones.registry().collect()}
    assert all(counts[f"many{k}.csv"] == k % 5 + 1 for k in range(120))


def test_a_joint_job_that_breaks_is_done_one_by_one(zones, folder, monkeypatch):
    land_all(zones, folder, {"a.csv": "k\n1\n", "b.csv": "k\n2\n"})
    monkeypatch.setattr(ingest, "insights_of", lambda *a, real=ingest.insights_of, seen=[]: seen.append(1) or real(*a) if len(seen) else seen.append(1) or 1 / 0)
    done = process_all(zones, "all")
    assert [r["ok"] for r in done["processed"]] == [False, True] and "division" in done["errors"][0]
    assert rows(zones.scan_gated("b.csv")) == [("2",)]


# Generations


def processed(zones, folder, text, when=DAY):
    """A landing of loans, checked and published but not marked."""
    entry = zones.land(folder("in/fact_loans.csv", "loan_id,customer_id,principal_amount\n" + text), "fact_loans.csv", when)
    raw = ingest.scan_csv_raw(zones.spark, zones.landing(entry["landing_file"]), keep_field_count=True, keep_order=True)
    path = zones.processing(entry["landing_file"])
    ingest.write_processed(raw, path)
    return ingest.publish(zones, path, "fact_loans.csv")


def loans(zones, **more):
    return sorted(r.loan_id for r in zones.scan_gated("fact_loans.csv", **more).collect())


def test_readers_see_one_generation_with_its_time(zones, folder):
    first = processed(zones, folder, "1,a,5\n")
    assert loans(zones) == [] and zones.ready_at("fact_loans.csv") is None  # published is not yet seen
    zones.mark_ready("fact_loans.csv", "t1", first)
    assert loans(zones, strict=True) == ["1"] and zones.ready_at("fact_loans.csv") == "t1"
    reader = zones.scan_gated("fact_loans.csv")
    second = processed(zones, folder, "2,a,5\n3,a,5\n", DAY + dt.timedelta(days=1))
    # Between the two steps: the old rows, the old time.
    assert loans(zones, strict=True) == ["1"] and zones.ready_at("fact_loans.csv") == "t1"
    assert rows(zones.preview("fact_loans.csv").select("loan_id")) == [("1",)]
    assert rows(read_stored(zones.spark, zones.published("fact_loans.csv")).select("loan_id")) == [("1",)]
    zones.mark_ready("fact_loans.csv", "t2", second)
    assert loans(zones, strict=True) == ["2", "3"] and zones.ready_at("fact_loans.csv") == "t2"
    assert rows(reader.select("loan_id")) == [("1",)]  # a reader under way keeps its rows
    zones.mark_ready("fact_loans.csv", "t3", processed(zones, folder, "4,a,5\n", DAY + dt.timedelta(days=2)))
    assert len(zones.files.names(f"{zones.published('fact_loans.csv')}/versions")) == 2


@pytest.mark.parametrize("owner,name,call,sees,stamp", [
    (Versions, "begin", 1, ["1"], "t1"), (Files, "move", 1, ["1"], "t1"), (Versions, "commit", 1, ["1"], "t1"), (Files, "put_new", 1, ["1"], "t1"),
    (Versions, "vacuum", 1, ["2"], "t2"),
])
def test_a_break_leaves_one_generation_whole(zones, folder, monkeypatch, owner, name, call, sees, stamp):
    zones.mark_ready("fact_loans.csv", "t1", processed(zones, folder, "1,a,5\n"))
    entry = zones.land(folder("in/fact_loans.csv", "loan_id,customer_id,principal_amount\n2,b,6\n"), "fact_loans.csv", DAY + dt.timedelta(days=1))
    monkeypatch.setattr("ledgerloom.sources.zones.utc_now", lambda: type("Now", (), {"isoformat": lambda self: "t2"})())

    def crash(*_, **__):
        raise RuntimeError("broken off")

    monkeypatch.setattr(owner, name, crash)
    with pytest.raises(RuntimeError):
        process_landing(zones, "fact_loans.csv", entry["landing_file"], entry["uploaded_at"])
    monkeypatch.undo()
    assert loans(zones, strict=True) == sees and zones.ready_at("fact_loans.csv") == stamp


def test_uncommitted_generations_are_no_dataset(zones, folder):
    processed(zones, folder, "1,a,5\n")
    assert zones.stored("fact_loans.csv") is None and loans(zones, strict=True) == []
    with pytest.raises(FileNotFoundError):
        read_stored(zones.spark, zones.published("fact_loans.csv"))
    assert zones.scan_gated("fact_loans.csv").agg(F.count("*")).first()[0] == 0
