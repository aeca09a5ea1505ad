"""Parquet and JSON uploads through landing, checking, trimming, profiling and publishing."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.plans.ingest import process_all
from ledgerloom.plans.sql_workspace import SqlWorkspace
from ledgerloom.sources.csv_files import ROW_ORDER
from ledgerloom.sources.zones import Zones

DAY = dt.datetime(2024, 5, 1, 12, 0, 0, tzinfo=dt.timezone.utc)
LINES = '{"id": 1, "who": {"name": " Ann ", "at": {"town": "x"}}, "tags": ["a", " b"], "score": 1.5}\n{"id": 2, "who": {"name": " "}, "tags": [], "note": "7"}\n\n{"id": null}\n'


@pytest.fixture
def zones(spark, folder):
    return Zones(spark, f"{folder.root}/zones")


def entry(zones, name):
    return zones.registry().filter(F.col("dataset") == name).first()


@pytest.mark.parametrize("name,text", [("a.json", LINES), ("b.jsonl", LINES), ("c.ndjson", LINES), ("d.json", "[" + ",\n".join(x for x in LINES.split("\n") if x) + "]")])
def test_json_records_are_flattened_trimmed_and_profiled(zones, folder, name, text):
    zones.land(folder(f"in/{name}", text), name, DAY)
    assert rows(zones.preview(name, 1).select("id")) == [(1,)]
    assert process_all(zones, "all")["errors"] == []
    stored = zones.scan_gated(name, keep_order=True).orderBy(ROW_ORDER)
    assert set(stored.columns) - {ROW_ORDER} == {"id", "who.name", "who.at.town", "tags", "score", "note"}
    got = [tuple(r) for r in stored.select("id", "`who.name`", "`who.at.town`", "tags", "score", "note").collect()]
    assert got == [(1, "Ann", "x", ["a", " b"], 1.5, None), (2, "", None, [], None, "7"), (None, None, None, None, None, None)]
    done = entry(zones, name)
    assert (done.pipeline_status, done.row_count, done.classification) == ("analytics_ready", 3, "external")
    assert done.insights.null_counts == {"id": 1, "who.name": 2, "who.at.town": 2, "tags": 2, "score": 2, "note": 2}
    assert {k: tuple(v) for k, v in done.insights.numeric_summary.items()} == {"id": (1.0, 2.0, 1.5), "score": (1.5, 1.5, 1.5), "note": (7.0, 7.0, 7.0)}


def test_parquet_keeps_its_types(spark, zones, folder):
    frame = spark.range(5).select(
        "id", F.expr("date'2024-01-01' + CAST(id AS INT)").alias("day"), (F.col("id") / 4).cast("decimal(9,2)").alias("amount"),
        F.create_map(F.lit("k"), F.col("id")).alias("m"), F.struct(F.concat(F.lit(" t"), "id").alias("t"), F.struct((F.col("id") > 2).alias("big")).alias("f")).alias("s"))
    frame.repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(f"{folder.root}/in/p.parquet")
    zones.land(f"{folder.root}/in/p.parquet", "p.parquet", DAY)
    assert process_all(zones, "all")["errors"] == []
    stored = zones.scan_gated("p.parquet")
    assert dict(stored.dtypes) == {"id": "bigint", "day": "date", "amount": "decimal(9,2)", "m": "map<string,bigint>", "s.t": "string", "s.f.big": "boolean"}
    assert rows(zones.preview("p.parquet", 2).select("id", "`s.t`")) == [(0, "t0"), (1, "t1")]
    assert {k: v.avg for k, v in entry(zones, "p.parquet").insights.numeric_summary.items()} == {"id": 2.0, "amount": 0.5}
    space = SqlWorkspace(spark)
    assert space.register_zones(zones.root) == ["p"]
    assert rows(space.readonly_sql("SELECT max(`s.t`) AS t, sum(amount) AS a FROM p")) == [("t4", frame.agg(F.sum("amount")).first()[0])]


@pytest.mark.parametrize("name,text,error", [
    ("a.json", '{"id": 1}\n{"id": \n', "1 records are not readable"), ("a.json", "{}\n", "no columns"), ("a.json", " \n", "no records"),
    ("fact_loans.json", '{"loan_id": 1}\n', "Required columns are missing: customer_id, principal_amount"),
    ("a.json", '{"a.b": 1, "a": {"b": 2}}\n', "Columns of one name: a.b"),
])
def test_bad_uploads_are_recorded(zones, folder, name, text, error):
    zones.land(folder(f"in/{name}", text), name, DAY)
    zones.land(folder("in/good.csv", "k\n1\n"), "good.csv", DAY)
    assert error in process_all(zones, "all")["errors"][0]
    assert entry(zones, name).status == "failed" and zones.stored(name) is None
    assert rows(zones.scan_gated("good.csv")) == [("1",)]


def test_a_typed_upload_meets_its_tables_contract(zones, folder):
    zones.land(folder("in/fact_loans.json", '{"loan_id": 1, "customer_id": "c", "principal_amount": 5}\n'), "fact_loans.json", DAY)
    assert process_all(zones, "all")["errors"] == []
    assert entry(zones, "fact_loans.json").classification == "finance"
