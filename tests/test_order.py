"""Rows as they stand in their files, whatever the sizes of files and splits."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators.aggregates import named_merchants, top_merchants
from ledgerloom.operators.joins import merchant_lookup
from ledgerloom.plans.ingest import process_all
from ledgerloom.sources.csv_files import ROW_ORDER, file_order, scan_csv_raw
from ledgerloom.sources.zones import Zones

DAY = dt.datetime(2024, 5, 1, 12, 0, 0, tzinfo=dt.timezone.utc)
HEAD = "merchant_id,merchant_name\n"


@pytest.fixture(params=["64", "700", "128m"])
def splits(spark, request):
    """Splits of a few rows, of some rows, and of whole files."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "0")
    yield request.param
    for name, value in old.items():
        spark.conf.set(name, value)


@pytest.fixture
def zones(spark, folder):
    return Zones(spark, f"{folder.root}/zones")


def upload(folder, name: str, quoted: bool = False) -> str:
    """A small file, the largest file, then one that ends key 1; key k's last name says so."""
    folder(f"in/{name}/a.csv", HEAD + "1,first\n2,first\n")
    folder(f"in/{name}/b.csv", HEAD + "".join(f"{k},middle {k}\n" for k in range(1, 300)) + "1,almost\n")
    folder(f"in/{name}/c.csv", HEAD + "3,early\n" + ('"4","two\nlines"\n' if quoted else "4,four\n") + "1,last\n")
    return f"{folder.root}/in/{name}"


def ids(spark):
    return spark.createDataFrame([("1",), ("2",), ("3",), ("5",), ("x",)], "merchant_id string")


WANT = [("1", "last"), ("2", "middle 2"), ("3", "early"), ("5", "middle 5"), ("x", "x")]


@pytest.mark.parametrize("quoted", [False, True])
def test_the_last_row_over_all_files_names_a_merchant(spark, folder, splits, quoted):
    merchants = scan_csv_raw(spark, upload(folder, "m", quoted))
    assert sorted(rows(named_merchants(ids(spark), merchants, None))) == WANT
    assert sorted(rows(merchant_lookup(ids(spark), merchants))) == WANT


def test_a_larger_later_file_wins(spark, folder, splits):
    folder("two/a.csv", HEAD + "1,first\n")
    folder("two/b.csv", HEAD + "".join(f"{k},other\n" for k in range(2, 400)) + "1,last\n")
    names = named_merchants(ids(spark).filter("merchant_id = '1'"), scan_csv_raw(spark, f"{folder.root}/two"), None)
    assert rows(names) == [("1", "last")]


def test_order_is_kept_through_landing_and_publishing(spark, folder, zones, splits):
    zones.land(upload(folder, "dim_merchants.csv", True), "dim_merchants.csv", DAY)
    assert rows(zones.preview("dim_merchants.csv", 4)) == [("1", "first"), ("2", "first"), ("1", "middle 1"), ("2", "middle 2")]
    folder("in/fact_transactions.csv", "transaction_id,account_id,merchant_id,amount\nt1,a,1,5\nt2,a,1,5\nt3,a,2,5\n")
    zones.land(f"{folder.root}/in/fact_transactions.csv", "fact_transactions.csv", DAY)
    assert process_all(zones, "all")["errors"] == []
    frames = zones.star_frames(strict=True)
    assert [tuple(r)[:2] for r in top_merchants(frames["fact_transactions"], frames["dim_merchants"]).collect()] == [
        ("1", "last"), ("2", "middle 2")]
    everything = [("1", "first"), ("2", "first"), *[(str(k), f"middle {k}") for k in range(1, 300)], ("1", "almost"),
                  ("3", "early"), ("4", "two\nlines"), ("1", "last")]
    stored = zones.scan_gated("dim_merchants.csv", keep_order=True)
    assert rows(stored.orderBy(ROW_ORDER).drop(ROW_ORDER)) == everything
    for n in (1, 3, 50, 200):
        assert rows(zones.preview("dim_merchants.csv", n)) == everything[:n]
    assert zones.scan_gated("dim_merchants.csv").columns == ["merchant_id", "merchant_name"]


def test_order_of_parquet_put_there_by_hand(spark, folder, splits):
    path = f"{folder.root}/p"
    spark.range(500).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    back = spark.read.parquet(path)
    shuffled = back.withColumn("at", file_order(back)).repartition(7)
    assert [r.id for r in shuffled.orderBy("at").collect()] == list(range(500))


def test_order_of_a_frame_without_files(spark):
    frame = spark.range(5).groupBy("id").count()
    assert frame.withColumn("at", file_order(frame)).count() == 5


def test_the_name_of_the_place_is_reserved(spark, folder):
    folder("r.csv", f"a,{ROW_ORDER}\n1,2\n")
    assert scan_csv_raw(spark, f"{folder.root}/r.csv").count() == 1
    with pytest.raises(ValueError, match="may not be named"):
        scan_csv_raw(spark, f"{folder.root}/r.csv", keep_order=True)
