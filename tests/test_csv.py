from __future__ import annotations

import csv
import io

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.sources.csv_files import (
    FIELDS, csv_header, export_csv, has_quoted_newlines, ragged_kind, scan_csv_job, scan_csv_raw, write_csv,
)


def test_quotes_commas_newlines_and_spaces(spark, folder):
    path = folder("a.csv", 'id,name,note\n1,"Health, Care","say ""hi"""\n2," padded ","two\nlines"\n')
    assert has_quoted_newlines(spark, path)
    assert rows(scan_csv_raw(spark, path)) == [
        ("1", "Health, Care", 'say "hi"'), ("2", " padded ", "two\nlines")]


def test_split_read_when_no_record_spans_lines(spark, folder):
    path = folder("a.csv", 'id,name\n1,"a ""quoted"" b"\n2,c\n')
    assert not has_quoted_newlines(spark, path)
    assert rows(scan_csv_raw(spark, path)) == [("1", 'a "quoted" b'), ("2", "c")]


def test_empty_short_long_and_blank_lines(spark, folder):
    path = folder("a.csv", 'a,b,c\n1,,\n2\n\n3,x,y,z\n4,"",w\n5,x,y,\n6,"p,q"\n')
    got = scan_csv_raw(spark, path, keep_field_count=True)
    got = got.withColumn("kind", ragged_kind(3)).drop(FIELDS)
    assert rows(got) == [
        ("1", "", "", "ok"), ("2", None, None, "short"), ("3", "x", "y", "long"), ("4", "", "w", "ok"),
        ("5", "x", "y", "long"), ("6", "p,q", None, "short")]


def test_field_count_can_be_read_alone(spark, folder):
    df = scan_csv_raw(spark, folder("a.csv", "a,b\n1,2\n3\n"), keep_field_count=True)
    assert rows(df.select(FIELDS)) == [(2,), (1,)] and df.count() == 2
    assert rows(df.select("b")) == [("2",), (None,)]


def test_duplicate_headers_keep_the_last_and_odd_names_survive(spark, folder):
    path = folder("a.csv", "a,b.c,a,d e\n1,2,3,4\n")
    df = scan_csv_raw(spark, path)
    assert sorted(df.columns) == ["a", "b.c", "d e"]
    assert df.first().asDict() == {"a": "3", "b.c": "2", "d e": "4"}


def test_no_header(spark, folder):
    assert csv_header(spark, folder("e.csv", "")) == []
    with pytest.raises(ValueError, match="has no header"):
        scan_csv_raw(spark, folder("f.csv", ""))


def test_header_with_quotes_and_line_breaks(spark, folder):
    path = folder("a.csv", '"a, b","c\nd","e ""f"""\n1,2,3\n')
    assert csv_header(spark, path) == ["a, b", "c\nd", 'e "f"']
    assert scan_csv_raw(spark, path).first().asDict() == {"a, b": "1", "c\nd": "2", 'e "f"': "3"}


def test_job_scan_is_a_plain_header_scan(spark, folder):
    assert rows(scan_csv_job(spark, folder("a.csv", "a,b\n1,\n"))) == [("1", None)]


def test_byte_order_mark_is_dropped(spark, folder):
    assert scan_csv_raw(spark, folder("a.csv", "﻿a,b\n1,2\n")).columns == ["a", "b"]


def test_export_quotes_every_cell(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, " x ", "")], "id int, t string, n string")
    export_csv(df.coalesce(1), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ['"id","t","n"', '"1","a ""b"", c",""', '"2"," x ",""']


cell = st.text(st.characters(codec="utf-8", exclude_characters="\r\x00﻿", exclude_categories=["Cs"]), max_size=8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell), min_size=1, max_size=6))
def test_reads_what_the_csv_module_writes(spark, tmp_path, table):
    import uuid

    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n", quoting=csv.QUOTE_ALL)
    writer.writerows([("left", "right"), *table])
    path = tmp_path / f"{uuid.uuid4().hex}.csv"
    path.write_bytes(text.getvalue().encode("utf-8"))
    assert rows(scan_csv_raw(spark, str(path))) == table


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell), min_size=1, max_size=6))
def test_reads_what_it_writes(spark, tmp_path, table):
    import uuid

    path = str(tmp_path / uuid.uuid4().hex)
    write_csv(spark.createDataFrame(table, "left string, right string").coalesce(1), path)
    assert rows(scan_csv_raw(spark, path)) == table


@pytest.fixture(params=["600", "5000", None])
def splits(spark, request):
    """Split sizes from some hundred bytes to Spark's own."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    if request.param:
        spark.conf.set(names[0], request.param)
        spark.conf.set(names[1], "1")
    yield
    for n, value in old.items():
        spark.conf.set(n, value)


def test_spanning_records_do_not_depend_on_the_split_size(spark, folder, splits):
    import random

    rnd = random.Random(3)
    parts = ["x", "a,b", 'q"q', "two\nlines", "", "\n\n", "plain text", "l\n" * 60, '"', " pad ", "é" * 30]
    want = []
    for f in range(3):
        table = [(str(f * 1000 + i), rnd.choice(parts), rnd.choice(parts)) for i in range(150)]
        text = io.StringIO()
        csv.writer(text, lineterminator="\n" if f else "\r\n").writerows([("id", "left", "right"), *table])
        folder(f"many/part{f}.csv", text.getvalue() + "\n")
        want += table
    got = scan_csv_raw(spark, f"{folder.root}/many", keep_field_count=True)
    assert sorted(rows(got)) == sorted((*r, 3) for r in want)


@pytest.mark.parametrize("text,want", [
    ("id,t\n" + "".join(f'{i},{i}" wide\n' for i in range(400)), [(str(i), f'{i}" wide') for i in range(400)]),
    ("id,t\r" + "".join(f'{i},"a\rb"\r' for i in range(400)), [(str(i), "a\nb") for i in range(400)]),
    ("\n\nid,t\n" + "".join(f'{i},"a\r\nb"\n\n' for i in range(400)), [(str(i), "a\r\nb") for i in range(400)]),
    ('id,t\n1,"' + "long\n" * 3000 + '"\n2,x\n', [("1", "long\n" * 3000), ("2", "x")]),
], ids=["stray quotes", "CR ends", "blank lines, CR LF in quotes", "a field longer than a split"])
def test_odd_files_do_not_depend_on_the_split_size(spark, folder, splits, text, want):
    assert sorted(rows(scan_csv_raw(spark, folder("a.csv", text)))) == sorted(want)


def test_ragged_rows_of_a_spanning_file(spark, folder, splits):
    body = '1,"a\nb"\n2\n\n3,x,y\n4,\n' + "".join(f'{i},"{"z" * 50}"\n' for i in range(5, 30))
    df = scan_csv_raw(spark, folder("a.csv", "id,t\n" + body), keep_field_count=True)
    got = sorted(rows(df), key=lambda r: int(r[0]))
    assert got[:4] == [("1", "a\nb", 2), ("2", None, 1), ("3", "x", 3), ("4", "", 2)] and len(got) == 29
    assert df.select("t").count() == 29 and df.count() == 29


def test_only_files_with_spanning_records_are_read_whole(spark, folder, splits):
    plain = "k,v\n" + "".join(f"{i},x{i}\n" for i in range(200))
    for name in ("a", "c"):
        folder(f"mixed/{name} 1.csv", plain)
    folder("mixed/b+%.csv", 'k,v\n1000,"two\nlines"\n1001,"it""s"\n')
    for keep in (False, True):
        got = scan_csv_raw(spark, f"{folder.root}/mixed", keep_order=keep)
        cells = [(r.k, r.v) for r in (got.orderBy("_row_order") if keep else got).collect()]
        one = [(str(i), f"x{i}") for i in range(200)]
        want = [*one, ("1000", "two\nlines"), ("1001", 'it"s'), *one]
        assert cells == want if keep else sorted(cells) == sorted(want)
    if spark.conf.get("spark.sql.files.maxPartitionBytes") == "600":
        assert scan_csv_raw(spark, f"{folder.root}/mixed", keep_order=True).rdd.getNumPartitions() > 5  # the others are still split
