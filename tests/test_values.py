"""Value rules against plain Python on small inputs."""

from __future__ import annotations

import math

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import as_money, clamp, lenient_double, whole_text
from ledgerloom.functions.text import WHITESPACE, file_stem, strip, table_name
from ledgerloom.operators.aggregates import histogram, sum_lenient, value_counts
from ledgerloom.operators.profile import profile, profile_insights, profile_numeric
from ledgerloom.plans.sql_workspace import sql_name

slow = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)


@slow
@given(st.lists(st.text(st.sampled_from(WHITESPACE + "ab​"), max_size=6), min_size=1, max_size=20))
def test_strip_is_python_strip(spark, values):
    got = texts(spark, values).orderBy("i").select(strip(F.col("v")))
    assert [r[0] for r in got.collect()] == [v.strip() for v in values]


@pytest.mark.parametrize("text,number", [
    ("1", 1.0), (" 2.5\t", 2.5), ("-3e2", -300.0), (".5", 0.5), ("7.", 7.0), ("1_000", 1000.0), ("\xa08", 8.0),
    ("", None), ("  ", None), (None, None), ("1.5d", None), ("1.5f", None), ("0x1p3", None), ("1__0", None),
    ("_1", None), ("nan", None), ("inf", None), ("1e999", None), ("9" * 400, None), ("9" * 305, float("9" * 305)), ("1,5", None), ("+4", 4.0), ("1 2", None),
])
def test_lenient_double(spark, text, number):
    assert texts(spark, [text]).select(lenient_double(F.col("v"))).first()[0] == number


@pytest.mark.parametrize("text,money", [
    ("1234567890123456.78", "1234567890123456.78"), ("1_0.005", "10.01"), ("1.5e3", "1500.00"), ("1e300", None),
    ("1e999999999", None), ("-0.004", "0.00"), ("x", None), ("", None), (" 2 ", "2.00"), ("nan", None),
])
def test_as_money(spark, text, money):
    df = texts(spark, [text])
    got = df.select(as_money(df, "v")).first()[0]
    assert (got if got is None else str(got)) == money


def test_as_money_of_doubles(spark):
    df = spark.createDataFrame([(1.25,), (1e300,), (None,)], "v double")
    assert [r[0] if r[0] is None else str(r[0]) for r in df.select(as_money(df, "v")).collect()] == ["1.25", None, None]


def finite(text):
    """What Python parses, with non-finite results left out."""
    try:
        value = float(text)
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


@slow
@given(st.lists(st.text("0123456789.eE+-_ dxf", max_size=6), min_size=1, max_size=30))
def test_lenient_double_follows_python(spark, values):
    got = texts(spark, values).orderBy("i").select(lenient_double(F.col("v"))).collect()
    assert [r[0] for r in got] == [finite(v) for v in values]


@slow
@given(st.lists(st.floats(-1e12, 1e12) | st.integers(-20, 20).map(lambda n: n / 2), min_size=1, max_size=20))
def test_whole_text_is_percent_dot_zero_f(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(whole_text(F.col("v"))).collect()]
    assert got == [f"{v:.0f}" if v != 0 else "0" for v in values]


@pytest.mark.parametrize("path,name", [
    ("/x/My File (1).CSV", "my_file_1"), ("a.tar.gz", "a_tar"), (".csv", "csv"), ("___.csv", "dataset"), ("noext", "noext"),
])
def test_table_name(spark, path, name):
    df = texts(spark, [path])
    assert df.select(table_name(F.col("v"))).first()[0] == name == sql_name(path)
    assert df.select(file_stem(F.col("v"))).first()[0] is not None


def test_clamp():
    assert [clamp(n, 1, 20) for n in (-3, 0, 7, 99)] == [1, 1, 7, 20]


def test_sum_skips_what_does_not_parse(spark):
    df = texts(spark, ["1.10", "", None, "x", " 2.20 ", "nan", "1e1"])
    assert float(sum_lenient(df, "v").first()[0]) == 13.3
    assert float(sum_lenient(df, "absent").first()[0]) == 0
    assert df.select(F.sum(as_money(df, "v"))).first()[0] is not None


def test_value_counts_labels(spark):
    long = "abcdefghijklmnopqrstuvwxyz"
    df = texts(spark, ["b", " b ", "a", "", None, "\t", long, long + "1"])
    assert rows(value_counts(df, "v", 10).orderBy("ord")) == [
        (1, "(empty)", 3.0), (2, "b", 2.0), (3, "a", 1.0), (4, long[:24], 1.0), (5, long[:24], 1.0)]
    assert value_counts(df, "absent", 3).count() == 0


def naive_bins(values, bins):
    """Bin counts by walking the values, with blanks as 0 and bad text left out."""
    numbers = [0.0 if v in (None, "") else finite(v) for v in values]
    numbers = [n for n in numbers if n is not None]
    if not numbers:
        return []
    low, high = min(numbers), max(numbers)
    if low == high:
        return [(1, str(int(low)), float(len(numbers)))]
    width = (high - low) / bins
    counts = [0.0] * bins
    for n in numbers:
        counts[min(bins - 1, math.floor((n - low) / width))] += 1
    return [(i + 1, f"{low + i * width:.0f}-{low + (i + 1) * width:.0f}", c) for i, c in enumerate(counts)]


@slow
@given(st.lists(st.sampled_from(["", None, "x", "0", "10", "2.5", "-7", "10.0", "99", " 3 "]), max_size=12),
       st.integers(1, 6))
def test_histogram(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert rows(histogram(df, "v", bins).orderBy("ord")) == naive_bins(values, bins)


def test_histogram_of_missing_column(spark):
    assert histogram(texts(spark, ["1"]), "absent").count() == 0


def test_profile(spark):
    df = spark.createDataFrame(
        [("1", " x", None, "1"), ("3", "", " ", "2"), ("bad", "y", "", "3"), (None, "5", "", "4")],
        "a string, b string, c string, `d.e` string")
    assert [tuple(r)[1:] for r in profile(df).orderBy("position").collect()] == [
        ("a", 4, 1, 2, 1.0, 3.0, 2.0), ("b", 4, 1, 1, 5.0, 5.0, 5.0),
        ("c", 4, 4, 0, None, None, None), ("d.e", 4, 0, 4, 1.0, 4.0, 2.5)]
    assert {r.column for r in profile_numeric(df).collect()} == {"a", "b", "d.e"}
    record = profile_insights(df).first()
    assert record.columns == ["a", "b", "c", "d.e"] and record.row_count == 4
    assert record.null_counts == {"a": 1, "b": 1, "c": 4, "d.e": 0}
    assert {k: tuple(v) for k, v in record.numeric_summary.items()} == {
        "a": (1.0, 3.0, 2.0), "b": (5.0, 5.0, 5.0), "d.e": (1.0, 4.0, 2.5)}


def test_amounts_are_cut_before_rounding(spark):
    from ledgerloom.operators.aggregates import top_merchants

    tx = spark.createDataFrame([("a", "0.999"), ("a", "99.995"), ("a", "-1.9"), ("a", "x")], "merchant_id string, amount string")
    names = spark.createDataFrame([("a", "A")], "merchant_id string, merchant_name string")
    assert [tuple(r) for r in top_merchants(tx, names).collect()] == [("a", "A", 4, 98)]


def test_large_amounts_stay_in_sums(spark):
    from decimal import Decimal

    from ledgerloom.operators.aggregates import sum_lenient

    for cells, want in ((["12345678901234567890", "1"], "12345678901234567891.00"), (["1e16", "1e20", "-3"], "100009999999999999997.00")):
        df = spark.createDataFrame([(c,) for c in cells], "amount string")
        assert sum_lenient(df, "amount").first()[0] == Decimal(want)


@pytest.mark.parametrize("cells,want", [
    (["1e26", "2.50", "x", None, "-1_000"], "99999999999999999999999002.50"), (["1e300", "1"], None), (["1e400", "inf", "nan", "3"], "3.00"),
    (["-1e30", "1e30", "4"], "4.00"), (["1" + "0" * 27], "1" + "0" * 27 + ".00"),
])
def test_sums_take_amounts_beyond_exact_money(spark, cells, want):
    from ledgerloom.operators.aggregates import sum_lenient

    got = sum_lenient(spark.createDataFrame([(c,) for c in cells], "v string"), "v").first()[0]
    assert got is None if want is None else f"{got:f}" == want


def test_sums_of_typed_doubles_leave_out_what_is_not_finite(spark):
    from ledgerloom.operators.aggregates import sum_lenient

    frame = spark.createDataFrame([(1e27,), (float("nan"),), (float("-inf"),), (0.25,), (None,)], "v double")
    assert f"{sum_lenient(frame, 'v').first()[0]:f}" == "1" + "0" * 27 + ".25"
