"""The warehouse's spellings and the views that a workspace keeps."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import DATA, rows

from ledgerloom.plans.sql_workspace import SqlWorkspace
from ledgerloom.sources.star import Star


def workspace(spark, **more) -> SqlWorkspace:
    space = SqlWorkspace(spark, "p-1", "d", **more)
    star = Star(space.spark, DATA)
    space.register("loans.csv", star.fact_loans)
    space.register("people", star.dim_customers)
    space.register("texts", space.spark.createDataFrame([(1, "a"), (2, None)], "n int, word string"), "samples")
    return space


@pytest.fixture(scope="module")
def space(spark):
    return workspace(spark)


@pytest.mark.parametrize("text,value", [
    ("SELECT SAFE_DIVIDE(6, 4)", 1.5), ("SELECT SAFE_DIVIDE(1, 0)", None), ("SELECT safe_divide ( SAFE_DIVIDE(9, 3), SAFE_DIVIDE(4, 4) )", 3.0),
    ("SELECT DATE_SUB(DATE '2024-03-31', INTERVAL 30 DAY)", dt.date(2024, 3, 1)), ("SELECT DATE_SUB(DATE '2024-03-31', INTERVAL 1 MONTH)", dt.date(2024, 2, 29)),
    ("SELECT DATE_ADD(DATE_SUB(DATE '2024-03-31', INTERVAL 2 WEEK), INTERVAL 1 YEAR)", dt.date(2025, 3, 17)),
    ("SELECT date_sub(DATE '2024-03-31', 30)", dt.date(2024, 3, 1)),  # Spark's own spelling stays
    ("SELECT TIMESTAMP_SUB(TIMESTAMP '2024-01-01 01:00:00', INTERVAL 90 MINUTE) = TIMESTAMP '2023-12-31 23:30:00'", True),
    ("SELECT DATE_DIFF(DATE '2024-03-01', DATE '2024-02-01', DAY)", 29), ("SELECT DATE_DIFF(DATE '2024-03-01', DATE '2023-12-31', MONTH)", 3),
    ("SELECT DATE_DIFF(DATE '2024-03-04', DATE '2024-03-02', WEEK)", 1), ("SELECT DATE_DIFF(DATE '2024-01-01', DATE '2023-12-31', YEAR)", 1),
    ("SELECT DATE_TRUNC(DATE '2024-03-09', WEEK)", dt.date(2024, 3, 3)), ("SELECT DATE_TRUNC(DATE '2024-03-03', WEEK)", dt.date(2024, 3, 3)),
    ("SELECT DATE_TRUNC(DATE '2024-03-03', ISOWEEK)", dt.date(2024, 2, 26)), ("SELECT DATE_TRUNC(DATE '2024-05-09', QUARTER)", dt.date(2024, 4, 1)),
    ("SELECT COUNTIF(n > 1) FROM `p-1.samples.texts`", 1), ("SELECT COUNTIF(texts.n >= 1) FROM samples.texts", 2),
    ("SELECT t.n FROM `p-1.samples.texts` AS t WHERE IFNULL(t.word, 'none') = 'none'", 2),
    ("SELECT max(n) FROM `p-1`.samples.`texts`", 2), ("SELECT count(*) > 0 FROM `P-1.D.Loans`", True),
    ("SELECT @@project_id", "p-1"), ("SELECT '@@project_id `p-1.d.x` SAFE_DIVIDE(1, 2)'", "@@project_id `p-1.d.x` SAFE_DIVIDE(1, 2)"),
    ("SELECT SAFE_CAST('x' AS INT64)", None), ("SELECT CAST('7' AS INT64) + SAFE_CAST('1' AS FLOAT64)", 8.0),
    ("SELECT CURRENT_DATE() >= DATE '2024-01-01' AND CURRENT_TIMESTAMP() IS NOT NULL", True),
    ("SELECT 1 -- SAFE_DIVIDE(1, 2) FROM `p-1.d.nowhere`", 1),
    ("SELECT (SELECT count(*) FROM samples.texts) + (SELECT count(*) FROM `samples.texts` WHERE n IN (SELECT n FROM samples.texts WHERE SAFE_DIVIDE(n, 2) = 1))", 3),
    ("WITH x AS (SELECT SAFE_DIVIDE(n, 2) AS h FROM samples.texts) SELECT max(h) FROM x", 1.0),
    ("SELECT max(SAFE_DIVIDE(n, 4)) OVER (PARTITION BY 1 ORDER BY n DESC) FROM samples.texts LIMIT 1", 0.5),
    ("SELECT string_agg(table_name, ',') WITHIN GROUP (ORDER BY table_name) FROM `p-1.d.INFORMATION_SCHEMA.TABLES`", "loans,people"),
    ("SELECT table_name FROM samples.INFORMATION_SCHEMA.TABLES WHERE table_schema = 'samples'", "texts"),
])
def test_warehouse_spellings(space, text, value):
    assert rows(space.readonly_sql_capped(text)) == [(value,)]


@pytest.mark.parametrize("text", [
    "SELECT * FROM `p-1.d.nowhere`", "SELECT * FROM `other.d.loans`", "SELECT * FROM `p-1.other.loans`", "SELECT * FROM texts",
    "SELECT * FROM `a.p-1.d.loans`", "SELECT SAFE_REFLECT(1)", "SELECT * FROM `other.d.INFORMATION_SCHEMA.TABLES`",
    "SELECT DATE_SUB(DATE '2024-01-01', INTERVAL 1 DAY, 3)", "CREATE VIEW v AS SELECT 1",
    "SELECT SAFE_DIVIDE(1, (SELECT max(n) FROM `p-1.d.nowhere`))",
])
def test_warehouse_refusals(space, text):
    with pytest.raises(ValueError):
        space.readonly_sql_capped(text)


def test_views_are_kept_and_used(spark, space):
    assert space.create_view("CREATE VIEW `p-1.d.large` AS SELECT loan_id FROM `p-1.d.loans` WHERE SAFE_DIVIDE(principal_amount, 1000) > 100;") == "large"
    space.create_view("CREATE OR REPLACE VIEW summary AS SELECT count(*) AS n FROM d.large")
    n = rows(space.readonly_sql("SELECT (SELECT n FROM `p-1.d.summary`) = (SELECT count(*) FROM large)"))
    assert n == [(True,)] and not spark.catalog.tableExists("large")
    assert rows(space.readonly_sql("SELECT table_name FROM d.INFORMATION_SCHEMA.TABLES WHERE table_type = 'VIEW' ORDER BY 1")) == [("large",), ("summary",)]
    # A view that another uses may change; the other sees it.
    space.create_view("CREATE OR REPLACE VIEW large AS SELECT loan_id FROM loans WHERE false")
    assert rows(space.readonly_sql("SELECT n FROM summary")) == [(0,)]
    space.drop_view("large")
    with pytest.raises(ValueError, match="No such table"):
        space.readonly_sql("SELECT * FROM summary")
    space.drop_view("summary")


@pytest.mark.parametrize("statement,error", [
    ("CREATE VIEW v AS SELECT * FROM v", "uses itself"), ("CREATE VIEW v AS SELECT * FROM nowhere", "No such table"),
    ("CREATE VIEW loans AS SELECT 1 AS x", "There is a table"), ("CREATE VIEW v AS SELECT reflect('java.lang.System', 'gc') AS x", "No such function"),
    ("CREATE VIEW `q.d.v` AS SELECT 1 AS x", "No such dataset"), ("CREATE VIEW v AS SELECT 1 AS x; DROP TABLE loans", "Not a readable"),
    ("CREATE TABLE v AS SELECT 1 AS x", "Only CREATE VIEW"), ("SELECT 1", "Only CREATE VIEW"), ("", "statement|Only"), ("CREATE TEMP VIEW v AS SELECT 1 AS x", "no options"),
    ("CREATE VIEW v (a) AS SELECT 1 AS x", "no options"), ("CREATE VIEW v AS SELECT 1 AS x) UNION (SELECT 2", "Not a"),
])
def test_views_that_are_refused(space, statement, error):
    with pytest.raises(ValueError, match=error):
        space.create_view(statement)
    assert "v" not in space.views


def test_cycles_are_refused_and_the_old_view_stays(space):
    space.create_view("CREATE VIEW a AS SELECT 1 AS x")
    space.create_view("CREATE VIEW b AS SELECT * FROM a")
    with pytest.raises(ValueError, match="There is a view"):
        space.create_view("CREATE VIEW a AS SELECT 2 AS x")
    with pytest.raises(ValueError, match="uses itself: a > b > a"):
        space.create_view("CREATE OR REPLACE VIEW a AS SELECT * FROM b")
    assert rows(space.readonly_sql("SELECT x FROM b")) == [(1,)]


def test_views_outlive_the_session(spark, folder):
    path = f"{folder.root}/views"
    workspace(spark, folder=path).create_view("CREATE VIEW rich AS SELECT count(*) AS n FROM loans WHERE principal_amount > 5")
    later = workspace(spark, folder=path)
    assert later.readonly_sql("SELECT n FROM rich").first().n > 0
    later.drop_view("rich")
    assert workspace(spark, folder=path).views == {}
