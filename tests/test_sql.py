from __future__ import annotations

import pytest
from conftest import DATA, rows

from ledgerloom.plans.examples import EXAMPLES, TABLES
from ledgerloom.plans.sql_workspace import SqlWorkspace, bridge_dialect
from ledgerloom.sources.star import Star


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    spark.range(3).selectExpr("id AS n").write.option("path", str(tmp_path_factory.mktemp("t") / "outsider")).saveAsTable("outsider")
    space = SqlWorkspace(spark)
    star = Star(space.spark, DATA)
    for name in TABLES:
        space.register(f"{name}.csv", getattr(star, name))
    return space


@pytest.mark.parametrize("text", [
    "", "  ;", None, "DROP TABLE dim_customers", "insert into dim_customers values (1)", "SET spark.x=1",
    "WITH x AS (SELECT 1) INSERT INTO dim_customers SELECT * FROM x", "SELECT 1; SELECT 2", "SELECT 1); DROP TABLE x; (SELECT 1",
    "SELECT * FROM nowhere", "SELECT reflect('java.lang.System', 'currentTimeMillis')",
    "SELECT `java_method`('java.lang.System', 'exit', 1)", "SELECT try_reflect('a', 'b')",
    "SELECT * FROM csv.`/etc/hosts`", "EXPLAIN SELECT 1", "SELECT * FROM outsider", "SELECT * FROM default.outsider",
    "SELECT TRANSFORM(branch_name) USING 'cat' AS (x STRING) FROM dim_branches", "FROM dim_branches MAP branch_name USING 'cat' AS x",
    "SELECT * FROM (FROM dim_branches REDUCE branch_name USING 'cat' AS x)", "SELECT * FROM range(5)",
    "SELECT 1 WHERE 1 IN (SELECT n FROM outsider)", "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.System', 'gc'))",
    "SELECT * FROM outsider WHERE 1 IN (WITH outsider AS (SELECT 1 AS x) SELECT x FROM outsider)",
    "SELECT (SELECT max(n) FROM outsider) AS x", "WITH t AS (SELECT * FROM outsider) SELECT * FROM t",
])
def test_refused(space, text):
    with pytest.raises(ValueError):
        space.readonly_sql(text)


@pytest.mark.parametrize("text,value", [
    ("SELECT 'a; update b' AS x;", "a; update b"), ("select 1 AS x -- note", 1), ("WITH t AS (SELECT 2 AS x) SELECT x FROM t", 2),
    ('SELECT "x" FROM (SELECT 3 AS "x")', 3), ("SELECT CAST('12345678.91' AS REAL) AS x", 12345678.91),
    ("SELECT CAST('abc' AS REAL) AS x", None), ("SELECT CAST(5 AS TEXT) AS x", "5"),
    ("SELECT 'it''s \"AS REAL)\"' AS x", "it's \"AS REAL)\""), ("SELECT 'reflect' AS x", "reflect"),
    ("SELECT text FROM (SELECT 'a' AS text)", "a"), ("SELECT CAST((SELECT max(real) FROM (SELECT '7' AS real)) AS REAL) AS x", 7.0),
    ("SELECT x FROM (SELECT explode(array(4)) AS x)", 4), ("SELECT CAST('x' AS INT) AS x", None),
])
def test_accepted(space, text, value):
    assert rows(space.readonly_sql(text)) == [(value,)]


def test_limits(space):
    everything = "SELECT * FROM fact_loans"
    assert space.readonly_sql(everything).count() == 200
    assert space.readonly_sql(everything, 5000).count() == 1000
    assert space.readonly_sql(everything, -1).count() == 1
    assert space.readonly_sql_capped(everything).count() == 100
    assert space.readonly_sql_capped(everything + " LIMIT 900", 900).count() == 500
    assert space.readonly_sql("select 1) a union all (select 2", 1).count() == 1


def test_order_survives_the_limit(space):
    ids = [r.loan_id for r in space.readonly_sql("SELECT loan_id FROM fact_loans ORDER BY loan_id DESC", 3).collect()]
    assert ids == sorted(ids, reverse=True)


def test_bridge_leaves_comments_and_literals():
    assert bridge_dialect("""SELECT "a b", 'x "y"' -- "c"\n/* "d" */""") == """SELECT `a b`, 'x "y"' -- "c"\n/* "d" */"""


def test_examples_all_run(space):
    report = space.validate({**EXAMPLES, "broken": "SELECT nothing FROM nowhere"}).collect()
    assert [r.example for r in report if not r.ok] == ["broken"]
    assert all(r.row_count > 0 for r in report if r.ok)


def test_catalog_and_private_views(spark, space):
    assert [r.table_id for r in space.catalog_list().collect()] == sorted(TABLES)
    assert not spark.catalog.tableExists("dim_customers")


def test_warehouse_tables_are_replaced_and_listed(spark, space, folder):
    from ledgerloom.session import shared_folder
    from ledgerloom.sources.csv_files import load_warehouse_infer

    for text, kinds in [("a,b\n1,x\n2,\"y\nz\"\n", ["bigint", "string"]), ("a,c,d,e,f,g\n1.5,2024-01-02,,TRUE,2024-01-02T03:04:05Z,0x1\n 2 ,,,false,,1\n",
         ["double", "date", "string", "boolean", "timestamp", "string"])]:
        df = load_warehouse_infer(spark, folder("w.csv", text), "wh_test", shared_folder(spark, "warehouse"))
        assert [k for _, k in df.dtypes] == kinds
    assert df.count() == 2
    assert "default" in [r.dataset_id for r in space.database_list().collect()]
    listed = {r.table_id: r.select_preview_sql for r in space.catalog_list("default").collect()}
    assert listed["wh_test"] == "SELECT * FROM default.wh_test LIMIT 100"
