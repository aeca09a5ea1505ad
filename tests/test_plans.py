"""Plan shapes that matter at scale, and results that must not depend on partitioning."""

from __future__ import annotations

import pytest
from conftest import DATA

from ledgerloom.operators.aggregates import category_counts, value_counts
from ledgerloom.plans import kpi
from ledgerloom.sources.star import Star
from ledgerloom.suite import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["kpi_customer_risk", "dashboard_charts", "profile_numeric", "search_any_cell", "trim_all"])
def test_no_python_workers_and_no_cross_joins(spark, name):
    text = plan(QUERIES[name].build(spark, DATA))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name,pushed", [
    ("prefix_like", "ReadSchema: struct<p_partkey:bigint,p_name:string>"),
    ("eq_range_filter", "GreaterThan(n_chars,1000)"),
    ("topk_accounts_balance", "EqualTo(o_orderstatus,O)"),
    ("daily_volume", "GreaterThanOrEqual(l_shipdate,2001-10-05"),
    ("txn_type", "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>"),
])
def test_filters_and_columns_reach_the_scan(spark, name, pushed):
    df = QUERIES[name].build(spark, DATA)
    assert pushed in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["topk_accounts_balance", "join_left_count_accounts", "newest_n", "top_merchants_by_count"])
def test_limits_use_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name].build(spark, DATA))


def test_ranking_is_cut_before_the_shuffle(spark):
    assert "TakeOrderedAndProject" in plan(value_counts(Star(spark, DATA).fact_transactions, "channel", 8))
    both = category_counts(Star(spark, DATA).dim_customers, {"region": 10, "customer_segment": 8})
    assert plan(both).count("WindowGroupLimit") == 2


def test_results_do_not_depend_on_partitions(spark):
    star = Star(spark, DATA)
    name = "spark.sql.shuffle.partitions"
    seen = []
    for n in ("1", "50"):
        old = spark.conf.get(name)
        spark.conf.set(name, n)
        try:
            frames = kpi.curated_frames(star.frames())
            seen.append({k: sorted(map(tuple, df.collect()), key=str) for k, df in frames.items()})
        finally:
            spark.conf.set(name, old)
    assert seen[0] == seen[1]


def test_dashboard_of_empty_tables_shows_placeholders(spark):
    from ledgerloom.plans.dashboard import TITLES, dashboard_charts

    star = Star(spark, DATA)
    frames = {n: df.filter("false") for n, df in star.frames().items()}
    charts = dashboard_charts(frames, star.registry.filter("false")).collect()
    assert {r.key for r in charts} == {k for k in TITLES if not k.startswith("merchants_")}
    assert {(r.label, r.value) for r in charts if r.key != "entity_counts"} == {("—", 0.0)}
    assert [(r.ord, r.value) for r in sorted(charts, key=lambda r: r.ord) if r.key == "entity_counts"] == [
        (i, 0.0) for i in range(1, 6)]


@pytest.mark.parametrize("name", ["curate", "write_curated_csv", "load_curated"])
def test_curated_tables_share_one_join_of_the_transactions(spark, name, monkeypatch):
    """All that the three tables read of the transactions is what was joined and written once."""
    from ledgerloom.suite import sources

    seen, frames_of = [], kpi.curated_frames
    monkeypatch.setattr(sources.kpi, "curated_frames", lambda inputs: seen.append(frames_of(inputs)) or seen[-1])
    QUERIES[name].build(spark, DATA)
    (frames,) = seen
    assert all("l_orderkey" not in plan(df) and "lineitem" not in plan(df) for df in frames.values())
    direct = frames_of(Star(spark, DATA).frames())
    for table, df in frames.items():
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, direct[table].collect()), key=str)
