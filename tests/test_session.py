from __future__ import annotations

from types import SimpleNamespace

import pytest

from ledgerloom.session import literal_rows, shared_folder, sized_shuffles


def fake(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_shared_folder_follows_the_session():
    one, two = (shared_folder(fake("spark://x", "s3a://bucket/ck/"), "csv") for _ in range(2))
    assert one.startswith("s3a://bucket/ck/ledgerloom/csv-") and one != two


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(fake("yarn"), "csv")


def test_local_sessions_get_a_folder_of_their_own():
    one, two = (shared_folder(fake("local[4]"), "x") for _ in range(2))
    assert one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]


def test_literal_rows(spark):
    df = literal_rows(spark, [("it's \\ —", 1, 0.5), ("b", 2, 1e300)], "a, b, c")
    assert [tuple(r) for r in df.collect()] == [("it's \\ —", 1, 0.5), ("b", 2, 1e300)]


def test_shuffles_grow_with_the_input(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    with sized_shuffles(spark, 10 * 2**40) as n:
        assert n == 81920 and spark.conf.get(name) == "81920"
    with sized_shuffles(spark, 1) as n:
        assert n == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get(name, None) is None
