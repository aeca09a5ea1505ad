"""Spark session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PARTITION_BYTES = 128 * 1024 * 1024


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every plan in this package assumes (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int) -> Iterator[int]:
    """Run a job whose shuffles start with partitions of about 128 MB of input.

    The session default of a few hundred would make them gigabytes wide on a large input.
    Starting high is safe: adaptive execution merges what turns out to be small.
    """
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // PARTITION_BYTES))
    old = spark.conf.get(name, None)
    spark.conf.set(name, str(wanted))
    try:
        yield wanted
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


# Temporary folders of local sessions, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach, under ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a temporary
    folder of its own, because driver and executors are the same machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        base = _LOCAL_FOLDERS[app]
    return f"{base.rstrip('/')}/ledgerloom/{label}-{uuid.uuid4().hex}"


def literal_rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few constant rows as a local relation (no Python workers); ``columns`` like ``a, b``."""
    def sql(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{value!r}D" if isinstance(value, float) else str(value)

    values = ", ".join("(" + ", ".join(sql(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")
