"""Run registered queries in Spark and their SQL in DuckDB and compare all rows.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


_SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def duck_type(spark_type: str) -> str:
    return _SAME.get(spark_type, spark_type.upper())


def compare(df, con, sql: str) -> str | None:
    """None when names, types and all rows agree, else what differs."""
    result = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(result.columns):
        return f"columns {names} vs {sorted(result.columns)}"
    types = {f.name: duck_type(f.dataType.simpleString()) for f in df.schema.fields}
    want_types = {n: str(t) for n, t in zip(result.columns, result.types)}
    want = Counter(
        tuple(cell(v) for _, v in sorted(zip(result.columns, row))) for row in result.fetchall())
    got = Counter(tuple(cell(r[n]) for n in names) for r in df.collect())
    if got != want:
        return (f"rows {sum(got.values())} vs {sum(want.values())}; "
                f"only spark {list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]}")
    off = {n: (types[n], want_types[n]) for n in names if types[n].replace(" ", "") != want_types[n].replace(" ", "")}
    return f"types {off}" if off else None


def main() -> None:
    from ledgerloom.session import build_session
    from ledgerloom.suite import QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    start = time.time()
    for name in names:
        q, began = QUERIES[name], time.time()
        try:
            df = q.build(spark, folder)
            problem = compare(df, con, q.sql) if q.sql else f"rows only: {df.count()}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - began:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{len(names)} queries, {bad} not ok, {time.time() - start:.1f}s")


if __name__ == "__main__":
    main()
