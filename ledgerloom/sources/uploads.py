"""Uploads with a schema of their own, Parquet and JSON, beside CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import named
from ledgerloom.sources.contracts import REQUIRED_COLUMNS
from ledgerloom.sources.csv_files import ROW_ORDER, file_order, scan_csv_raw

PARQUET, JSON = (".parquet",), (".json", ".jsonl", ".ndjson")
BAD = "_bad_record"


def is_typed(name: str) -> bool:
    """Whether an upload of this name brings its own types."""
    return name.lower().endswith((*PARQUET, *JSON))


def contract_name(dataset: str) -> str:
    """The name under which a dataset's required columns are listed: a typed upload stands for its table."""
    return dataset.rsplit(".", 1)[0] + ".csv" if is_typed(dataset) else dataset


def classification_of(dataset: str) -> str:
    return "finance" if contract_name(dataset) in REQUIRED_COLUMNS else "external"


def _leaves(kind: T.StructType, value: Column | None, name: str) -> list[tuple[str, Column]]:
    out = []
    for field in kind.fields:
        own = named(field.name) if value is None else value.getField(field.name)
        full = f"{name}.{field.name}" if name else field.name
        if isinstance(field.dataType, T.StructType):
            out += _leaves(field.dataType, own, full)
        else:
            out.append((full, own))
    return out


def flat(df: DataFrame) -> DataFrame:
    """Fields of structs as columns ``outer.inner``, at any depth; arrays and maps stay what they are.

    Two fields that would get one name, as in a column ``a.b`` beside a struct ``a`` with ``b``, are refused.
    """
    leaves = _leaves(df.schema, None, "")
    names = [n for n, _ in leaves]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"Columns of one name: {', '.join(twice)}.")
    return df.select([c.alias(n) for n, c in leaves])


def scan_typed(spark: SparkSession, path: str, name: str, keep_order: bool = False) -> DataFrame:
    """A Parquet or JSON upload with flat columns; ``BAD`` holds the text of JSON records that cannot be read.

    JSON is an object per line, or arrays of objects, one to a file. Types come from all records; ``keep_order``
    adds each row's place in the files.
    """
    if name.lower().endswith(PARQUET):
        rows, bad = spark.read.option("mergeSchema", True).parquet(path), []
    else:
        first = spark.read.text(path).filter("trim(value) <> ''").head(1)
        if not first:
            raise ValueError("The file has no records.")
        reader = spark.read.options(columnNameOfCorruptRecord=BAD, multiLine=first[0].value.lstrip().startswith("["))
        kind = reader.json(path).schema
        kind = T.StructType([*[f for f in kind.fields if f.name != BAD], T.StructField(BAD, T.StringType())])
        rows, bad = reader.schema(kind).json(path), [BAD]
    if keep_order and ROW_ORDER in rows.columns:
        raise ValueError(f"A column may not be named {ROW_ORDER}.")
    place = [file_order(rows).alias(ROW_ORDER)] if keep_order else []
    data = rows.drop(*bad)
    if not data.columns:
        raise ValueError("The file has no columns.")
    leaves = flat(data).columns
    flatted = rows.select(*[c.alias(n) for n, c in _leaves(data.schema, None, "")], *bad, *place)
    return flatted.select(*[named(c) for c in leaves], *bad, *([ROW_ORDER] if keep_order else []))


def scan_upload(spark: SparkSession, path: str, name: str, keep_order: bool = False) -> DataFrame:
    """An upload of any kind, as its name says."""
    if is_typed(name):
        return scan_typed(spark, path, name, keep_order).drop(BAD)
    return scan_csv_raw(spark, path, keep_order=keep_order)
