"""CSV scans and sinks with the dialect pinned down (doubled quotes, quoted newlines)."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import named, strip

RAW = "_raw_record"
FIELDS = "_field_count"
ROW_ORDER = "_row_order"


def quote_parity(line: Column) -> Column:
    """1 when the line holds an odd number of double quotes."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2


# So many files at most are named one by one in a plan.
NAMED_FILES = 2000


def files_with_quoted_newlines(spark: SparkSession, path: str | list[str]) -> tuple[list[str], int]:
    """The files in which some line has an odd number of quotes, i.e. a record may span lines; the number of all files.

    Spark cannot split a file it reads with ``multiLine``. One splittable pass over the lines settles
    which files need that; stray quotes only make it cautious.
    """
    lines = spark.read.text(path)
    by_file = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(quote_parity(F.col("value"))).alias("odd"))
    found = by_file.agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("odd") == 1, F.col("file"))).alias("odd")).first()
    return sorted(found.odd), found.n


def file_order(df: DataFrame) -> Column:
    """A column that sorts the rows of a scan as they stand in its files, and the files by path.

    Spark reads large splits first, so the order of the scan says nothing. A row's place is its
    file, the start of its split and the place within that; Parquet knows the row's number. Only a frame
    that no longer knows its files is left to the order of its partitions.
    """
    if ROW_ORDER in df.columns:
        return F.col(ROW_ORDER)
    known, in_split = _known_places(df), F.monotonically_increasing_id()
    if "file_path" not in known:
        return in_split
    if "row_index" in known:
        block, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:
        block, row = F.col("_metadata.file_block_start"), in_split
    return F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), row.alias("row"))


def _known_places(df: DataFrame) -> list[str]:
    """What Spark can tell of the files that the rows come from."""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    if [hidden.apply(i).name() for i in range(hidden.size())].count("_metadata") != 1:  # no files, or those of several tables
        return []
    return df.select("_metadata").schema["_metadata"].dataType.names


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by the column ``ROW_ORDER``, which is dropped.

    Mostly they are all in the first split of the first file, and only its rows are sorted then.
    """
    start = df.agg(F.min(ROW_ORDER).alias("at")).first()["at"]
    if start is not None:
        at = F.col(ROW_ORDER)
        head = df.filter((at["file"] == start.file) & (at["block"] == start.block))
        df = head if head.limit(n).count() == n else df
    return df.orderBy(ROW_ORDER).limit(n).drop(ROW_ORDER)


def _dialect(spark: SparkSession, multi_line: bool):
    return spark.read.options(
        quote='"', escape='"', multiLine=multi_line, encoding="UTF-8", maxCharsPerColumn=-1
    )


def has_quoted_newlines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a record may span lines in any of the files."""
    return bool(files_with_quoted_newlines(spark, path)[0])


def header_of(line: str) -> tuple[str, ...] | None:
    """Column names in a header line; None if the header goes on in the next line."""
    line = line.removeprefix("\ufeff")
    return tuple(next(csv.reader([line]))) if line.count('"') % 2 == 0 else None


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names as written in the first record; empty list when there is none."""
    lines = spark.read.text(path).filter("trim(value) <> ''").head(1)
    if not lines:
        return []
    header = header_of(lines[0].value)
    if header is not None:
        return list(header)
    # A name with a line break in it: let the multi-line reader find the record's end.
    first = _dialect(spark, True).option("header", False).csv(path).head(1)
    return [name if name is not None else "" for name in first[0]]


def _field_count(width: int) -> Column:
    """Fields in a record; Spark keeps the text only of records that do not fit the header."""
    unquoted = F.regexp_replace(F.col(RAW), r'"(?:[^"]|"")*"', "")
    commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))
    # Spark refuses plans that read nothing but the bad-record column, so name another.
    fits = F.col(RAW).isNull() & (F.length(F.coalesce("c0", F.lit(""))) >= 0)
    return F.when(fits, F.lit(width)).otherwise(commas + 1)


def scan_csv_raw(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool | None = None,
    keep_field_count: bool = False,
    keep_order: bool = False,
    header: list[str] | None = None,
) -> DataFrame:
    """Header CSV as all-string rows. Files read together all have the same header, which may be given.

    ``keep_order`` adds ``ROW_ORDER``, each row's place in the files; sorted by it, rows stand as written.

    Empty fields read as ``''``; fields a short row does not have are null; fields
    beyond the header are ignored unless the caller checks the kept field count. Of
    duplicate header names the last column wins. ``multi_line=None`` finds out in which files
    records span lines. Those are streamed by Spark's reader, one file to a task at any size; the
    others are read in splits if the order is kept, and else like those. Line breaks inside quotes stay as they are,
    save in a file whose lines end in CR LF or CR, where they read as LF.
    """
    header = header or csv_header(spark, path)
    if not header:
        raise ValueError("The file has no header.")
    spanning: list[str] = []
    if multi_line is None:
        spanning, files = files_with_quoted_newlines(spark, path)
        # Two scans no longer know their files' order, so they are only for callers that keep it.
        apart = keep_order and len(spanning) < files and len(spanning) <= NAMED_FILES
        multi_line, spanning = bool(spanning) and not apart, spanning if apart else []
    slots = [f"c{i}" for i in range(len(header))]
    schema = T.StructType(
        [T.StructField(s, T.StringType()) for s in slots] + [T.StructField(RAW, T.StringType())]
    )
    # A pruned parse would not notice that a record does not fit the header.
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW, "columnPruning": False}
    if keep_order and ROW_ORDER in header:
        raise ValueError(f"A column may not be named {ROW_ORDER}.")

    def scan(multi: bool, which: Column | None = None) -> DataFrame:
        rows = _dialect(spark, multi).schema(schema).options(header=True, **how).csv(path)
        rows = rows if which is None else rows.filter(which)  # a filter on file names prunes files
        rows = rows.withColumn(FIELDS, _field_count(len(header)))
        return rows.withColumn(ROW_ORDER, file_order(rows)) if keep_order else rows

    if spanning:
        is_spanning = F.col("_metadata.file_path").isin(spanning)
        rows = scan(False, ~is_spanning).unionByName(scan(True, is_spanning))
    else:
        rows = scan(multi_line)
    last = {name: i for i, name in enumerate(header)}
    columns = [
        F.when(F.col(FIELDS) > i, F.coalesce(F.col(slots[i]), F.lit(""))).alias(name or f"_c{i}")
        for name, i in last.items()
    ]
    kept = [name for name, keep in ((FIELDS, keep_field_count), (ROW_ORDER, keep_order)) if keep]
    return rows.select(*columns, *kept)


def scan_csv_job(spark: SparkSession, path: str) -> DataFrame:
    """Plain header scan used by the curation job on clean inputs."""
    return spark.read.option("header", True).csv(path)


def ragged_kind(width: int) -> Column:
    """``short`` / ``long`` / ``ok`` for rows scanned with the field count kept."""
    count = F.col(FIELDS)
    return F.when(count > width, "long").when(count < width, "short").otherwise("ok")


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV; cells keep their outer spaces. One file per partition."""
    (
        df.write.mode("overwrite")
        .options(
            header=True, quote='"', escape='"',
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Download format: every cell quoted, quotes doubled, null as an empty cell."""
    text = df.select([F.coalesce(named(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    (
        text.write.mode("overwrite")
        .options(
            header=True, quote='"', escape='"', quoteAll=True, emptyValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )


# What a column may be typed as, in order of preference: type and accepted notation.
DETECTED = [
    ("bigint", r"^[+-]?\d{1,18}$"),
    ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"),
    ("boolean", r"^(?i:true|false)$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"),
]


def detect_types(raw: DataFrame) -> dict[str, str]:
    """Type of each text column: the first that every non-empty cell fits, else string."""
    measures = []
    for i, name in enumerate(raw.columns):
        cell = F.nullif(strip(named(name)), F.lit(""))
        measures.append(F.count(cell).alias(f"n{i}"))
        for kind, notation in DETECTED:
            fits = cell.rlike(notation) & cell.try_cast(kind).isNotNull()
            measures.append(F.count_if(fits).alias(f"{kind}{i}"))
    seen = raw.agg(*measures).first()
    return {
        name: next((k for k, _ in DETECTED if seen[f"n{i}"] and seen[f"{k}{i}"] == seen[f"n{i}"]), "string")
        for i, name in enumerate(raw.columns)
    }


def load_warehouse_infer(spark: SparkSession, path: str, table: str, location: str) -> DataFrame:
    """Replace a table by a CSV whose column types are detected from all its rows."""
    return load_typed(scan_csv_raw(spark, path), table, location)


def load_typed(raw: DataFrame, table: str, location: str) -> DataFrame:
    """Replace a table by text rows, its column types detected from all of them."""
    typed = raw.select([
        (named(c) if kind == "string" else strip(named(c)).try_cast(kind)).alias(c)
        for c, kind in detect_types(raw).items()
    ])
    typed.write.mode("overwrite").option("path", location).saveAsTable(table)
    return raw.sparkSession.table(table)
