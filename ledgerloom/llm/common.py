"""Helpers shared by the operators: reading tables, staging frames, words of a text."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import shared_folder

# Whitespace is what ``bytes.split()`` splits on: \x20 and \x09-\x0D.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# Applications whose Python workers have been sent this package.
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless their search path has it already."""
    home, app = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.applicationId
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _SENT or home in map(os.path.realpath, filter(None, paths)) or not os.path.isdir(home):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom"), "zip", home, "ledgerloom")
    spark.sparkContext.addPyFile(archive)
    _SENT.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, lineage cut there.

    A lost executor costs only the tasks that read these files again.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text, bytes that are not UTF-8 are replaced."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def octets(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow column of texts; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case; other letters stay as they are."""
    return text.translate(_LOWER).split()


def slices(batch: pa.RecordBatch, column: str, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part holds about ``budget`` bytes of ``column``, one row at least."""
    at, rows = 0, batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * budget / max(1, batch.column(column).nbytes)))
    while at < rows:
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.column(column).nbytes > 4 * budget:  # some texts are very long
            for k in range(part.num_rows):
                yield part.slice(k, 1)
        else:
            yield part
        at += step


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """The batch with columns appended; one of the same name is replaced."""
    names = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in names] + list(new.values()), names=names + list(new))
