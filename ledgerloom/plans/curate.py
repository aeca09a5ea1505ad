"""The curation job: inputs, three KPI tables, typed load. Safe to run again."""

from __future__ import annotations

import argparse
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import as_money
from ledgerloom.plans.kpi import curated_frames
from ledgerloom.session import build_session, sized_shuffles
from ledgerloom.sources.contracts import CURATED, JOB_COLUMNS
from ledgerloom.sources.csv_files import write_csv
from ledgerloom.sources.files import Files
from ledgerloom.sources.versions import Versions
from ledgerloom.sources.zones import read_stored, require_inputs

STAGING = "_staging"


def read_inputs(spark: SparkSession, folder: str, staging: str | None = None) -> dict[str, DataFrame]:
    """The four inputs with only the columns the job reads.

    The folder holds ``NAME.parquet`` tables, or ``NAME.csv`` datasets: CSV files, or the
    published form of them. The
    transactions feed three tables: with a ``staging`` folder their text is parsed once
    into typed Parquet there, and each table then reads just its columns.
    """
    files = Files(spark)
    folder = folder.rstrip("/")
    if all(files.exists(f"{folder}/{n}.parquet") for n in JOB_COLUMNS):
        frames = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in JOB_COLUMNS}
    else:
        paths = require_inputs(spark, folder, list(JOB_COLUMNS))
        frames = {n: read_stored(spark, p) for n, p in paths.items()}
    for name, columns in JOB_COLUMNS.items():
        missing = [c for c in columns if c not in frames[name].columns]
        if missing:
            raise ValueError(f"{name}: missing columns {', '.join(missing)}")
    inputs = {n: frames[n].select(*columns) for n, columns in JOB_COLUMNS.items()}
    tx = inputs["fact_transactions"]
    if staging and dict(tx.dtypes)["amount"] == "string":
        path = f"{staging.rstrip('/')}/fact_transactions"
        money = tx.withColumn("amount", as_money(tx, "amount"))
        money.write.mode("overwrite").parquet(path)
        inputs["fact_transactions"] = spark.read.parquet(path)
    return inputs


def transactions_once(inputs: dict[str, DataFrame], staging: str) -> dict[str, DataFrame]:
    """The inputs with the transactions' columns written under ``staging`` and read back from there.

    For transactions that are themselves a join: all three tables, and the look for heavy ids,
    read them, and would shuffle that join's sides each time.
    """
    tx, path = inputs["fact_transactions"].select(*JOB_COLUMNS["fact_transactions"]), f"{staging.rstrip('/')}/fact_transactions"
    tx.write.mode("overwrite").parquet(path)
    return inputs | {"fact_transactions": tx.sparkSession.read.schema(tx.schema).parquet(path)}


def typed(df: DataFrame, table: str) -> DataFrame:
    """Columns in declared order with declared types."""
    return df.select([F.col(c).cast(t).alias(c) for c, t in CURATED[table].items()])


def load_curated(frames: dict[str, DataFrame], folder: str, version: str | None = None) -> dict[str, str]:
    """Write the curated Parquet tables as one version of ``folder`` and commit them together.

    ``read_curated`` sees the tables of one run, whatever breaks off here. The version before stays
    for those who still read it, older ones go. The rows are left unsorted; readers that want an
    order ask for it.
    """
    files = Files(next(iter(frames.values())).sparkSession)
    versions = Versions(files, folder)
    version = version or versions.begin()

    def write(name: str) -> None:
        typed(frames[name], name).write.mode("overwrite").parquet(f"{version}/{name}")

    # Independent jobs: one fills the executors another leaves idle.
    with ThreadPoolExecutor(len(frames)) as pool:
        list(pool.map(write, frames))
    files.remove(f"{version}/{STAGING}")
    versions.commit(version, tables=list(frames))
    versions.vacuum()
    return {name: f"{version}/{name}" for name in frames}


def curated_paths(spark: SparkSession, folder: str) -> dict[str, str]:
    """Where the tables of the newest committed run are."""
    commit = Versions(Files(spark), folder).current()
    if commit is None:
        raise FileNotFoundError(f"No curated tables in {folder}.")
    return {name: f"{commit['path']}/{name}" for name in commit["tables"]}


def read_curated(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The curated tables, all of one run."""
    return {name: spark.read.parquet(path) for name, path in curated_paths(spark, folder).items()}


def write_curated_csv(frames: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """The three outputs as header CSV folders, one file per task."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in frames}
    for name, df in frames.items():
        write_csv(typed(df, name), paths[name])
    return paths


def curate_and_load(spark: SparkSession, input_folder: str, output_folder: str) -> dict[str, DataFrame]:
    """Check inputs, compute, load; returns the loaded tables."""
    files = Files(spark)
    version = Versions(files, output_folder).begin()
    with sized_shuffles(spark, files.size(input_folder)):
        inputs = read_inputs(spark, input_folder, f"{version}/{STAGING}")
        load_curated(curated_frames(inputs), output_folder, version)
    return read_curated(spark, output_folder)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input-dir", required=True)
    parser.add_argument("--output-dir", required=True)
    args = parser.parse_args()
    curate_and_load(build_session("curation"), args.input_dir, args.output_dir)


if __name__ == "__main__":
    main()
