"""Zones of a data root: landing, processing, published, markers and the registry log.

A published dataset is stored once, under its classification; that folder is both the
published copy and the finance or external copy. It holds the dataset's generations: publishing adds one
that nobody sees, and marking it ready is one commit that makes its rows and its time those that readers
find. The marker file beside it opens the gate. All paths are Hadoop URIs.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.numbers import clamp
from ledgerloom.operators.limits import newest_n
from ledgerloom.operators.registry import KEPT
from ledgerloom.session import literal_rows
from ledgerloom.sources.contracts import (
    AUDIT, ETL_JOB, GATED, REGISTRY, REQUIRED_COLUMNS, STAGE,
)
from ledgerloom.sources.csv_files import ROW_ORDER, file_order, first_rows, scan_csv_raw
from ledgerloom.sources.files import Files
from ledgerloom.sources.logs import JsonLog, read_json_log
from ledgerloom.sources.uploads import classification_of, scan_upload
from ledgerloom.sources.versions import Versions


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


class Zones:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = Files(spark)
        self.log = JsonLog(spark, f"{self.root}/metadata/dataset_registry", REGISTRY, folded)
        self.audit = JsonLog(spark, f"{self.root}/metadata/audit_logs", AUDIT)
        self.jobs = JsonLog(spark, f"{self.root}/metadata/etl_jobs", ETL_JOB)

    # Paths
    def landing(self, file: str) -> str:
        return f"{self.root}/landing/{file}"

    def processing(self, file: str) -> str:
        return f"{self.root}/processing/{file}"

    def published(self, dataset: str, classification: str | None = None) -> str:
        return f"{self.root}/published/{classification or classification_of(dataset)}/{dataset}"

    def failed(self, file: str) -> str:
        return f"{self.root}/failed/{file}"

    def marker(self, dataset: str, kind: str = "analytics_ready") -> str:
        return f"{self.root}/activated/{dataset}.{kind}"

    # Generations
    def generations(self, dataset: str, classification: str | None = None) -> Versions:
        return Versions(self.files, self.published(dataset, classification))

    def stored(self, dataset: str, classification: str | None = None) -> str | None:
        """Path of the rows that readers see: the committed generation, or files put there by hand."""
        return stored_path(self.files, self.published(dataset, classification))

    # Markers
    def is_ready(self, dataset: str) -> bool:
        return self.files.exists(self.marker(dataset))

    def mark_ready(self, dataset: str, stamp: str | None = None, generation: str | None = None) -> None:
        """Open the gate; with a published ``generation``, make it the one that readers see, in one commit."""
        name, stamp = base_name(dataset), stamp or utc_now().isoformat()
        if generation is not None:
            versions = Versions(self.files, generation.rsplit("/versions/", 1)[0])
            versions.commit(generation, ready_at=stamp)
            versions.vacuum()
        self.files.write_marker(self.marker(name), stamp)

    def ready_at(self, dataset: str) -> str | None:
        """When the rows that readers see became ready; null for a dataset that is not."""
        commit = self.generations(dataset).current()
        if not self.is_ready(dataset):
            return None
        return commit["ready_at"] if commit else self.files.read_marker(self.marker(dataset)).strip()

    def migrate_ok(self) -> list[str]:
        """Promote legacy ``ok`` markers of gated datasets that have no newer marker."""
        moved = []
        for name in GATED:
            old, new = self.marker(name, "ok"), self.marker(name)
            if self.files.exists(old) and not self.files.exists(new):
                self.files.write_marker(new, self.files.read_marker(old))
                moved.append(name)
        return moved

    # Reading
    def read_stored(self, path: str, keep_order: bool = False) -> DataFrame:
        return read_stored(self.spark, path, keep_order)

    def star_frames(self, strict: bool = False) -> dict[str, DataFrame | None]:
        """The gated datasets by table name, as the dashboard reads them.

        A missing dataset has no rows; missing merchants are None, for without them there
        are no merchant lists. Merchants know their places, for the last row of an id names it.
        """
        frames = {
            name.removesuffix(".csv"): self.scan_gated(name, strict=strict, keep_order=name == "dim_merchants.csv")
            for name in GATED
        }
        if self.resolve("dim_merchants.csv", strict) is None:
            frames["dim_merchants"] = None
        return frames

    def resolve(self, dataset: str, strict: bool = False) -> str | None:
        """Path behind the readiness gate, or None when the dataset must read as empty.

        A gated dataset without a marker still opens when its file is not empty;
        ``strict`` turns that exception off.
        """
        path = self.stored(dataset)
        if path is None:
            return None
        if dataset not in GATED or self.is_ready(dataset):
            return path
        return path if not strict and self.files.size(path) > 0 else None

    def scan_gated(
        self, dataset: str, columns: list[str] | None = None, strict: bool = False, keep_order: bool = False
    ) -> DataFrame:
        """The dataset, or a frame of no rows when it is missing."""
        path = self.resolve(dataset, strict)
        if path is None or self.files.size(path) == 0:
            names = columns or REQUIRED_COLUMNS.get(dataset, ["value"])
            schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
            return self.spark.createDataFrame([], schema)
        return self.read_stored(path, keep_order)

    def kpi_sources(self, names: list[str]) -> DataFrame:
        """Per KPI table: where its rows are found behind the gate (null if nowhere), and if it is marked ready."""
        rows = []
        for name in names:
            ready = self.is_ready(name) and self.stored(name) is not None
            rows.append((name, "" if self.resolve(name) is None else self.published(name), 1 if ready else 0))
        listed = literal_rows(self.spark, rows, "name, path, ready")
        return listed.select("name", F.nullif("path", F.lit("")).alias("path"), (F.col("ready") == 1).alias("analytics_ready"))

    def preview(self, dataset: str, n: int = 25, order_by=None) -> DataFrame:
        """First rows (1 to 200), as uploaded, of the finance, else external, else landed copy."""
        name = base_name(dataset)
        path, n = self.stored(name, "finance") or self.stored(name, "external"), clamp(n, 1, 200)
        rows = None
        if path is None:
            landed = (
                self.registry().filter((F.col("dataset") == name) & (F.col("pipeline_status") == "landed"))
                .orderBy(F.desc("uploaded_at"), F.desc("seq")).select("landing_file").first()
            )
            if landed and landed.landing_file and self.files.exists(self.landing(landed.landing_file)):
                rows = scan_upload(self.spark, self.landing(landed.landing_file), name, keep_order=True)
        else:
            rows = self.read_stored(path, keep_order=True)
        if rows is None:
            raise ValueError(f"No stored copy of {name}.")
        return first_rows(rows, n) if order_by is None else rows.orderBy(order_by).limit(n).drop(ROW_ORDER)

    # Registry: an append-only log; the newest non-null value of each field wins.
    def record(self, **fields) -> dict:
        return self.record_many([fields])[0]

    def record_many(self, entries: list[dict]) -> list[dict]:
        """Add registry entries in one commit."""
        return self.log.append_many([
            {**e, "stages": [dict(zip(STAGE.names, stage)) for stage in e["stages"]]} if e.get("stages") else e for e in entries])

    def registry(self) -> DataFrame:
        """One row per landing: (uploaded_at, dataset), with later entries folded in."""
        return folded(self.log.frame())

    def catalog(self) -> DataFrame:
        """The newest registry rows, as listed to users."""
        return newest_n(self.registry(), KEPT, F.desc("uploaded_at"), F.desc("seq"))

    def compact(self) -> None:
        """Fold the log now; it folds itself every so many entries."""
        self.log.rewrite(folded)

    def retire(self, dataset: str) -> dict:
        """Drop a dataset's registry rows and stored copies; the log is rewritten without it."""
        name = base_name(dataset)
        mine = self.registry().filter(F.col("dataset") == name)
        landings = [r.landing_file for r in mine.select("landing_file").toLocalIterator()]
        if not landings:
            return {"deleted": False, "error": "not_found",
                    "message": f"{name} is not in the registry."}
        self.log.rewrite(lambda log: log.filter(~F.col("dataset").eqNullSafe(name)))
        for file in filter(None, landings):
            self.files.remove(self.landing(file))
            self.files.remove(self.processing(file))
        for kind in ("finance", "external"):
            self.files.remove(self.published(name, kind))
        for kind in ("analytics_ready", "ok"):
            self.files.remove(self.marker(name, kind))
        return {"deleted": True, "dataset": name, "removed_entries": len(landings)}

    # Landing
    def land(self, incoming: str, dataset: str | None = None, now: dt.datetime | None = None) -> dict:
        """Move an upload (CSV, Parquet or JSON by its name) into the landing zone and list it as ``landed``."""
        now = now or utc_now()
        name = base_name(dataset or incoming)
        file = f"{now.strftime('%Y%m%dT%H%M%SZ')}_{name}"
        about = {"dataset": name, "classification": classification_of(name),
                 "uploaded_at": now.isoformat()}
        try:
            if self.files.size(incoming) == 0:
                raise ValueError("The uploaded file has no content.")
            self.files.move(incoming, self.landing(file))
        except Exception as error:
            if self.files.exists(incoming):
                self.files.move(incoming, self.failed(file))
            return self.record(**about, status="failed", error=str(error),
                               stages=[("input_stage", "failed", str(error))])
        return self.record(
            **about, landing_file=file, pipeline_status="landed", status="landed",
            stages=[("input_stage", "passed", f"Landed as {file}.")],
        )


def folded(log: DataFrame) -> DataFrame:
    """A registry log as one row per landing; the newest non-null value of each field wins."""
    keys = ["uploaded_at", "dataset"]
    rest = [c for c in REGISTRY.names if c not in keys and c != "seq"]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in rest]
    return log.groupBy(*keys).agg(F.min("seq").alias("seq"), *latest).select(*REGISTRY.names)


def stored_path(files: Files, path: str) -> str | None:
    """Where a published dataset's rows are now; None if there is nothing that readers may see."""
    commit = Versions(files, path).current()
    if commit is not None:
        return commit["path"]
    return path if files.exists(path) and not files.exists(f"{path}/versions") else None


def read_stored(spark: SparkSession, path: str, keep_order: bool = False) -> DataFrame:
    """A stored dataset: Parquet written by this package, or a CSV put there by hand.

    ``path`` may be a dataset's folder, which stands for the generation that counts now.
    ``keep_order`` adds ``ROW_ORDER``, each row's place in the uploaded files.
    """
    files = Files(spark)
    found = stored_path(files, path)
    if found is None:
        raise FileNotFoundError(f"Nothing is published in {path}.")
    path = found
    if not any(name.endswith(".parquet") for name in files.names(path)):
        return scan_csv_raw(spark, path, keep_order=keep_order)
    rows = spark.read.parquet(path)
    if not keep_order:
        return rows.drop(ROW_ORDER)
    return rows if ROW_ORDER in rows.columns else rows.withColumn(ROW_ORDER, file_order(rows))


def registry_read(spark: SparkSession, path: str) -> DataFrame:
    return read_json_log(spark, path, REGISTRY)


def require_inputs(spark: SparkSession, folder: str, names: list[str]) -> dict[str, str]:
    """Paths of the job inputs; raises with all missing names."""
    files = Files(spark)
    paths = {n: f"{folder.rstrip('/')}/{n}.csv" for n in names}
    missing = [f"{n}.csv" for n, p in paths.items() if not files.exists(p)]
    if missing:
        raise FileNotFoundError(f"Inputs not found: {missing}")
    return paths


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
