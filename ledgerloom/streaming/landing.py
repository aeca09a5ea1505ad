"""Incremental form of "process everything that is pending"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.ingest import process_entries
from ledgerloom.sources.contracts import REGISTRY
from ledgerloom.sources.zones import Zones


def process_new_landings(zones: Zones, checkpoint: str) -> StreamingQuery:
    """Process the landings recorded since the last run, then stop.

    The registry log's commits are the stream: each is seen once, and a restarted run repeats
    only the batch it had not finished. A batch only says that there is news; what is pending is
    asked of the registry, for commits that a snapshot has taken in may be gone. Repeating
    a batch is harmless, because publishing replaces and the registry keeps the newest value of
    each field.
    """
    zones.files.make_folder(f"{zones.log.path}/entries")
    log = zones.spark.readStream.schema(REGISTRY).json(f"{zones.log.path}/entries")

    def run(_batch: DataFrame, _batch_id: int) -> None:
        process_entries(zones, zones.registry().filter(F.col("pipeline_status") == "landed"))

    return (
        log.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
