"""Job and audit records."""

from __future__ import annotations

import time
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.joins import reconcile_job_status
from ledgerloom.operators.limits import newest_n
from ledgerloom.operators.registry import KEPT, SHOWN, delegate_summary
from ledgerloom.sources.zones import Zones, utc_now


def audit(zones: Zones, action: str, outcome: str, details: str, username: str = "anonymous") -> dict:
    return zones.audit.append(
        timestamp=utc_now().isoformat(), username=username, action=action, outcome=outcome,
        details=details,
    )


def audit_trail(zones: Zones) -> DataFrame:
    """The newest audit records."""
    return zones.audit.newest(SHOWN)


def record_job(
    zones: Zones, job_name: str, triggered_by: str, run_id: str | None = None,
    state: str | None = None, error: str | None = None,
) -> dict:
    """Log a job with the registry totals of this moment.

    ``run_id`` is the orchestrator's run; a job without one is done with its summary.
    """
    queued = bool(run_id) and not error
    return zones.jobs.append(
        job_id=str(uuid4()), job_name=job_name, triggered_by=triggered_by,
        triggered_at=utc_now().isoformat(), status="queued" if queued else "completed",
        run_id=run_id, state=state,
        message=None if queued else f"No run was queued: {error or 'no orchestrator'}.",
        stages=["trigger", "delegate_summary"],
        summary=delegate_summary(zones.registry()).first(),
    )


def jobs(zones: Zones) -> DataFrame:
    """Every job with its latest status, from the entries logged for it."""
    log = zones.jobs.frame()
    rest = [c for c in log.columns if c not in ("job_id", "seq")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in rest]
    return log.groupBy("job_id").agg(F.min("seq").alias("seq"), *newest).select(*log.columns)


def job_list(zones: Zones) -> DataFrame:
    return newest_n(jobs(zones), KEPT, F.desc("seq"))


def sync_jobs(zones: Zones, runs: DataFrame) -> None:
    """Log the jobs whose status or state the given (run_id, new_state) rows change."""
    before = jobs(zones)
    after = reconcile_job_status(before.select("job_id", "run_id", "status", "state", "message"), runs)
    was = before.select("job_id", F.col("status").alias("_status"), F.col("state").alias("_state"))
    changed = after.join(was, "job_id").filter(
        ~(F.col("status").eqNullSafe(F.col("_status")) & F.col("state").eqNullSafe(F.col("_state")))
    )
    schema = zones.jobs.schema
    known = {"job_id", "run_id", "status", "state", "message"}
    zones.jobs.append_rows(changed.select([
        F.lit(time.time_ns()).alias("seq") if f.name == "seq"
        else F.col(f.name) if f.name in known
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]))
