"""Landing to ready: scan, check, trim, profile, publish, mark."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ledgerloom.functions.text import named
from ledgerloom.operators.predicates import require_columns, trim_all
from ledgerloom.operators.profile import insights_of, profile_measures, with_numbers
from ledgerloom.operators.windows import latest_landed
from ledgerloom.plans.sql_workspace import sql_name
from ledgerloom.session import literal_rows
from ledgerloom.sources.csv_files import FIELDS, ROW_ORDER, file_order, header_of, load_typed, quote_parity, scan_csv_raw
from ledgerloom.sources.uploads import BAD, classification_of, contract_name, is_typed, scan_typed
from ledgerloom.sources.zones import Zones, base_name, utc_now

TOGETHER = 1000
# Folders of a joint write: the landing's number, and if rows are longer than the header.
LANDING, LONG = "_landing", "_long"


def write_processed(raw: DataFrame, path: str) -> tuple[int, Row]:
    """Write the trimmed rows as Parquet and profile them in the same pass.

    ``raw`` of a CSV keeps its field count: a row longer than the header fails the file, as does a JSON
    record that cannot be read. Its places in the landed files, if kept, are stored with the rows. Text
    cells are trimmed, those inside arrays and maps stay.
    """
    columns = [c for c in raw.columns if c not in (FIELDS, ROW_ORDER, BAD)]
    place = [ROW_ORDER] if ROW_ORDER in raw.columns else []
    long = F.col(FIELDS) > len(columns) if FIELDS in raw.columns else F.lit(False)
    bad = F.col(BAD).isNotNull() if BAD in raw.columns else F.lit(False)
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    seen = Observation("profile")
    watched = with_numbers(trim_all(raw), trimmed=True).observe(
        seen,
        F.count_if(long).alias("long_rows"),
        F.count_if(bad).alias("bad_rows"),
        *profile_measures(columns, trimmed=True, kinds=kinds),
    )
    watched.select(*[named(c) for c in columns], *place).write.mode("overwrite").parquet(path)
    measured = seen.get
    if measured["long_rows"]:
        raise ValueError(f"{measured['long_rows']} rows have more fields than the header.")
    if measured["bad_rows"]:
        raise ValueError(f"{measured['bad_rows']} records are not readable.")
    if measured["row_count"] == 0:
        raise ValueError("The file has a header but no rows.")
    return measured["row_count"], insights_of(measured, columns)


def publish(zones: Zones, processed: str, dataset: str) -> str:
    """Put the processed rows in their zone as a new generation by a rename; its path.

    Readers see the generation before it until this one is marked ready.
    """
    target = zones.generations(dataset).begin()
    zones.files.move(processed, target)
    return target


def load_stage(zones: Zones, dataset: str, path: str, database: str) -> tuple[str, str, str]:
    """Load a published generation as a typed table; a failure is reported, not raised."""
    table = sql_name(dataset, "uploaded_table")
    try:
        stored = zones.read_stored(path)
        load_typed(stored, f"{database}.{table}", f"{zones.root}/warehouse/{database}/{table}")
    except Exception as error:
        return ("warehouse_stage", "failed", str(error))
    return ("warehouse_stage", "passed", f"Loaded as {database}.{table}.")


def finish(
    zones: Zones, dataset: str, uploaded_at: str, processed: str, row_count: int, insights: Row, database: str | None = None,
) -> dict:
    """Publish processed rows, load them if asked, mark them ready; the registry entry of all that."""
    kind = classification_of(dataset)
    stages = [("processing_stage", "passed", f"{row_count} rows checked and trimmed.")]
    generation = publish(zones, processed, dataset)
    stages.append(("result_stage", "passed", f"Published in the {kind} zone."))
    if database:
        stages.append(load_stage(zones, dataset, generation, database))
    zones.mark_ready(dataset, generation=generation)
    stages.append(("analytics_ready_stage", "passed", "Ready for dashboards and SQL."))
    return {
        "dataset": dataset, "classification": kind, "uploaded_at": uploaded_at,
        "processed_at": utc_now().isoformat(), "pipeline_status": "analytics_ready",
        "status": "success", "row_count": row_count, "stages": stages, "insights": insights,
    }


def process_landing(
    zones: Zones, dataset: str, landing_file: str, uploaded_at: str, database: str | None = None
) -> dict:
    """Run one landed file through all stages and return its registry entry.

    With a ``database`` the published rows are also loaded there as a typed table.
    """
    name = base_name(dataset)
    path, processed = zones.landing(landing_file), zones.processing(landing_file)
    if is_typed(name):
        raw = scan_typed(zones.spark, path, name, keep_order=True)
    else:
        raw = scan_csv_raw(zones.spark, path, keep_field_count=True, keep_order=True)
    if classification_of(name) == "finance":
        require_columns(contract_name(name), raw.columns)
    try:
        row_count, insights = write_processed(raw, processed)
    except Exception:
        zones.files.remove(processed)
        raise
    return finish(zones, name, uploaded_at, processed, row_count, insights, database)


def process_all(
    zones: Zones, mode: str = "single", dataset: str | None = None, database: str | None = None,
) -> dict:
    """Process the newest landing of one dataset, or of every dataset that has one.

    A failing dataset is recorded and does not stop the others. Older landings of a
    processed dataset are listed as superseded, so they cannot overwrite the newer one.
    """
    mode = (mode or "single").lower().strip()
    if mode not in ("single", "all"):
        return {"error": "invalid_mode", "message": "The mode is single or all."}
    if mode == "single" and not dataset:
        return {"error": "dataset_required", "message": "Mode single needs a dataset."}
    pending = zones.registry()
    if mode == "single":
        name = base_name(dataset)
        pending = pending.filter(F.col("dataset") == name)
    results = process_entries(zones, pending, database)
    if not results:
        if mode == "single":
            return {"error": "not_found", "message": f"Nothing has landed for {name}."}
        return {"error": "nothing_pending", "message": "Nothing is waiting to be processed."}
    return {
        "mode": mode, "processed": results,
        "errors": [f"{r['dataset']}: {r['error']}" for r in results if not r["ok"]],
    }


def process_entries(zones: Zones, registry: DataFrame, database: str | None = None) -> list[dict]:
    """Process the newest pending landing of each dataset among the given registry rows.

    Landings with the same header are read, written and profiled together, so the number of Spark jobs
    goes by the number of different headers and not of landings.
    """
    pending = registry.filter(F.coalesce("landing_file", F.lit("")) != "")
    targets = latest_landed(pending).select("dataset", "landing_file", "uploaded_at")
    # One short row per dataset with a pending landing.
    entries = list(targets.orderBy("dataset").toLocalIterator())
    results = []
    for at in range(0, len(entries), TOGETHER):
        done = _process_some(zones, entries[at:at + TOGETHER], database)
        zones.record_many([r["payload"] for r in done if "payload" in r])
        results += done
    _supersede_older(zones, [r for r in results if r["ok"]])
    return results


def _process_some(zones: Zones, entries: list[Row], database: str | None) -> list[dict]:
    outcomes: dict[str, dict | Exception] = {}
    gone = [e for e in entries if not zones.files.exists(zones.landing(e.landing_file))]
    typed = [e for e in entries if e not in gone and is_typed(e.dataset)]
    there = [e for e in entries if e not in gone and e not in typed]
    groups: dict[tuple, list[Row]] = {(None, e.landing_file): [e] for e in typed}
    for entry, head in zip(there, landing_heads(zones, [e.landing_file for e in there])):
        if head is None or head[1] and head[0] is None:
            groups.setdefault((None, entry.landing_file), []).append(entry)  # no header, or one over several lines
            continue
        try:
            if classification_of(base_name(entry.dataset)) == "finance":
                require_columns(base_name(entry.dataset), list(head[0]))
            groups.setdefault(head, []).append(entry)
        except ValueError as error:
            outcomes[entry.landing_file] = error
    for (header, spans), members in groups.items():
        if header is not None and len(members) > 1:
            try:
                outcomes |= _process_group(zones, members, list(header), spans, database)
                continue
            except Exception:  # noqa: BLE001 - one by one, so that only what is bad fails
                pass
        for entry in members:
            try:
                outcomes[entry.landing_file] = process_landing(zones, entry.dataset, entry.landing_file, entry.uploaded_at, database)
            except Exception as error:  # noqa: BLE001 - recorded
                outcomes[entry.landing_file] = error
    results = []
    for entry in entries:
        about = {"dataset": entry.dataset, "uploaded_at": entry.uploaded_at}
        if entry in gone:
            results.append({**about, "ok": False, "error": f"landed file is gone: {entry.landing_file}"})
            continue
        outcome = outcomes[entry.landing_file]
        if isinstance(outcome, Exception):
            payload = {**about, "pipeline_status": "failed", "status": "failed", "error": str(outcome),
                       "stages": [("processing_stage", "failed", str(outcome))]}
            results.append({**about, "ok": False, "error": str(outcome), "payload": payload})
        else:
            results.append({**about, "ok": True, "payload": outcome})
    return results


def _landing_of(zones: Zones, file: Column) -> Column:
    """The landing's name, as it stands in the URI of one of its files."""
    folder = re.escape(zones.files.uri_path(zones.landing("x")).rpartition("/")[0])
    return F.regexp_extract(file, f"{folder}/([^/]+)", 1)


def _uri_name(zones: Zones, landing_file: str) -> str:
    return zones.files.uri_path(zones.landing(landing_file)).rpartition("/")[2]


def landing_heads(zones: Zones, landings: list[str]) -> list[tuple | None]:
    """For each landing its header and if a record may span lines, from one pass over all of them.

    The header is None if it spans lines itself; a landing without any line is None.
    """
    if not landings:
        return []
    lines = zones.spark.read.text([zones.landing(f) for f in landings]).filter("trim(value) <> ''")
    lines = lines.select("value", file_order(lines).alias("at"))
    heads = lines.groupBy(_landing_of(zones, F.col("at.file")).alias("landing")).agg(
        F.min_by("value", "at").alias("head"), F.max(quote_parity(F.col("value"))).alias("odd"))
    found = {r.landing: (header_of(r.head), bool(r.odd)) for r in heads.collect()}
    return [found.get(_uri_name(zones, f)) for f in landings]


def _process_group(zones: Zones, entries: list[Row], header: list[str], spans: bool, database: str | None) -> dict:
    """Outcomes by landing of landings that share a header: one write by landing, one profile by landing."""
    batch = f"{zones.root}/processing/_batch-{uuid.uuid4().hex}"
    try:
        raw = scan_csv_raw(
            zones.spark, [zones.landing(e.landing_file) for e in entries], spans, keep_field_count=True, keep_order=True, header=header)
        columns = [c for c in raw.columns if c not in (FIELDS, ROW_ORDER)]
        # At most TOGETHER short rows.
        numbers = literal_rows(zones.spark, [(_uri_name(zones, e.landing_file), k) for k, e in enumerate(entries)], f"{LANDING}_name, {LANDING}")
        rows = trim_all(raw).withColumn(f"{LANDING}_name", _landing_of(zones, F.col(ROW_ORDER)["file"]))
        rows = rows.join(F.broadcast(numbers), f"{LANDING}_name").withColumn(LONG, F.col(FIELDS) > len(columns))
        rows = rows.select(*[named(c) for c in columns], ROW_ORDER, LANDING, LONG)
        rows.write.partitionBy(LANDING, LONG).parquet(batch)
        written = zones.spark.read.schema(rows.withColumn(LONG, F.col(LONG).cast("string")).schema).parquet(batch)
        # Cells first, as the measures count columns by their place.
        measured = with_numbers(written.select(*[named(c) for c in columns], LANDING, LONG), trimmed=True)
        profiles = measured.groupBy(LANDING, LONG).agg(*profile_measures(columns, trimmed=True)).collect()
        of = {(int(r[LANDING]), str(r[LONG]) == "true"): r.asDict() for r in profiles}
        outcomes: dict = {}
        for k, entry in enumerate(entries):
            try:
                if (k, True) in of:
                    raise ValueError(f"{of[k, True]['row_count']} rows have more fields than the header.")
                if (k, False) not in of:
                    raise ValueError("The file has a header but no rows.")
                processed = f"{batch}/{LANDING}={k}/{LONG}=false"
                outcomes[entry.landing_file] = finish(
                    zones, base_name(entry.dataset), entry.uploaded_at, processed, of[k, False]["row_count"], insights_of(of[k, False], columns), database)
            except Exception as error:  # noqa: BLE001 - recorded for this landing alone
                outcomes[entry.landing_file] = error
        return outcomes
    finally:
        zones.files.remove(batch)


def _supersede_older(zones: Zones, done: list[dict]) -> None:
    """List older landings of the processed datasets as superseded, in one commit."""
    for at in range(0, len(done), TOGETHER):
        newest = literal_rows(zones.spark, [(r["dataset"], r["uploaded_at"]) for r in done[at:at + TOGETHER]], "dataset, newest")
        older = zones.registry().filter(F.col("pipeline_status") == "landed").join(F.broadcast(newest), "dataset")
        older = older.filter(F.col("uploaded_at") < F.col("newest")).select("dataset", "uploaded_at")
        zones.record_many([{**row.asDict(), "pipeline_status": "superseded"} for row in older.toLocalIterator()])
