"""Scan runs: an append-only log of what happened to each, and the state it adds up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

EVENTS = (
    "scan_id string, event_time timestamp, status string, url string, pages_scanned int, total_issues int, "
    "started_at timestamp, completed_at timestamp, error string"
)
FIELDS = ("url", "pages_scanned", "total_issues", "started_at", "completed_at", "error")
TEXTS = ("url", "error")
DELETED = "deleted"
LIFE = ("pending", "running", "failed", "completed", DELETED)


def _latest(name: str):
    return F.expr(f"max_by({name}, CASE WHEN {name} IS NOT NULL THEN moment END) AS {name}")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def current_runs(events: DataFrame) -> DataFrame:
    """The state of every run: latest status, and of each field the latest value given.

    Of events of the same time the one further on in a run's life counts. A deleted run is gone for good, whatever is
    appended later. Maxima combine before the shuffle, so a run with very many events costs no more than others.
    """
    known = ", ".join(f"'{status}'" for status in LIFE)
    # One number to compare by; its remainder is the stage. Numbers and times are aggregated by hash; text, which few events have and
    # which has to be sorted for it, apart from them. Both sides are grouped by run already when they meet.
    if isinstance(events.schema["event_time"].dataType, T.TimestampNTZType):
        micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', event_time)"
    else:
        micros = "unix_micros(event_time)"
    stages = len(LIFE) + 1
    events = events.withColumn("moment", F.expr(f"{micros} * {stages} + coalesce(array_position(array({known}), status), 0)"))
    numbers = [_latest(name) for name in FIELDS if name not in TEXTS]
    state = events.groupBy("scan_id").agg(
        F.max("moment").alias("moment"), F.max(F.col("status") == DELETED).alias("gone"), *numbers,
    )
    worded = events.where(f"url IS NOT NULL OR error IS NOT NULL OR pmod(moment, {stages}) = 0").groupBy("scan_id").agg(
        *map(_latest, TEXTS), F.expr(f"max_by(status, CASE WHEN pmod(moment, {stages}) = 0 THEN moment END) AS other"),
    )
    status = f"CASE WHEN pmod(moment, {stages}) = 0 THEN other ELSE get(array({known}), cast(pmod(moment, {stages}) - 1 AS INT)) END"
    state = state.join(worded, "scan_id", "left").selectExpr("scan_id", f"{status} AS status", "gone", *FIELDS)
    counted = {name: F.coalesce(name, F.lit(0)) for name in ("pages_scanned", "total_issues")}
    return state.where("NOT coalesce(gone, false)").drop("gone").withColumns(counted)


def recent_runs(events: DataFrame, limit: int = 10) -> DataFrame:
    """The runs started last; those never started come last."""
    return current_runs(events).orderBy(F.desc_nulls_last("started_at"), "scan_id").limit(limit)


def get_run(events: DataFrame, scan_id: str) -> DataFrame:
    """One run; unknown or deleted runs are an error."""
    found = current_runs(events.where(F.col("scan_id") == scan_id))
    if found.isEmpty():
        raise KeyError(f"no scan {scan_id}")
    return found


def deletion(events: DataFrame, scan_id: str) -> DataFrame:
    """The event that deletes a run, to be appended; unknown runs are an error."""
    get_run(events, scan_id)
    row = events.where(F.col("scan_id") == scan_id).agg(F.expr("max(event_time) + INTERVAL 1 MICROSECOND AS event_time"))
    nulls = [F.lit(None).cast(events.schema[name].dataType).alias(name) for name in FIELDS]
    return row.select(F.lit(scan_id).alias("scan_id"), "event_time", F.lit(DELETED).alias("status"), *nulls)
