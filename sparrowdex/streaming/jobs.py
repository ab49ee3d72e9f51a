"""Ingest jobs: the state machine as column expressions, and streams that drive it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE = "INTERVAL 5 MINUTES"
KEEP = "INTERVAL 7 DAYS"
ATTEMPTS = 3
ERROR_CHARS = 1000


def _at(now: datetime) -> F.Column:
    return F.lit(now).cast("timestamp")


def claim(jobs: DataFrame, slots: int, now: datetime) -> DataFrame:
    """The oldest pending jobs, as processing. One writer claims for all workers, so no two get the same job."""
    rows = jobs.filter("status = 'pending'").orderBy("created_at", "id").limit(slots)
    return rows.withColumns({"status": F.lit("processing"), "updated_at": _at(now)})


def reclaim(jobs: DataFrame, now: datetime, *, attempts: int = ATTEMPTS) -> DataFrame:
    """Jobs with those that stopped reporting put back to pending, or to failed after the last attempt; changed tells which."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < _at(now) - F.expr(STALE))
    last = F.col("attempt") + 1 >= attempts
    return jobs.withColumn("changed", F.coalesce(stale, F.lit(False))).withColumns(
        {
            "status": F.when(F.col("changed"), F.when(last, "failed").otherwise("pending")).otherwise(F.col("status")),
            "attempt": F.when(F.col("changed"), F.col("attempt") + 1).otherwise(F.col("attempt")),
        }
    )


def failed_documents(reclaimed: DataFrame) -> DataFrame:
    return reclaimed.filter("changed AND status = 'failed'").select("document_id").distinct()


def reapable(jobs: DataFrame, now: datetime, limit: int = 100) -> DataFrame:
    """Failed jobs whose files have been kept long enough."""
    old = (F.col("status") == "failed") & F.col("blob_key").isNotNull() & (F.col("updated_at") < _at(now) - F.expr(KEEP))
    return jobs.filter(old).orderBy("updated_at", "id").limit(limit)


def finish(jobs: DataFrame, outcomes: DataFrame, now: datetime) -> DataFrame:
    """Jobs with the outcomes (id, error: null for success); errors are cut to 1000 characters."""
    o = outcomes.select("id", F.substring("error", 1, ERROR_CHARS).alias("_e"), F.lit(True).alias("_o"))
    rows = jobs.drop("error").join(o, "id", "left")
    done = F.col("_o").isNotNull()
    return rows.withColumns(
        {
            "status": F.when(done, F.when(F.col("_e").isNull(), "success").otherwise("failed")).otherwise(F.col("status")),
            "updated_at": F.when(done, _at(now)).otherwise(F.col("updated_at")),
        }
    ).withColumnRenamed("_e", "error").drop("_o")


def heartbeat(jobs: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Jobs whose workers (ids: id) report: those that are being worked on count as touched now, others stay as they are."""
    rows = jobs.join(ids.select("id").distinct().withColumn("_o", F.lit(True)), "id", "left")
    alive = F.col("_o").isNotNull() & (F.col("status") == "processing")
    return rows.withColumn("updated_at", F.when(alive, _at(now)).otherwise(F.col("updated_at"))).drop("_o")


def update_progress(jobs: DataFrame, reports: DataFrame, now: datetime) -> DataFrame:
    """Jobs with the reports (id, step, progress) of their workers; a finished job takes none, and a missing step or number leaves the old one."""
    rows = jobs.join(reports.select("id", F.col("step").alias("_s"), F.col("progress").alias("_p"), F.lit(True).alias("_o")), "id", "left")
    open_ = F.col("_o").isNotNull() & F.col("status").isin("pending", "processing")
    new = lambda c, v: F.when(open_, F.coalesce(v, c)).otherwise(F.col(c)).alias(c)
    return rows.withColumns({"step": new("step", F.col("_s")), "progress": new("progress", F.col("_p")), "updated_at": F.when(open_, _at(now)).otherwise(F.col("updated_at"))}).drop("_s", "_p", "_o")


def clear_blobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs without the keys of files that have been removed."""
    rows = jobs.join(ids.select("id").distinct().withColumn("_o", F.lit(True)), "id", "left")
    return rows.withColumn("blob_key", F.when(F.col("_o").isNull(), F.col("blob_key"))).drop("_o")


def _kept(times: list, steps: list, last: float | None, step: str | None, gap: float) -> tuple[list[bool], float | None, str | None]:
    out = []
    for t, s in zip(times, steps, strict=True):
        emit = last is None or s != step or t - last >= gap
        out.append(emit)
        if emit:
            last, step = t, s
    return out, last, step


def throttle(events: DataFrame, *, milliseconds: int = 900, key: str = "job_id") -> DataFrame:
    """Progress events that are sent on: each change of step, else one at most in so many milliseconds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"], kind="stable")
        keep, _, _ = _kept((pdf["ts"].astype("int64") // 1_000_000).tolist() if str(pdf["ts"].dtype).endswith("[ns]") else [t.timestamp() * 1000 for t in pdf["ts"]], pdf["step"].tolist(), None, None, milliseconds)
        return pdf[keep]

    return events.groupBy(key).applyInPandas(run, events.schema)


def throttle_stream(events: DataFrame, *, milliseconds: int = 900, key: str = "job_id") -> DataFrame:
    """The same over a stream, with the last sent time and step as the key's state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [f.name for f in events.schema]

    def run(_key, frames, state: GroupState):
        last, step = state.get if state.exists else (None, None)
        for pdf in frames:
            pdf = pdf.sort_values("ts", kind="stable")
            keep, last, step = _kept([t.timestamp() * 1000 for t in pdf["ts"]], pdf["step"].tolist(), last, step, milliseconds)
            yield pdf[keep][names]
        state.update((last, step))

    return events.groupBy(key).applyInPandasWithState(run, events.schema, "last double, step string", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: tuple[str, ...] = ("event_type",), total: str | None = None) -> DataFrame:
    """Counts in event-time windows, closed once the watermark has passed them, and the sum of ``total`` if one is named. Over a table that doesn't grow all windows come."""
    more = [] if total is None else [F.sum(total).alias("total")]
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), *more)


def poll(ticks: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, *, seconds: float = 3.0, once: bool = False):
    """Runs ``work`` on each batch of a stream of jobs. A batch number comes again only if the batch has not been finished; work must bear that."""
    writer = ticks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(0.5, seconds)} seconds")
    return writer.start()


def tenant_events(events: DataFrame, tenant: str) -> DataFrame:
    """A tenant's own frames."""
    return events.filter(F.col("tenant_id") == tenant)
