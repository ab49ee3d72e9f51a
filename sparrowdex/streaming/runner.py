"""Ingest as a stream of jobs: a queue, a runner whose batches may run again, and a stream of the frames that tell of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.snapshots import Folder
from . import jobs

QUEUE = "id string, document_id string, path string, length long, content binary, categories array<string>, kb_ids array<string>, figures string, created_at timestamp"
FRAMES = "id string, document_id string, status string, step string, progress int, error string, attempt int, at timestamp"
#: Tries of a batch that throws before its jobs fail.
TRIES = 2


class IngestRunner:
    """Jobs of one knowledge base: ``enqueue`` takes files in, ``start`` works them off batch by batch, ``frames`` streams what happens.

    Jobs and their documents get their ids when they are queued, and the stream gives a batch that was not finished again with the same number and rows. A batch leaves a mark before its first write; if the mark is
    there already, or a job was begun in another batch, what the earlier run wrote for the batch's documents is deleted before they are written again, so no document is there twice. A batch that throws is run once more; then its
    jobs fail with the error and the stream goes on.
    """

    def __init__(self, kb, *, work: Callable[..., object] | None = None):
        self.kb, self.spark = kb, kb.spark
        root = kb.tables.root
        self._tenant = f"tenant={uuid.uuid5(uuid.NAMESPACE_OID, kb.key.tenant).hex}"
        self.queue, self.told = f"{root}/queue/{self._tenant}", f"{root}/frames/{self._tenant}"
        self.marks = Folder(self.spark, f"{root}/batches/{self._tenant}")
        self._work = work or kb.ingest

    # -- the queue

    def enqueue(self, source: DataFrame, *, categories: list[str] | None = None, kb_ids: list[str] | None = None, figures: str = "auto") -> DataFrame:
        """Queues files (path, length, content) as pending jobs and returns (id, document_id, path). Nothing is read from them yet."""
        self.kb.require_write(kb_ids)
        listed = lambda x: F.array(*map(F.lit, x or [])).cast("array<string>")
        now = F.lit(datetime.now(UTC))
        rows = source.select(F.expr("uuid()").alias("id"), F.expr("uuid()").alias("document_id"), "path", "length", "content", listed(categories).alias("categories"), listed(kb_ids).alias("kb_ids"), F.lit(figures).alias("figures"), now.alias("created_at"))
        staged = f"{self.kb.tables.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)  # the ids are drawn once
        rows = self.spark.read.schema(QUEUE).parquet(staged)
        # jobs are listed before they are queued, so a runner never meets one that is not
        self.kb.tables.append("ingest_jobs", self._job_rows(rows, "pending", "queued", 0))
        self._tell(rows, "pending", "queued", 0)
        rows.write.mode("append").parquet(self.queue)
        return rows.select("id", "document_id", "path")

    def _job_rows(self, rows: DataFrame, status: str, step: str, progress: int, error: str | None = None, attempt: int = 1) -> DataFrame:
        now = F.lit(datetime.now(UTC))
        return rows.select("id", "document_id", F.lit(self.kb.key.tenant).alias("tenant_id"), F.col("path").alias("blob_key"), F.lit(status).alias("status"), F.lit(attempt).alias("attempt"), F.lit(step).alias("step"), F.lit(progress).alias("progress"), F.lit(error).cast("string").alias("error"), "created_at", now.alias("updated_at"))

    def _tell(self, rows: DataFrame, status: str, step: str, progress: int, error: str | None = None, attempt: int = 1) -> None:
        out = self._job_rows(rows, status, step, progress, error, attempt).select("id", "document_id", "status", "step", "progress", "error", "attempt", F.col("updated_at").alias("at"))
        out.write.mode("append").parquet(self.told)

    # -- working it off

    def start(self, checkpoint: str, *, seconds: float = 3.0, once: bool = False, files: int = 100):
        """Works the queue off as a stream; ``once`` stops when it is empty."""
        self._made(self.queue)
        ticks = self.spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", files).parquet(self.queue)
        name = uuid.uuid5(uuid.NAMESPACE_OID, checkpoint).hex
        return jobs.poll(ticks, lambda batch, number: self.run(batch, f"{name}-{number}"), checkpoint, seconds=seconds, once=once)

    def _made(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(target)

    def run(self, batch: DataFrame, mark: str) -> None:
        """Takes one batch of jobs in; see the class for what happens if it comes again."""
        if batch.isEmpty():
            return
        again = not self.marks.create(mark, "begun") or self._begun(batch)
        error = None
        for attempt in range(1, TRIES + 1):
            if again or attempt > 1:
                self._undo(batch)
            self._tell(batch, "processing", "extracting", 5, attempt=attempt)
            self.kb.tables.append("ingest_jobs", self._job_rows(batch, "processing", "extracting", 5, attempt=attempt))
            try:
                self._take(batch)
                done = self.kb.jobs().join(batch.select("id"), "id", "left_semi")
                done.select("id", "document_id", "status", "step", "progress", "error", F.lit(attempt).alias("attempt"), F.col("updated_at").alias("at")).write.mode("append").parquet(self.told)
                return
            except Exception as e:  # noqa: BLE001 - the jobs carry it
                error = str(e)[: jobs.ERROR_CHARS]
        self._undo(batch)
        self.kb.tables.append("ingest_jobs", self._job_rows(batch, "failed", "failed", 100, error, TRIES))
        self._tell(batch, "failed", "failed", 100, error, TRIES)

    def _begun(self, batch: DataFrame) -> bool:
        """Whether a job of the batch was begun in another one, as after a sweep."""
        rows = self.kb.tables.read("ingest_jobs").filter("status = 'processing'")
        return not rows.join(batch.select("id").distinct(), "id", "left_semi").isEmpty()

    def _take(self, batch: DataFrame) -> None:
        """Jobs with the same settings are taken in together."""
        kinds = batch.select("categories", "kb_ids", "figures").distinct().collect()  # a row for each setting of a batch
        named = batch.withColumn("_path", F.concat_ws("/", "id", "path"))  # one path may be queued twice
        for kind in kinds:
            rows = named
            for c in ("categories", "kb_ids", "figures"):
                value = F.array(*map(F.lit, kind[c])).cast("array<string>") if isinstance(kind[c], list) else F.lit(kind[c])
                rows = rows.filter(F.col(c).eqNullSafe(value))
            ids = rows.select(F.col("_path").alias("path"), F.col("document_id").alias("id"), F.col("id").alias("job_id"), F.col("path").alias("blob_key"), "created_at")
            source = rows.select(F.col("_path").alias("path"), "length", "content")
            self._work(source, ids=ids, categories=kind["categories"], kb_ids=kind["kb_ids"] or None, figures=kind["figures"])

    def _undo(self, batch: DataFrame) -> None:
        self.kb.forget(batch.select("document_id"))

    def sweep(self, now: datetime | None = None) -> DataFrame:
        """Jobs that stopped reporting are pending and queued again, or failed after the last attempt; returns those that changed. What an earlier run wrote goes when they are begun again."""
        was = self.kb.jobs()
        changed = jobs.reclaim(was, now or datetime.now(UTC)).filter("changed").drop("changed").withColumn("updated_at", F.lit(now or datetime.now(UTC)))
        staged = f"{self.kb.tables.root}/staged/{uuid.uuid4().hex}"
        changed.write.parquet(staged)
        changed = self.spark.read.schema(changed.schema).parquet(staged)
        if not changed.isEmpty():
            self.kb.tables.append("ingest_jobs", changed)
            changed.select("id", "document_id", "status", "step", "progress", "error", "attempt", F.col("updated_at").alias("at")).write.mode("append").parquet(self.told)
            # pending ones are queued again under their own ids
            queued = self.spark.read.schema(QUEUE).parquet(self.queue).dropDuplicates(["id"]).join(changed.filter("status = 'pending'").select("id"), "id", "left_semi")
            queued.write.mode("append").parquet(self.queue)
        return changed

    # -- telling

    def frames(self, *, files: int = 1000, alive_seconds: int | None = None) -> DataFrame:
        """The tenant's frames as a stream. A query over it keeps what it has read in its checkpoint, so after a restart no frame is lost or comes twice. ``alive_seconds`` adds a row without id so often, by which a listener knows that the stream is up."""
        self.kb.require_read()
        self._made(self.told)
        rows = self.spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files).parquet(self.told)
        rows = rows.withColumn("label", T.step_name(F.col("step")))
        if alive_seconds is None:
            return rows
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % alive_seconds == 0)
        alive = ticks.select(*(F.lit("alive").alias(f.name) if f.name == "status" else F.col("timestamp").alias("at") if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
        return rows.unionByName(alive)


__all__ = ["IngestRunner"]
