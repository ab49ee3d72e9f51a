"""The job runner: a batch that comes again, a batch that throws, the walls between tenants, and the stream of frames."""

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from sparrowdex.api import Key, KnowledgeBase
from sparrowdex.streaming.runner import FRAMES, QUEUE, IngestRunner


def upload(spark, *names):
    return spark.createDataFrame([(n, 30, bytearray(f"# {n}\n\nThe harbour of {n} is open.".encode())) for n in names], "path string, length long, content binary")


def contents(kb):
    return sorted(r["filename"] for r in kb.tables.read("documents").collect()), kb.tables.read("chunks").count()


def test_a_batch_that_comes_again_makes_no_document_twice(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", Key("t1"))
    runner = IngestRunner(kb)
    queued = runner.enqueue(upload(spark, "a.md", "b.md")).collect()
    assert {r["status"] for r in kb.jobs().collect()} == {"pending"}
    batch = spark.read.schema(QUEUE).parquet(runner.queue)
    real, died = runner._work, []

    def dies(*args, **options):  # all is written, and the driver ends before the batch does
        real(*args, **options)
        died.append(1)
        raise KeyboardInterrupt

    runner._work = dies
    try:
        runner.run(batch, "q-0")
    except KeyboardInterrupt:
        pass
    once = contents(kb)
    assert died and once[0] == ["a.md", "b.md"] and once[1] >= 2
    runner._work = real
    runner.run(batch, "q-0")
    assert contents(kb) == once
    done = {r["id"]: r for r in kb.jobs().collect()}
    assert {(r["id"], r["document_id"]) for r in queued} == {(r["id"], r["document_id"]) for r in done.values()} and {r["status"] for r in done.values()} == {"success"}
    hits = kb.words.search("harbour", 10).collect()
    assert len(hits) == 2 and len({r["key"] for r in hits}) == 2


def test_stream_retries_once_then_fails_and_frames_are_the_tenants_own(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    mine, theirs = KnowledgeBase(spark, root, Key("t1")), KnowledgeBase(spark, root, Key("t2"))
    calls = []

    def throws(*args, **options):
        calls.append(1)
        raise ValueError("no model")

    bad, other = IngestRunner(mine, work=throws), IngestRunner(theirs, work=throws)
    bad.enqueue(upload(spark, "a.md"))
    bad.start(f"file://{tmp_path}/ck", once=True).awaitTermination(120)
    (job,) = mine.jobs().collect()
    assert len(calls) == 2 and (job["status"], job["attempt"], job["error"]) == ("failed", 2, "no model")
    other.enqueue(upload(spark, "x.md"))

    def heard(runner):  # each listener goes on from its own checkpoint
        name = "t1" if runner is bad else "t2"
        sink = f"file://{tmp_path}/heard-{name}"
        runner.frames().writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-ck").trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r["at"], r["status"]) for r in spark.read.parquet(sink).collect())

    first = heard(bad)
    assert [s for _, s in first] == ["pending", "processing", "processing", "failed"] and [s for _, s in heard(other)] == ["pending"]
    assert heard(bad) == first  # a restart brings nothing twice
    bad._tell(spark.read.schema(QUEUE).parquet(bad.queue), "failed", "done", 100)
    assert heard(bad)[:4] == first and len(heard(bad)) == 5
    assert bad.frames(alive_seconds=5).columns == [*(c.split(" ")[0] for c in FRAMES.split(", ")), "label"]


def test_sweep_queues_stale_jobs_again(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", Key("t1"))
    runner = IngestRunner(kb)
    runner.enqueue(upload(spark, "a.md", "b.md"))
    rows = spark.read.schema(QUEUE).parquet(runner.queue)
    kb.tables.append("ingest_jobs", runner._job_rows(rows, "processing", "extracting", 5))
    assert runner.sweep(datetime.now(UTC)).count() == 0
    later = datetime.now(UTC) + timedelta(minutes=6)
    assert {(r["status"], r["attempt"]) for r in runner.sweep(later).collect()} == {("pending", 2)}
    assert spark.read.schema(QUEUE).parquet(runner.queue).groupBy("id").count().filter(F.col("count") == 2).count() == 2
    assert runner._begun(rows)  # so what the stale run may have written goes first
