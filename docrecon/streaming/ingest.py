"""Scanning as two streams: folders are listed, and the files found go through the stages into the run's ledger.

The listing reads no file. Files that are out of scope, or that an earlier pass has finished, are dropped while they are
paths; what is left is opened by the tasks that take text from it. Each stream's checkpoint is its resume point. A pass
that was ended half-way is taken up by the next scan of the run, one that was finished is followed by a new pass, which
finds what has come since.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docrecon.operators.corpus import needs_review
from docrecon.operators.stages import STAGES, finish, seed
from docrecon.operators.views import failed_in, recent, stage_events
from docrecon.settings import DEFAULTS, Settings
from docrecon.sources.folders import SCHEMA, exhausted, read_tree
from docrecon.sources.lease import TTL, Lease, read_meta, write_meta
from docrecon.sources.pages import Counter, count_pages, walk_pages
from docrecon.sources.recognition import Layers, recognised
from docrecon.sources.runs import unfinished
from docrecon.sources.text import Provider, with_text
from docrecon.streaming.control import Gate, Progress, Stopped, watched

#: Files of a part of the list of found files; a micro-batch has a part for each core unless told otherwise.
PART = 256


def append_ledger(run: str, number: int, lease: Lease, progress: Progress | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that gives each micro-batch of pass ``number`` a folder of the ledger, at once and once: a batch that is run
    again finds its folder there, and an owner that has lost the run is refused."""

    def write(batch: DataFrame, n: int) -> None:
        staged = os.path.join(run, "staged", uuid.uuid4().hex)
        target = os.path.join(run, "ledger", f"pass={number}", f"batch={n}")
        batch.withColumn("seq", F.lit((number << 32) + n)).write.parquet(staged)
        try:
            with lease.writing():
                if not os.path.isdir(target):
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    os.replace(staged, target)
        finally:
            shutil.rmtree(staged, ignore_errors=True)
        if progress:
            progress.noted(n, [r.asDict() for r in recent(batch.sparkSession.read.parquet(target)).collect()])

    return write


def ledger(spark: SparkSession, run: str) -> DataFrame | None:
    """All that the run's scans have finished, None before the first."""
    path = os.path.join(run, "ledger")
    return spark.read.parquet(path) if os.path.isdir(path) and os.listdir(path) else None


def _folder(run: str, kind: str, number: int) -> str:
    return os.path.join(run, "passes", f"{number:05d}", kind)


def discover(spark: SparkSession, run: str, number: int, root: str, settings: Settings = DEFAULTS, gate: Gate | None = None, part: int = PART) -> bool:
    """List the files in scope into the pass's table; whether the tree came to its end."""
    state = _folder(run, "walk", number)
    found = read_tree(spark, root, state, settings, gate.path if gate else None)
    writer = found.writeStream.format("parquet").option("path", _folder(run, "found", number)).option("maxRecordsPerFile", part)
    query = writer.option("checkpointLocation", _folder(run, "listing", number)).trigger(processingTime="0 seconds").start()
    try:
        while not exhausted(state) and not (gate and gate.state == "stopped"):
            if query.awaitTermination(0.1):
                break
    finally:
        query.stop()
    return exhausted(state)


def found_files(spark: SparkSession, run: str, number: int) -> DataFrame:
    """The files that a pass has listed."""
    path = _folder(run, "found", number)
    return spark.read.schema(SCHEMA).parquet(path) if os.path.isdir(path) else spark.createDataFrame([], SCHEMA)


def start(spark: SparkSession, run: str, number: int, lease: Lease, provider: str | Provider | Layers, settings: Settings = DEFAULTS, parts: int | None = None, gate: Gate | None = None, progress: Progress | None = None, counter: Counter = count_pages) -> StreamingQuery:
    """Start (or go on with) taking the files that pass ``number`` found through the stages. Files of several pages become
    a document a page, and pages are dealt to all tasks."""
    parts = parts or spark.sparkContext.defaultParallelism
    path = _folder(run, "found", number)
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", parts).parquet(path)
    files = seed(files, settings).select("path", "filename", "size_bytes")
    before = ledger(spark, run)
    if before is not None:  # passes before this one never change, so they may be read as they are
        files = files.join(before.filter(F.col("pass") < number).select("path").distinct(), "path", "left_anti")
    pages = walk_pages(files, settings, counter, gate).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_key")
    read = recognised(pages, provider, settings, gate) if isinstance(provider, Layers) else with_text(pages, provider, gate)
    docs = seed(read, settings)
    for stage in STAGES:
        docs = watched(docs.transform(stage, settings), f"stage_{stage.__name__}", errors=F.count_if(failed_in(stage.__name__)))
    of = lambda when: F.count_if(when)
    docs = watched(
        finish(stage_events(docs)), "finished", pdfs=F.count(F.lit(1)), invoices=of(F.col("doc_type") == "invoice"), approvals=of(F.col("doc_type") == "approval"),
        ocr=of(F.col("source") == "ocr"), flagged=of(needs_review()), errors=of(F.coalesce("error", F.lit("")) != ""))
    writer = docs.writeStream.queryName(f"scan-{uuid.uuid4().hex}").foreachBatch(append_ledger(run, number, lease, progress))
    return writer.option("checkpointLocation", _folder(run, "checkpoint", number)).trigger(availableNow=True).start()


def scan(
    spark: SparkSession, run: str, root: str, provider: str | Provider | Layers, settings: Settings = DEFAULTS, gate: Gate | None = None, progress: Progress | None = None,
    counter: Counter = count_pages, part: int = PART, parts: int | None = None, ttl: float = TTL,
) -> bool:
    """Scan ``root`` into ``run``, or go on with a scan that was ended. Nobody else may scan or edit the run meanwhile.

    The run is complete if the tree was listed to its end and every file found is in the ledger; one that its gate, or
    anyone else, has stopped isn't, however it ended.
    """
    with Lease(run, "scan", ttl) as lease:
        meta = read_meta(run)
        number = meta["pass"] if meta.get("pass") and not meta.get("complete") else meta.get("pass", 0) + 1
        write_meta(run, lease, **{"pass": number, "complete": False})
        shutil.rmtree(os.path.join(run, "staged"), ignore_errors=True)  # what a dead owner left
        try:
            complete = _scanned(spark, run, number, lease, root, provider, settings, gate, progress, counter, part, parts)
        except Exception:
            if progress:
                progress.publish("error")
            raise
        write_meta(run, lease, complete=complete)
    if progress:
        progress.publish("done" if complete else "stopped")
    return complete


def _scanned(spark, run, number, lease, root, provider, settings, gate, progress, counter, part, parts) -> bool:
    if (gate and gate.state == "stopped") or not (exhausted(_folder(run, "walk", number)) or discover(spark, run, number, root, settings, gate, part)):
        return False
    wanted = seed(found_files(spark, run, number), settings).select("path")
    done = ledger(spark, run)
    left = wanted if done is None else unfinished(wanted, done, "path")
    total = wanted.count()
    query = start(spark, run, number, lease, provider, settings, parts, gate, progress, counter)
    if progress:
        spark.streams.addListener(progress)
        progress.begin(query.name, total, total - left.count())
    try:
        while not query.awaitTermination(0.2):
            if gate and gate.state == "stopped":
                query.stop()
    except StreamingQueryException:
        if not (gate and gate.state == "stopped"):
            raise
    finally:
        query.stop()  # no batch may go on once the lease is given back
        if progress:
            _told(progress, query)
            spark.streams.removeListener(progress)
    done = ledger(spark, run)
    return not (gate and gate.state == "stopped") and (total == 0 if done is None else unfinished(wanted, done, "path").isEmpty())


def _told(progress: Progress, query: StreamingQuery) -> None:
    """Wait for the events of the last micro-batches, which come on a thread of their own."""
    last, until = query.lastProgress, time.monotonic() + 5
    while last and last.observedMetrics and last.batchId not in progress.batches and time.monotonic() < until:
        time.sleep(0.05)


def running_tally(events: DataFrame) -> DataFrame:
    """Running totals by kind, for batch or stream (complete mode): kind, n, total."""
    return events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


__all__ = ["Gate", "Progress", "Stopped", "append_ledger", "discover", "ledger", "running_tally", "scan", "start"]
