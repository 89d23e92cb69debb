"""Structured Streaming forms of the monitoring queries.

State is keyed by fine keys (job, or (repo, minute, job)) so it spreads over all
state-store partitions; no state row collects a group's members. Results leave the
stream through ``foreachBatch`` into a folder per micro-batch id (overwritten on a
retry, so replays are idempotent), which ``compaction`` merges into generations;
``read_latest`` keeps the newest row per key.
Without a watermark, state grows with the number of jobs. Given a ``lateness``, the
roll-up, latest-status and per-minute streams key their state by an event-time bucket
under a watermark, so old state is evicted (rows later than that are dropped and
counted by ``count_dropped``); the read side re-combines the buckets.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.monitoring import DEFAULT_USERS, event_order_key, minute_bin, order_key_stage, order_key_time
from ..schema import EVENT_SCHEMA, LAST_STAGE
from ..session import scratch_path
from ..sources.sinks import latest_per_key
from .compaction import compacting_sink, updates


# ------------------------------------------------------------------ state partitions
@contextmanager
def state_partitions(spark: SparkSession, n: int | None):
    """Run the enclosed query starts with ``n`` shuffle/state partitions.

    A stateful query fixes its number of state-store partitions in its checkpoint when
    it first runs; size it to the state, not to a batch job's shuffle setting. The
    session value is restored afterwards."""
    if not n:
        yield
        return
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


# Jobs' state in RocksDB, on the executors' disks: the default store keeps all of it on the heap, where it grows with
# the jobs. Of a store (a state partition) memory holds memtables, a block cache and the files' indexes and filters, 1 to 2
# per cent of its rows' bytes; one bound for all of this made lookups several times slower. A commit writes what has changed.
ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{ROCKSDB}.changelogCheckpointing.enabled": "true",
    f"{ROCKSDB}.writeBufferSizeMB": "32",
    f"{ROCKSDB}.maxWriteBufferNumber": "3",
    f"{ROCKSDB}.blockCacheSizeMB": "32",
    f"{ROCKSDB}.trackTotalNumberOfRows": "false",  # the number costs a lookup for each write
}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Start the enclosed stateful queries with ``STATE_STORE``. What the session sets itself stays, and a query that has
    a checkpoint keeps the store that it began with. The session's values are restored afterwards."""
    given = spark.conf.getAll
    ours = {k: v for k, v in STATE_STORE.items() if k not in given}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)


# ------------------------------------------------------------------ T1 ingest
def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of stage events from parquet files, with the declared schema."""
    r = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def run_to_end(query: StreamingQuery) -> StreamingQuery:
    """Wait for an ``availableNow`` query and surface its failure."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return query


def ingest(stream: DataFrame, dest: str, checkpoint: str) -> StreamingQuery:
    """T1 sink: append the events to a parquet folder (exactly once via the log)."""
    q = (stream.writeStream.format("parquet").option("path", dest).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    return run_to_end(q)


# ------------------------------------------------------------------ update sinks
def batch_folder_sink(dest: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: rows of micro-batch ``b`` go to ``dest/batch_id=b``.

    A replayed micro-batch overwrites its own folder, so the sink is idempotent."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{dest}/batch_id={batch_id}"
        )

    return write


def read_latest(spark: SparkSession, dest: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key written by ``batch_folder_sink``, compacted or not."""
    return latest_per_key(updates(spark, dest), keys, ["_batch"]).drop("_batch")


COMPACT_EVERY = 50  # micro-batches between compactions of a stream's output


def _run_update(stream_agg: DataFrame, dest: str, checkpoint: str, mode: str = "update", keys: Sequence[str] = (),
                compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    sink = batch_folder_sink(dest)
    if keys:
        sink = compacting_sink(sink, dest, keys, compact_every)
    q = (stream_agg.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return run_to_end(q)


# ------------------------------------------------------------------ T2 batch roll-up
BUCKET = "1 day"


def _bucketed(stream: DataFrame, lateness: str | None, bucket: str) -> tuple[DataFrame, list]:
    """With ``lateness``: a watermark on event time and an event-time bucket key, so the
    state of buckets older than the watermark is evicted. The stream's NTZ time is
    read as UTC for the watermark."""
    if not lateness:
        return stream, []
    s = stream.withColumn("_et", F.col("time").cast("timestamp")).withWatermark("_et", lateness)
    return s, [F.window("_et", bucket).start.alias("_bucket")]


def job_progress(stream: DataFrame, lateness: str | None = None, bucket: str = BUCKET) -> DataFrame:
    """Per (batch, job[, bucket]) running totals; the batch roll-up is a sum over these."""
    s, extra = _bucketed(stream, lateness, bucket)
    return s.groupBy("ingestion_batch_id", "job_id", *extra).agg(
        F.count_if(F.col("finished")).alias("finished_events"),
        F.count_if(F.col("errored")).alias("errored_events"),
        F.min("created_at").alias("creation_time"),
        F.max("time").alias("last_updation_time"),
    )


def rollup_from_jobs(jobs: DataFrame) -> DataFrame:
    """Batch roll-up (Q2 columns) from per-job (or per job and bucket) totals."""
    return jobs.groupBy("ingestion_batch_id").agg(
        F.count_distinct("job_id").alias("num_jobs"),
        F.sum("finished_events").cast("long").alias("successful_jobs"),
        F.sum("errored_events").cast("long").alias("errored_jobs"),
        F.min("creation_time").alias("creation_time"),
        F.max("last_updation_time").alias("last_updation_time"),
    )


def batch_rollup_stream(stream: DataFrame, dest: str, checkpoint: str, lateness: str | None = None,
                        bucket: str = BUCKET, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Run the per-job state to ``dest``; read with ``batch_rollup_result``."""
    keys = ["ingestion_batch_id", "job_id"] + (["_bucket"] if lateness else [])
    with state_on_disk(stream.sparkSession):
        return _run_update(job_progress(stream, lateness, bucket), dest, checkpoint, "update", keys, compact_every)


def batch_rollup_result(spark: SparkSession, dest: str) -> DataFrame:
    keys = ["ingestion_batch_id", "job_id"] + (["_bucket"] if "_bucket" in updates(spark, dest).columns else [])
    return rollup_from_jobs(read_latest(spark, dest, keys))


# ------------------------------------------------------------------ T3 finished per minute
def finished_per_minute_agg(stream: DataFrame, users: Sequence[str] = DEFAULT_USERS,
                            lateness: str | None = None) -> DataFrame:
    """Distinct finished jobs per (repo, minute): dedup on (repo, minute, job),
    then count. With ``lateness`` the state is bounded by an event-time watermark
    (the stream's NTZ time is read as UTC), and a minute leaves the stream only once the
    watermark has passed it: minutes still open are not in the output of the run, so
    what is read after it is final but not complete; ``finished_per_minute_result`` adds the open ones."""
    f = stream.where((F.col("stage") == "Finished") & F.col("user_id").isin(*users))
    f = f.select("repo_id", minute_bin("time").alias("interval_start"), "job_id")
    if lateness:
        f = f.withColumn("_et", F.col("interval_start").cast("timestamp")).withWatermark("_et", lateness)
        d = f.dropDuplicatesWithinWatermark(["repo_id", "interval_start", "job_id"])
        return d.groupBy("repo_id", "interval_start", F.window("_et", "1 minute")).agg(
            F.count(F.lit(1)).alias("num_jobs")).drop("window")
    d = f.dropDuplicates(["repo_id", "interval_start", "job_id"])
    return d.groupBy("repo_id", "interval_start").agg(F.count(F.lit(1)).alias("num_jobs"))


def finished_per_minute_stream(stream: DataFrame, dest: str, checkpoint: str,
                               users: Sequence[str] = DEFAULT_USERS, lateness: str | None = None,
                               compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    mode = "append" if lateness else "update"
    return _run_update(finished_per_minute_agg(stream, users, lateness), dest, checkpoint, mode, ["repo_id", "interval_start"], compact_every)


def open_minutes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """T3 with a lateness: the minutes that the stream still counts, read from its state store after a run: ``repo_id,
    interval_start, num_jobs``. Their counts are provisional."""
    ops = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorName").distinct().collect()
    counts = [r["operatorId"] for r in ops if r["operatorName"] == "stateStoreSave"]  # a row a stateful operator
    state = spark.read.format("statestore").option("operatorId", counts[0]).load(checkpoint)
    value = state.schema["value"].dataType.fieldNames()[0]
    return state.select("key.repo_id", "key.interval_start", F.col(f"value.{value}").cast("long").alias("num_jobs"))


def finished_per_minute_result(spark: SparkSession, dest: str, checkpoint: str) -> DataFrame:
    """T3 with a lateness, complete: the minutes that have left the stream (``final``) and those still open."""
    done = read_latest(spark, dest, ["repo_id", "interval_start"]).withColumn("final", F.lit(True))
    return done.unionByName(open_minutes(spark, checkpoint).withColumn("final", F.lit(False)))


def _dropped(progress) -> int:
    return sum(int(getattr(op, "numRowsDroppedByWatermark", 0) or 0) for op in progress.stateOperators or [])


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows the watermark dropped in the progress reports that Spark still keeps (the last
    ``spark.sql.streaming.numRecentProgressUpdates``); ``count_dropped`` counts all of them."""
    return sum(map(_dropped, query.recentProgress))


class DroppedRows(StreamingQueryListener):
    """Running count of rows dropped by the watermark, by query run, over all micro-batches."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.seen: dict[str, int] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        run = str(p.runId)
        self.rows[run] = self.rows.get(run, 0) + _dropped(p)
        self.seen[run] = max(self.seen.get(run, -1), p.batchId)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def of(self, query: StreamingQuery, wait: float = 60.0) -> int:
        """Rows that ``query`` has dropped up to its last progress report; reports arrive a little
        later than the query ends, and a missing one raises rather than being left out."""
        last, run, end = query.lastProgress, str(query.runId), time.monotonic() + wait
        while last is not None and self.seen.get(run, -1) < last.batchId:
            if time.monotonic() > end:
                raise TimeoutError("progress reports of the query did not arrive")
            time.sleep(0.05)
        return self.rows.get(run, 0)


@contextmanager
def count_dropped(spark: SparkSession):
    """Counts the dropped rows of the queries started inside: ``with count_dropped(spark) as d: ...; d.of(query)``."""
    counter = DroppedRows()
    spark.streams.addListener(counter)
    try:
        yield counter
    finally:
        spark.streams.removeListener(counter)


# ------------------------------------------------------------------ T4 latest status
def latest_status_agg(stream: DataFrame, lateness: str | None = None, bucket: str = BUCKET) -> DataFrame:
    s, extra = _bucketed(stream, lateness, bucket)
    k = event_order_key()
    return s.groupBy("job_id", *extra).agg(F.max(k).alias("_key"), F.max_by("stage", k).alias("stage"), F.max_by("errored", k).alias("errored"))


def latest_status_stream(stream: DataFrame, dest: str, checkpoint: str, lateness: str | None = None,
                         bucket: str = BUCKET, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """T4: per-job latest event (per bucket with ``lateness``), emitted in update mode."""
    keys = ["job_id"] + (["_bucket"] if lateness else [])
    with state_on_disk(stream.sparkSession):
        return _run_update(latest_status_agg(stream, lateness, bucket), dest, checkpoint, "update", keys, compact_every)


def latest_status_result(spark: SparkSession, dest: str) -> DataFrame:
    keys = ["job_id"] + (["_bucket"] if "_bucket" in updates(spark, dest).columns else [])
    st = read_latest(spark, dest, keys).groupBy("job_id").agg(
        F.max("_key").alias("_key"), F.max_by("stage", "_key").alias("stage"), F.max_by("errored", "_key").alias("errored"))
    sp = order_key_stage(F.col("_key"))
    return st.select(
        "job_id",
        "stage",
        sp.alias("stage_progress"),
        "errored",
        order_key_time(F.col("_key")).alias("last_updation_time"),
    )


# ------------------------------------------------------------------ T5 fan-out
def fan_out_stream(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """T5: every micro-batch to several sinks, persisted once; each sink must be
    idempotent by batch id (the folder-per-batch writers are)."""

    def write(df: DataFrame, batch_id: int) -> None:
        cached = df.persist()
        try:
            for s in sinks:
                s(cached, batch_id)
        finally:
            cached.unpersist()

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return run_to_end(q)


# ------------------------------------------------------------------ T6 events per batch
def events_per_batch_stream(stream: DataFrame, dest: str, checkpoint: str, limit: int = 100) -> StreamingQuery:
    """Events per batch, ordered limit, complete mode (the result is ``limit`` rows)."""
    agg = stream.groupBy("ingestion_batch_id").agg(F.count(F.lit(1)).alias("unique_events"))
    top = agg.orderBy("ingestion_batch_id").limit(limit)

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{dest}/batch_id={batch_id}")

    q = (top.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return run_to_end(q)


def last_complete_result(spark: SparkSession, dest: str) -> DataFrame:
    """The result of the last micro-batch of a complete-mode query."""
    raw = spark.read.parquet(dest)
    last = raw.select(F.max("batch_id")).scalar()
    return raw.where(F.col("batch_id") == last).drop("batch_id")


# ------------------------------------------------------------------ helpers for runs
SOURCE_ROW_GROUP = 4 * 1024 * 1024  # bytes before compression
SOURCE_FILE_ROWS = 2_000_000
MIN_SOURCE_FILES = 4  # a round's, where no more cores are known (executors may still be starting)


def stage_rounds_source(events: DataFrame, dest: str) -> str:
    """Write events as the writer does: one append per stage round, in stage order,
    so a stream reads them over several micro-batches with late stage-0 rows. Not
    persisted: the events are many times their source, and deriving them is cheap.

    A round has a file per core or few more, of short row groups: a micro-batch takes few files and a task
    reads whole row groups, so many small files, or files of one row group, would leave most cores idle. Files
    are bounded, and so are what a micro-batch sorts or holds."""
    files = max(MIN_SOURCE_FILES, events.sparkSession.sparkContext.defaultParallelism)
    for r in range(LAST_STAGE + 1):  # one append per stage round (7), not per row
        (events.where(F.col("stage_progress") == r).coalesce(files).write.mode("append")
         .options(**{"compression": "zstd", "parquet.block.size": SOURCE_ROW_GROUP, "maxRecordsPerFile": SOURCE_FILE_ROWS}).parquet(dest))
    return dest


def scratch_stream_paths(spark: SparkSession, label: str) -> tuple[str, str, str]:
    """(source, sink, checkpoint) folders under the shared checkpoint folder."""
    base = scratch_path(spark, label)
    return f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
